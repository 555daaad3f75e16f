"""Stores that are rewritten in place, bucketed tables, the text index, VARIANT documents, and scans of hot keys by ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.operators import documents as DOC
from tessella.operators import ml as ML
from tessella.operators import relational as R
from tessella.operators import series as SE
from tessella.operators import stores as ST
from tessella.operators import text_index as TI
from tessella.plans import reports as REP
from tessella.sources import tables as TAB

DAY = ST.DAY_MS


def files(path):
    """Data files by day folder."""
    out = {}
    for d in sorted(os.listdir(path)):
        if "=" in d:
            out[d] = {(f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    return out


def record(i, ms, kind="python", logs=2):
    return (f"a{i:04}", ms, [f"line {n}" for n in range(logs)], [("kind", kind)])


SCHEMA = "activationId string, start bigint, logs array<string>, annotations array<struct<key: string, value: string>>"


def test_retention_touches_old_days_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [record(i, i * DAY // 4 + 7) for i in range(80)]  # days 0 to 19, four records each
    ST.write_days(spark.createDataFrame(rows, SCHEMA), path)
    before = files(path)
    assert len(before) == 20 and all(len(f) == 1 for f in before.values())
    cutoff = 12 * DAY + DAY // 2
    done = ST.retain_days(spark, path, cutoff + 5 * DAY, 5)
    assert done == {"dropped": list(range(12)), "rewritten": [12]}
    after = files(path)
    assert {d: f for d, f in after.items() if d != "day=12"} == {f"day={d}": before[f"day={d}"] for d in range(13, 20)}
    assert after["day=12"] != before["day=12"]
    assert sorted(r.activationId for r in spark.read.parquet(path).collect()) == sorted(a for a, ms, *_ in rows if ms >= cutoff)
    assert ST.retain_days(spark, path, cutoff + 5 * DAY, 5) == {"dropped": [], "rewritten": []}
    assert files(path) == after
    # a day of which nothing stays goes as well
    assert ST.retain_days(spark, path, 14 * DAY - 1 + 5 * DAY, 5) == {"dropped": [12, 13], "rewritten": []}
    assert ST.retain_days(spark, str(tmp_path / "none"), cutoff, 5) == {"dropped": [], "rewritten": []}


def test_logs_are_stripped_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [record(i, i * DAY // 4 + 7, "sequence" if i % 8 < 4 else "python") for i in range(80)]  # even days are sequences
    ST.write_days(spark.createDataFrame(rows, SCHEMA), path)
    before = files(path)
    cutoff = 10 * DAY + DAY // 2
    assert ST.strip_old_logs(spark, path, cutoff + 3 * DAY, 3) == [1, 3, 5, 7, 9]
    after = files(path)
    assert {d for d in after if after[d] != before[d]} == {f"day={d}" for d in (1, 3, 5, 7, 9)}
    got = {r.activationId: len(r.logs) for r in spark.read.parquet(path).collect()}
    assert got == {a: 0 if ms < cutoff and ann[0][1] != "sequence" else 2 for a, ms, _, ann in rows}
    assert ST.strip_old_logs(spark, path, cutoff + 3 * DAY, 3) == [] and files(path) == after


def test_large_days_go_to_several_tasks_and_small_ones_to_few_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 512).alias("activationId"), F.when(F.col("id") < 30_000, 0).otherwise(F.col("id") % 5 + 1).alias("d")).withColumn("start", F.col("d") * DAY)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "768k")
    try:
        ST.write_days(rows.repartition(6), str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    n = {d: len(f) for d, f in files(str(tmp_path / "store")).items()}
    assert n["day=0"] > 2 and max(v for d, v in n.items() if d != "day=0") <= 2


def test_expired_snapshots_are_dropped_by_name(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    names = ["backup_100_a", "backup_900_a", "backup_100_keep", "other_100_a"]
    docs = spark.createDataFrame([(n, str(i), i == 3) for n in names for i in range(4)], "snapshot string, _id string, deleted boolean")
    ST.write_snapshots(docs, path)
    assert ST.drop_expired(spark, path, 1000, 500, exclude=("_keep",)) == ["backup_100_a"]
    assert {r.snapshot: r["count"] for r in spark.read.parquet(path).groupBy("snapshot").count().collect()} == {n: 3 for n in names[1:]}
    assert ST.drop_expired(spark, str(tmp_path / "none"), 1000, 500) == []


def test_bucketed_join_moves_no_row(spark, data):
    out = Q.QUERIES["jn8_bucketed_join"](spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    words = ["red", "reds", "fox", "the", "Der", "x_1", "über"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, None), (None, "red fox"), (301, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    TI.build(docs, path := str(tmp_path / "index"), buckets=8, shard_docs=100)
    index = TI.Index(spark, path, 8)
    known = docs.where("doc_id IS NOT NULL")
    ids = lambda df: sorted(r[0] for r in df.collect())
    any_of = lambda ws: F.arrays_overlap(TI.terms("text"), F.array(*map(F.lit, ws)))
    for said in ("red fox", "the the", "the red, FOX", "x_1", "nothing here", "ber red"):
        assert ids(index.phrase(said)) == ids(known.where(TI.holds_phrase("text", said)).select("doc_id"))
        assert ids(index.phrase_prefix(said)) == ids(known.where(TI.holds_phrase("text", said, prefix=True)).select("doc_id"))
        assert ids(index.match(said)) == ids(known.where(any_of(TI.asked(said))).select("doc_id"))
        assert ids(index.match_all(said)) == ids(known.where(F.array_size(F.array_except(F.array(*map(F.lit, TI.asked(said))), TI.terms("text"))) == 0).select("doc_id"))
    assert ids(index.phrase_prefix("red re")) and ids(index.phrase_prefix("re"))
    assert ids(index.match("")) == ids(index.phrase("")) == ids(index.phrase_prefix("")) == []
    # postings of the asked words alone: their folders, their rows, and no text
    plan = TI.search(docs.select("doc_id"), index.phrase("red fox"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [fox,red])" in plan.replace("'", "")


def test_index_splits_a_frequent_term(spark, tmp_path, apart):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the").alias("text"))
    TI.build(docs, path := str(tmp_path / "index"), buckets=4, shard_docs=50)
    (folder,) = TAB.folders(spark, path)
    assert len([f for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet")]) > 2
    assert TI.Index(spark, path, 4).match("the").count() == 400


def test_index_moves_postings_not_words(spark, tmp_path):
    def moved():
        g = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the red fox " * 300).alias("text")).repartition(2)
    docs.count()
    before = moved()
    TI.build(docs, path := str(tmp_path / "index"), buckets=4)
    assert moved() - before < 2_000  # of 180,000 words, 600 postings
    assert TI.Index(spark, path, 4).phrase("fox the").count() == 200


def test_index_puts_rows_of_a_document_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox the"), (1, "the red fox"), (1, None), (2, "Fox, fox"), (2, "fox \u0130x")], "doc_id long, text string")
    TI.build(docs, path := str(tmp_path / "index"), buckets=4)
    got = {(r.term, r.doc): r.positions for r in spark.read.parquet(path).collect()}
    assert got == {("red", 1): [0, 1], ("fox", 1): [1, 2], ("the", 1): [0, 2], ("fox", 2): [0, 1], ("i", 2): [1], ("x", 2): [2]}


def test_documents_are_parsed_once(spark):
    texts = ['{"a": {"b": "5"}, "t": true, "n": 1.5, "l": ["x", 1]}', '{"a": {"b": 5}, "t": "true", "n": "1.5", "l": [["x"]]}', '{"a": "b"}', "{", None, "[1]", '{"n": 123456789012345678901234567890}']
    docs = DOC.parse(spark.createDataFrame(enumerate(texts), "i int, text string"), "text")
    asked = docs.where(DOC.kind("doc").isNotNull() | F.col("doc").isNull()).select("i", DOC.has_string("doc", "$.a.b", "5"), DOC.is_true("doc", "$.t"), DOC.number("doc", "$.n"), DOC.holds_string("doc", "$.l", "x"), DOC.kind("doc", "$.a"))
    rows = [tuple(r)[1:] for r in asked.orderBy("i").collect()]
    assert rows[0][:4] == (True, True, 1.5, True) and rows[1][:4] == (False, False, None, False)
    assert rows[2:6] == [(False, False, None, False, k) for k in ("STRING", None, None, None)]
    assert rows[6][2] == pytest.approx(1.2345678901234568e29)
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    assert "n: " in DOC.schema(docs.where("i < 2"), "doc").first().schema


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot(spark):
    """All rows under one key but for a few."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 50 else f"k{i % 3}", rng.randint(0, 5_000), rng.randint(0, 40), rng.choice(("ok", "error"))) for i in range(6_000)] + [(7_000, None, 5, 6, "error"), (7_001, None, 6, 2, "ok")]
    return spark.createDataFrame(rows, "id int, k string, at int, c int, said string").repartition(5)


def test_scans_of_a_hot_key_go_by_ranges(spark, apart):
    df = hot(spark).withColumns({"end": F.col("at") + F.col("c"), "ts": F.timestamp_seconds(F.col("at"))})
    small = {"most": 100, "block": 256}
    forms = {
        "rate": lambda **k: SE.counter_rate(df, "k", "at", "c", ["id"], **k).select("id", "rate"),
        "increase": lambda **k: SE.increase(df, "k", "ts", "c", "10 minutes", ["id"], **k),
        "mean": lambda **k: SE.mean_from_counters(df, "k", "ts", "c", "id", "10 minutes", ["id"], **k),
        "errors": lambda **k: SE.recent_error_state(df, "k", "at", F.col("said") == "error", order=["id"], **k).select("id", "recent_errors", "healthy"),
        "flight": lambda **k: SE.concurrency(df, "k", "at", "end", 3, ["id"], **{x: v for x, v in k.items() if x == "most"}).select("id", "in_flight", "allowed"),
        "cdf": lambda **k: SE.cdf(df, "at", "k", **{x: v for x, v in k.items() if x == "most"}),
        "median": lambda **k: R.medians(df, "at", "k", **{x: v for x, v in k.items() if x == "most"}),
    }
    for name, f in forms.items():
        want, got = f(), f(**small)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
    # the hot key's rows are several tasks' work
    before = set(TAB.written(spark))
    blocks = SE.look_back(df, "k", ["at", "id"], 1, lambda w: {"task": F.spark_partition_id(), "n": F.lag("c").over(w)}, **small)
    assert blocks.where("k = 'hot'").select("task").distinct().count() > 3
    TAB.discard(spark, *(set(TAB.written(spark)) - before))
    assert set(TAB.written(spark)) == before


def test_folds_by_slices(spark):
    df = spark.range(1003).withColumnRenamed("id", "key")
    fold = lambda **k: sorted(map(tuple, ML.kfold(df, 5, 3, "key", **k).collect()))
    assert fold(slice_rows=20) == fold() and len(fold()) == 1000


def test_container_panels(spark):
    m, rows = {k: v[0] for k, v in REP.COUNTER_PANELS.items()} | REP.GAUGE_PANELS, []
    for i, v in enumerate((1, 4, 2, 7)):  # falls to 2: restarted
        rows += [(m["expired_prewarms"], x, "py", 128, None, 60 * i, v) for x in ("i0", "i1")]
        rows.append((m["container_starts"], "i0", None, None, "cold", 60 * i, 10 * v))
        rows.append((m["active_containers"], "i0", None, None, None, 60 * i, v))
    samples = spark.createDataFrame(rows, "metric string, instance string, kind string, memory int, containerState string, s int, value int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.panel, r.label): r.value for r in REP.container_panels(samples, "1 hour").collect()}
    assert got == {("expired_prewarms", "py 128"): 2 * (3 + 2 + 5), ("container_starts", "cold"): 30 + 20 + 50, ("active_containers", "i0"): 7}
