"""Streaming functions over a file source give what their batch forms give."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.sources import event_log as L
from tessella.streaming import events as EV
from tessella.streaming import health as HL
from tessella.streaming import sinks as SK


def _take(df, path, mode="append"):
    EV.write_stream(df, str(path / "out"), f"file://{path}/offsets", mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(path / "out"))


def test_counters_match_batch(spark, data, tmp_path):
    raw = Q.event_stream_rows(spark, data)
    raw.repartition(1).write.text(str(tmp_path / "in"))
    # a last event far ahead moves the watermark past all windows; its own windows stay open
    (tmp_path / "in" / "zz.txt").write_text('{"source":"s","body":{"name":"z/a","activationId":"z"},"subject":"s","namespace":"z","userId":"u","eventType":"Activation","timestamp":4102444800000}\n')
    batch = EV.with_watermark(EV.parse_events(raw))
    for i, f in enumerate((EV.global_counters, EV.action_counters, EV.limit_counters)):
        stream = EV.with_watermark(EV.parse_events(EV.read_events(spark, {"format": "text", "path": str(tmp_path / "in")})), "3000 days")
        (tmp_path / str(i)).mkdir()
        out = f(stream)
        name = f"counted{i}"
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        found = spark.table(name).where("window_start < '2090-01-01'")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, f(batch).collect()), key=str)


def test_bad_events_go_aside(spark):
    raw = spark.createDataFrame([("{",), ('{"body": {"metricName": "ConcurrentRateLimit", "metricValue": 1}, "namespace": "n", "timestamp": 1}',), ('{"body": {"name": "n/a", "duration": -5, "initTime": 3, "statusCode": 0}, "namespace": "m", "timestamp": 2}',)], "value string")
    rows = EV.parse_events(raw).orderBy("ts").collect()
    assert [(r.namespace, r.duration, r.initTime, r.metricName) for r in rows] == [("n", None, None, "ConcurrentRateLimit"), ("n", 0, 3, None)]
    assert EV.bad_events(raw).count() == 1


def test_pairs_on_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    begin = spark.createDataFrame([("a", t0), ("b", t0)], "id string, ts timestamp")
    finish = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=3)), ("c", t0), ("b", t0 + dt.timedelta(hours=5))], "id string, ts timestamp")
    begin.write.parquet(str(tmp_path / "b"))
    finish.write.parquet(str(tmp_path / "f"))
    read = lambda n: spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / n))
    out = _take(EV.pair_begin_finish(read("b"), read("f")), tmp_path)
    assert [(r.id, r.duration_ms) for r in out.collect()] == [("a", 3000)]


def test_health():
    h = HL.Health()
    seen = h.see(0, "ping")
    for i in range(3):
        seen += h.see(100 + i, "success")
    for i in range(6):
        seen += h.see(200 + i, "error")
    for i in range(10):
        seen += h.see(300 + i, "timeout")
    seen += h.silence(20_000)
    seen += h.see(30_000, "ping")
    assert [s for _, s in seen] == ["healthy", "unhealthy", "healthy", "unresponsive", "offline", "unhealthy"]


def _plain_health(rows, now):
    """Changes of state that a worker's rows before ``now`` bring, in event time."""
    out = []
    for w in sorted({r[0] for r in rows}):
        h = HL.Health()
        for _, ms, kind in sorted(r for r in rows if r[0] == w and r[1] < now):
            out += [(w, *x) for x in h.see(ms, kind)]
        out += [(w, *x) for x in h.silence(now)]
    return sorted(out)


def test_health_is_alike_however_rows_are_dealt(spark, tmp_path):
    rng = random.Random(2)
    rows, ms = [], 1_700_000_000_000
    for _ in range(600):
        ms += rng.choice((50, 900, 4000, 20_000))
        rows.append((rng.choice("uvw"), ms, rng.choice(("ping", "ping", "success", "error", "error", "timeout"))))
    schema = "worker string, ts timestamp, kind string"
    # parts by time, and inside a part in any order
    for name, cuts, slot in (("one", [600], 60_000), ("four", [100, 250, 400, 600], 7_000)):
        base, low = tmp_path / name, 0
        for high in cuts:
            part = [(w, dt.datetime.fromtimestamp(t / 1000, dt.UTC), k) for w, t, k in rows[low:high]]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(base / "in"))
            low = high
            with HL.rocksdb_state(spark):
                stream = HL.health_changes(spark.readStream.schema(schema).parquet(str(base / "in")), slot_ms=slot)
                SK.drain(stream.writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / "offsets")))
        got = spark.read.schema(HL.OUT).parquet(str(base / "out")).select("worker", F.unix_millis("ts"), "state").collect()
        assert sorted(map(tuple, got)) == _plain_health(rows, rows[-1][1] - 5000)
    assert len(got) > 50


def test_health_holds_no_batch(monkeypatch):
    """Rows are put into their slots a few at a time, while the batch is still being read."""

    class State:
        def __init__(self):
            self.kept, self.most = {}, 0

        def get(self):
            return None

        exists = clear = update = lambda self, *x: None

        def getValue(self, k):  # noqa: N802
            return self.kept.get(k)

        def updateValue(self, k, v):  # noqa: N802
            self.kept[k] = v

    class Handle:
        getValueState = getMapState = lambda self, *x: State()  # noqa: N815
        registerTimer = lambda self, at: None  # noqa: N815

    monkeypatch.setattr(HL, "HELD", 10)
    p = HL.HealthProcessor(1000)
    p.init(Handle())
    seen = []

    def rows():
        for i in range(100):
            seen.append(sum(v[0].count(":") for v in p.waiting.kept.values()))
            yield {"ms": i, "kind": "ping"}

    list(p.handleInputRows(("w",), rows(), None))
    assert [i - n for i, n in enumerate(seen)] == [i % 10 for i in range(100)]


def test_event_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert L.Segments(log).ends() == {} and L.read_log(spark, log).count() == 0
    first, second = [(f"a{i}", i) for i in range(50)], [(f"b{i}", i) for i in range(30)]
    L.append_events(spark.createDataFrame(first, "value string, n int"), log, 3, key=F.col("n") % 5, order=["n"])
    ends = L.Segments(log).ends()
    L.append_events(spark.createDataFrame([*second, (None, 99)], "value string, n int"), log, 3, key=F.col("n") % 5, order=["n"])
    rows = L.read_log(spark, log).collect()
    assert sorted(str(r.value) for r in rows) == sorted([v for v, _ in first + second] + ["None"])
    by = {}
    for r in rows:
        by.setdefault(r.partition, []).append((r.offset, r.value))
    for p, kept in by.items():
        assert [o for o, _ in sorted(kept)] == list(range(len(kept)))  # no gaps
        assert all(v.startswith("a") for o, v in kept if o < ends[str(p)])  # what was there keeps its place
        order = [int(v[1:]) for o, v in sorted(kept) if o < ends[str(p)]]
        assert order == sorted(order)
    found = L.Segments(log)
    parts = L.ranges(found.all(), {"0": 3}, found.ends(), 4)
    assert all(p.high - p.low <= 4 for p in parts) and sum(p.high - p.low for p in parts) == 78
    assert sum(b.num_rows for p in parts for b in L._read(log, p)) == 78
    with pytest.raises(ValueError, match="another query"):
        L.ranges(found.all(), {"0": 90}, {"0": 2}, 4)
    with pytest.raises(ValueError, match="of the"):
        L.ranges(found.all()[1:], {}, found.ends(), 4)
    with pytest.raises(ValueError, match="group"):
        L.EventLogStream({"path": log, "maxoffsetspertrigger": "5"})


def test_event_log_in_batches_over_restarts(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    batches = []
    for part in range(3):
        L.append_events(spark.range(part * 40, part * 40 + 40).select(F.col("id").cast("string").alias("value")), log, 3)
        stream = L.stream_log(spark, log, "g", 15)
        batches.append(SK.drain(SK.write_once(stream.select("value"), str(tmp_path / "out"), f"file://{tmp_path}/offsets")))
    assert batches[0] >= 3 and batches == sorted(set(batches))
    rows = SK.read_batches(spark, str(tmp_path / "out"), "value string")
    assert sorted(int(r.value) for r in rows.collect()) == list(range(120))
    assert rows.groupBy("batch").count().agg(F.max("count")).first()[0] <= 15 + 3


def test_replayed_batch_is_there_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    L.append_events(spark.range(60).select(F.col("id").cast("string").alias("value")), log, 2)
    written = []

    def break_once(batch):
        written.append(batch)
        if written.count(1) == 1 and batch == 1:
            raise RuntimeError("lost")

    writer = lambda: SK.write_once(L.stream_log(spark, log, "g", 20).select("value"), str(tmp_path / "out"), f"file://{tmp_path}/offsets", after=break_once)
    with pytest.raises(StreamingQueryException):
        SK.drain(writer())
    SK.drain(writer())
    assert written.count(1) == 2
    assert sorted(int(r.value) for r in SK.read_batches(spark, str(tmp_path / "out"), "value string").collect()) == list(range(60))


def test_texts_are_parsed_once(spark, data):
    plan = EV.parse_events(Q.event_stream_rows(spark, data)).select("namespace", "ts", "duration")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs(") == 1


def test_sketches_merge(spark):
    rows = spark.range(20_000).select(F.lit("n").alias("namespace"), F.lit("a").alias("action"), F.lit(None).cast("string").alias("metricName"), F.timestamp_millis(F.col("id") * 1000).alias("ts"), F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("duration"))
    out = EV.merged_quantiles(EV.timing_sketches(rows), "1 day").first()
    assert out.n == 20_000
    for q, v in ((0.5, out.q50), (0.9, out.q90), (0.99, out.q99)):
        assert abs(v / 10_007 - q) < 0.02
