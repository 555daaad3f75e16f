"""Edge rows of the relational and column operators, some against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators import columns as C
from tessella.operators import ml as ML
from tessella.operators import records as REC
from tessella.operators import relational as R
from tessella.operators import series as SE
from tessella.sources import logs as LOGS
from tessella.sources import tables as TAB


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_join_many_to_many_without_missing_keys(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (nan, "c"), (None, "d")], "k double, x string")
    right = spark.createDataFrame([(1.0, "p"), (1.0, "q"), (nan, "r"), (None, "s")], "k double, y string")
    assert got(R.inner_join(left, right, "k", "k", ["x"], ["y"])) == [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")]
    assert got(R.broadcast_join(left, right, "k", "k", ["y"]).select("x", "y")) == [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")]
    assert got(R.semi_join(left, right, "k", "k").select("x")) == [("a",), ("b",)]
    assert got(C.member_flag(left, right, "k").select("x", "is_member")) == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert got(R.partitioned_join(left, right, "k", 4).select("x", "y")) == [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")]


def test_broadcast_only_small_sides(spark):
    small, large = spark.range(10), spark.range(100)
    assert "hint" in R.broadcast_limit(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in R.broadcast_limit(large, 10)._jdf.queryExecution().logical().toString().lower()


def test_group_sum_skips_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (None, 5.0)], "k int, v double")
    assert got(R.group_sum(df, "k", "v")) == [(1, 2.0), (2, 0.0)]


def test_orders_with_many_warehouses(spark):
    df = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (3, 9), (3, None)], "o int, w int")
    assert got(R.keys_with_many(df, "o", "w")) == [(2, 2)]


def test_dates_on_the_bounds_are_out(spark):
    df = spark.createDataFrame([("2002-02-01",), ("2002-02-02",), ("2002-03-31",), ("2002-04-01",), ("x",)], "d string")
    assert got(df.where("d <> 'x'").where(S.between_exclusive("d", "2002-02-01", "2002-04-01"))) == [("2002-02-02",), ("2002-03-31",)]


def test_page(spark):
    df = spark.range(10)
    order = [F.desc("id")]
    assert [r.id for r in R.page(df, order, 2, 3).collect()] == [7, 6, 5]
    assert R.page(df, order, 8, 0).count() == 2
    assert R.page(df, order, 20, 5).count() == 0
    assert R.page(df, order, 0, 0, most=4).count() == 4
    for skip, limit in ((-1, 0), (0, -1)):
        with pytest.raises(ValueError, match="negative"):
            R.page(df, order, skip, limit)


def test_concat_refuses_other_types(spark):
    with pytest.raises(ValueError, match="differ"):
        R.concat_tables([spark.range(1), spark.createDataFrame([("a",)], "id string")])


def test_positions(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).permutation(500)], "v int").repartition(7)
    assert got(R.with_positions(df, ["v"])) == got(df.select("v", F.col("v").cast("long")))
    assert got(R.slice_rows(df, 10, 13, ["v"])) == [(10,), (11,), (12,)]


values = st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_like_pandas(spark, xs):
    s = pd.Series(xs, dtype=object)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    codes, _ = pd.factorize(s)
    assert [r.code for r in C.factorize(df, "x", "i").orderBy("i").collect()] == codes.tolist()
    for keep in ("first", "last", False):
        assert [r.is_duplicate for r in C.duplicated(df, ["x"], "i", keep).orderBy("i").collect()] == s.duplicated(keep=keep).tolist()
    assert sorted(r.x for r in C.mode_all(df, "x").collect()) == sorted(s.mode().tolist())


def test_outliers_and_scaling(spark):
    df = spark.createDataFrame([(float(x), "g") for x in [1, 2, 3, 2, 1, 2, 100]], "x double, g string")
    assert R.reject_outliers(df, "x", 2).count() == 6
    assert R.reject_outliers(df, "x", 2, by="g").count() == 6
    same = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert got(ML.minmax_scale(same, ["a", "b"])) == [(0.0, None), (1.0, None)]


def test_medians_and_cdf(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.integers(0, 40, 301)] + [None]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(x)], "x double, g int").repartition(5)
    s = pd.DataFrame({"x": x, "g": [i % 3 for i in range(302)]})
    assert R.medians(df, "x").first()[0] == s.x.median()
    assert {r.g: r["median"] for r in R.medians(df, "x", "g").collect()} == s.groupby("g").x.median().to_dict()
    assert R.medians(df.limit(0), "x").first()[0] is None
    want = {v: (s.x <= v).sum() / 301 for v in s.x.dropna()}
    assert {r.x: r["cdf"] for r in SE.cdf(df.select("x"), "x").collect()} == pytest.approx(want)


def test_read_dsv(spark, tmp_path):
    (tmp_path / "a_1.dat").write_text("1|x|2.50|\n2||-|\n")
    (tmp_path / "a_2.dat").write_text("-|y||\n")
    rows = got(TAB.read_dsv(spark, str(tmp_path / "a_*.dat"), "k int, s string, v decimal(7,2)"))
    assert [(r[0], r[1], None if r[2] is None else float(r[2])) for r in rows] == [(1, "x", 2.5), (2, None, None), (None, "y", None)]


def test_bench_json_layouts(spark):
    split = '{"1": {"tput": [{"rd": 5.0, "wr": 6.0}], "lat": [{"2048": {"rd": 0.1}}]}}'
    points = '{"2": [{"tput": {"get": 7.0}}, {"lats": {"64": {"get": 0.2}}}]}'
    tput, lat = TAB.flatten_bench_json(spark.createDataFrame([(split,)], "value string"))
    assert got(tput) == [(1, "rd", 5.0), (1, "wr", 6.0)] and got(lat) == [(1, "rd", 2048, 0.1)]
    tput, lat = TAB.flatten_bench_json(spark.createDataFrame([(points,)], "value string"), "points")
    assert got(tput) == [(2, "get", 7.0)] and got(lat) == [(2, "get", 64, 0.2)]


def test_resource_line(spark):
    line = "[2021-12-14T10:45:02.917Z] x ({CPU: 96.0 | MEM: 98304MB | STORAGE: 196608MB},{CPU: 48.5 | MEM: 1MB | STORAGE: 2MB},{CPU: 3.0 | MEM: 4MB | STORAGE: 5MB})"
    rows = got(LOGS.parse_resource_log(spark.createDataFrame([(line,), ("12 other",)], "value string")))
    assert rows == [(1639478702917, 96, 98304, 196608, 48, 1, 2, 3, 4, 5)]


def test_markers(spark):
    df = spark.createDataFrame([("[t] [#tid_a] [#tid_b] [marker:s:12:x]",), ("[#tid_a] [marker:s:7]",), ("none",)], "value string")
    assert got(df.select(S.transaction_id("value"), S.transaction_id("value", 1), S.marker_millis(S.marker("value")))) == [("#tid_b", "#tid_a", 12), (None, "#tid_a", 7), (None, None, None)]


def test_stage_latency_last_line_wins(spark):
    df = spark.createDataFrame([("t", "a", 5, 1), ("t", "a", 9, 2), ("t", "b", 12, 3), ("t", "c", 1, 4), ("u", "b", 3, 1)], "tid string, stage string, ms long, n int")
    assert got(SE.stage_latencies(df, "tid", "stage", "ms", "n", [("a", "b"), ("b", "c"), ("a", "d")])) == [("t", "a->b", 3)]


def test_counter_restart(spark):
    df = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, i), float(v)) for i, v in enumerate([10, 15, 3, 4])], "k string, ts timestamp, c double")
    assert [r.increase for r in SE.increase(df, "k", "ts", "c", "1 hour").collect()] == [9.0]


def test_result_codes(spark):
    df = spark.createDataFrame([('{"error": {"statusCode": 418}, "statusCode": 1}',), ('{"statusCode": 204}',), ('{"statusCode": "x"}',), ("{}",), (None,)], "r string")
    assert [r[0] for r in df.select(S.result_status_code("r")).collect()] == [418, 204, 400, None, None]


def _acts(spark):
    ann = lambda **k: list(k.items())
    rows = [
        ("ns", "a", "s", "1", 100, 200, None, (0, '{"x":1}', 3), ["l"], "1", True, ann(path="ns/a", kind="python"), None),
        ("ns", "a", "s", "2", 200, 0, None, (1, "oops", 3), ["l"], "1", True, ann(path="ns/pkg/a", kind="sequence"), None),
        ("ns", "b", "s", "3", 300, 350, None, (3, "{}", 3), ["l"], "1", True, ann(path="ns/b", binding="ns/bound"), 7),
        ("other", "a", "s", "4", 300, 301, None, (2, "{}", 3), ["l"], "1", True, ann(), None),
    ]
    return spark.createDataFrame(rows, REC.ACTIVATION)


def test_activation_lists(spark):
    acts = _acts(spark)
    ids = lambda df: [r.activationId for r in df.collect()]
    assert ids(REC.list_activations(acts, "ns")) == ["3", "2", "1"]
    assert ids(REC.list_activations(acts, "ns", since=100, upto=200)) == ["2", "1"]
    assert ids(REC.list_activations(acts, "ns", skip=5)) == []
    assert ids(REC.list_activations(acts, path="ns/pkg/a")) == ["2"]
    assert ids(REC.list_activations(acts, path="ns/bound/b")) == ["3"]
    assert ids(REC.list_activations(acts, path="ns/b")) == [] and ids(REC.list_activations(acts, path="ns/a")) == ["1"]
    odd = acts.where("activationId = '1'").select(F.explode(F.array(F.struct(F.lit(None).cast("string").alias("s"), F.lit("x/y").alias("m")), F.struct(F.lit("x").alias("s"), F.lit("y").alias("m")))).alias("o"), "*").withColumns({"namespace": F.col("o.s"), "name": F.col("o.m")}).drop("o")
    assert ids(REC.list_activations(odd, path="x/y")) == ["1", "1"]
    assert [(r.end, r.duration, r.statusCode) for r in REC.list_activations(acts, "ns").collect()] == [(350, 7, 3), (None, None, None), (200, 100, 0)]
    assert REC.count_activations(acts, "ns", skip=2).first()[0] == 1 and REC.count_activations(acts, "ns", skip=9).first()[0] == 0
    assert ids(REC.retain(acts, 86_400_250, 1)) == ["3", "4"]
    assert {r.activationId: len(r.logs) for r in REC.strip_logs(acts, 86_400_250, 1).collect()} == {"1": 0, "2": 1, "3": 1, "4": 1}
    assert REC.get_activation(acts, "2").first().end is None
    assert REC.get_activation(acts, "1", "result").first().status == "success"


def test_index_round_trip(spark, tmp_path):
    acts = _acts(spark)
    REC.write_activations(acts, str(tmp_path / "index"))
    back = {r.activationId: r for r in REC.read_activations(spark, str(tmp_path / "index")).collect()}
    assert back["1"].response.result == '{"x":1}' and back["2"].response.result is None
    assert sorted(map(tuple, back["3"].annotations)) == [("binding", "ns/bound"), ("path", "ns/b")]


def test_index_has_few_files_however_many_namespaces(spark, tmp_path):
    one = _acts(spark).limit(1).drop("namespace", "activationId")
    names = spark.range(600).select(F.concat(F.lit("0"), F.col("id") % 300).alias("namespace"), F.col("id").cast("string").alias("activationId"))
    rows = names.union(spark.createDataFrame([(None, "none"), ("", "empty")], names.schema)).crossJoin(one)
    REC.write_activations(rows, path := str(tmp_path / "index"))
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and dict(back.dtypes)["index"] == "string"
    got_ = sorted((r.activationId, r.namespace) for r in REC.read_activations(spark, path).collect())
    assert got_ == sorted((r.activationId, r.namespace) for r in rows.collect()) and back.where("index = '07'").count() == 2
    assert "PushedFilters: [IsNotNull(index), EqualTo(index,07)]" in back.where("index = '07'")._jdf.queryExecution().executedPlan().toString()
    ranges = sorted((r.lo, r.hi) for r in back.groupBy(F.input_file_name()).agg(F.min("index").alias("lo"), F.max("index").alias("hi")).collect() if r.lo is not None)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_subjects(spark):
    subjects = spark.createDataFrame([("s1", "s1", "u1", "k1", False, [("n1", "nu", "nk"), ("n2", "u2", "k2")]), ("s2", "s2", "u9", "k9", True, [("n1", "x", "y")])], "_id string, subject string, uuid string, key string, blocked boolean, namespaces array<struct<name:string,uuid:string,key:string>>")
    limits = spark.createDataFrame([("n1/limits", 5, 0), ("n3/limits", 0, None)], "_id string, concurrentInvocations int, invocationsPerMinute int")
    found = REC.subject_identities(subjects, limits, "namespace", ("n1",)).collect()
    assert [(r.subject, r.namespace, r.concurrentInvocations) for r in found] == [("s1", "n1", 5)]
    assert [r.concurrentInvocations for r in REC.subject_identities(subjects, limits, "namespace", ("n2",)).collect()] == [None]
    assert REC.subject_identities(subjects, limits, "uuid", ("nu", "wrong")).count() == 0
    assert REC.subject_identities(subjects, limits, "uuid", ("u9", "k9")).count() == 0
    assert got(REC.blocked_namespaces(subjects, limits)) == [("n1", 2), ("n3", 1)]


def test_snapshots(spark):
    names = spark.createDataFrame([("backup_100_a",), ("backup_900_a",), ("backup_100_keep",), ("other",)], "name string")
    assert got(REC.expired_snapshots(names, 1000, 500, exclude=("keep",))) == [("backup_100_a",)]


def test_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    y = (x[:, 0] > 0.5).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double")
    folds = ML.kfold(df.limit(298), 5, 1, "id")
    assert [r[1] for r in got(folds.groupBy("fold").count())] == [59] * 5
    coef = ML.fit_logistic(df, ["a", "b", "c"], "y", epochs=60, lr=20.0)[None]
    score = ML.accuracy(ML.predict_logistic(df, ["a", "b", "c"], coef).withColumnRenamed("y", "label")).first()[0]
    assert score > 85 and not math.isnan(score)


def plain_fit(x, y, epochs, lr):
    """Full-batch descent on the squared error through the sigmoid, row by row."""
    c = [0.0] * (len(x[0]) + 1)
    for _ in range(epochs):
        g = [0.0] * len(c)
        for row, label in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-(c[0] + sum(a * b for a, b in zip(c[1:], row, strict=True)))))
            e = (label - p) * p * (1 - p)
            g = [a + e * b for a, b in zip(g, [1.0, *row], strict=True)]
        c = [a + lr * b / len(x) for a, b in zip(c, g, strict=True)]
    return c


def test_descent_is_its_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 2))
    y = (x[:, 0] + 0.2 * rng.random(60) > 0.6).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    assert np.allclose(ML.fit_logistic(df, ["a", "b"], "y", epochs=7, lr=0.9)[None], plain_fit(x.tolist(), y.tolist(), 7, 0.9))
    fold = {r.id: r.fold for r in ML.kfold(df, 5, 1, "id").collect()}
    want = []
    for f in range(5):
        c = plain_fit(*([v[i].tolist() for i in range(60) if fold[i] != f] for v in (x, y)), 7, 0.9)
        hits = [round(1 / (1 + math.exp(-(c[0] + c[1] * x[i, 0] + c[2] * x[i, 1])))) == y[i] for i in range(60) if fold[i] == f]
        want.append(100 * sum(hits) / len(hits))
    got_ = ML.cross_validate(df, ["a", "b"], "y", "id", epochs=7, lr=0.9).collect()
    assert [r.fold for r in got_] == [0, 1, 2, 3, 4, None] and np.allclose([r.accuracy for r in got_], [*want, sum(want) / 5])


def test_groups_are_applied_many_a_call(spark):
    rows = [(i % 700, float(i % 3)) for i in range(3000)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)

    def sums(frame):
        return frame.groupby("k", as_index=False).agg(n=("v", "sum")).assign(groups=frame["k"].nunique())

    out = R.group_apply(df, "k", sums, "k long, n double, groups long", several=True, rows_each=500).collect()
    assert {r.k: r.n for r in out} == {k: sum(v for j, v in rows if j == k) for k in range(700)} and len(out) == 700
    assert min(r.groups for r in out) > 50 and max(r.groups for r in out) < 300
    whole = R.group_apply(df, "k", sums, "k long, n double, groups long").where("k < 5").collect()
    assert [r.groups for r in whole] == [1] * 5
    zeros = spark.createDataFrame([(0.0, 1.0), (-0.0, 2.0)], "k double, v double")
    assert [r.n for r in R.group_apply(zeros, "k", sums, "k double, n double, groups long", several=True, rows_each=1).collect()] == [3.0]


def test_learning_takes_blocks_of_rows_and_leaves_out_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.random((5000, 3))
    y = (x[:, 0] > 0.5).astype(float)
    rows = [(i % 5, list(map(float, r)), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    gaps = [(0, None, 1.0), (0, [1.0, None, 1.0], 1.0), (0, [1.0, 1.0], 1.0), (0, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows + gaps, "f int, x array<double>, y double").repartition(4)
    parts, width = ML.blocks(df, "x", "y", "f")
    got_ = parts.collect()
    assert width == 3 and len(got_) <= 4 and sum(len(r.y) // 8 for r in got_) == 5000
    coef = ML.fit_logistic(df, "x", "y", 3, 5.0, "f", 5)
    for f in range(5):
        keep = np.arange(5000) % 5 != f
        assert np.allclose(coef[f], plain_fit(x[keep].tolist(), y[keep].tolist(), 3, 5.0))
    assert ML.fit_logistic(df.limit(0), "x", "y") == {None: [0.0]}


def test_folds_are_seeded_disjoint_and_whatever_the_slices(spark):
    df = spark.range(103)
    a, b, c = ({r.id: r.fold for r in ML.kfold(df, 5, seed, "id", slice_rows=n).collect()} for seed, n in ((1, 1), (1, 40), (2, 1)))
    assert a == b != c and len(a) == 100 and sorted(a.values()).count(0) == 20


def test_hash_buckets(spark):
    df = spark.range(4000).selectExpr("id as a", "cast(id % 3 as string) as b", "cast(null as string) as n")
    rows = df.select(S.hash_bucket(16, "a").alias("one"), S.hash_bucket(16, "a", "b").alias("two"), S.hash_bucket(16, "b", "a").alias("turned"), S.hash_bucket(16, "a", "n").alias("with_null"), S.hash_bucket(16, "b").alias("few")).collect()
    for name in ("one", "two", "turned", "with_null"):
        n = np.bincount([r[name] for r in rows], minlength=16)
        assert len(n) == 16 and ((n - 250) ** 2 / 250).sum() < 45  # even, as chi square of 15 degrees has it
    assert len({r.few for r in rows}) <= 3
    assert sum(r.one != r.two for r in rows) > 3000 and sum(r.two != r.turned for r in rows) > 3000 and [r.one for r in rows] == [r.with_null for r in rows]


def test_grouped_distribution(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2] if i % 9 else None, int(v)) for i, v in enumerate(rng.integers(0, 40, 500))]
    found = {(r.g, r.v): (r.n, r.cdf) for r in SE.cdf(spark.createDataFrame(rows, "g string, v int"), "v", "g").collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g]
        for v in set(values):
            n, share = found[g, v]
            assert n == values.count(v) and abs(share - sum(x <= v for x in values) / len(values)) < 1e-12


def test_exposition(spark):
    df = spark.createDataFrame([("m", {"b": 'q"', "a": "x"}, 2), ("n", {}, 3)], "name string, labels map<string,string>, value long")
    assert got(LOGS.format_exposition(df)) == [('m{a="x",b="q\\""} 2',), ("n 3",)]


def test_plans(spark, data):
    """The membership joins reach the scan as filters, and a query reads only the columns it needs."""
    from tessella.queries import QUERIES

    plan = QUERIES["qry2_multi_warehouse_catalog"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_linenumber" not in plan.split("== Physical Plan ==")[1]
