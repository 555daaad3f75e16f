import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import ball_tree as B
from tessella.llm import license_scan as LS
from tessella.llm import registry
from tessella.llm.license_texts import KNOWN, texts


def brute(rows, k, scale=B.SCALE):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i is not None and i % 100 == 0}):
        qv = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i is None, i or 0) for i, v in good if i != q and len(v) == len(qv))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k])]
    return out


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(0, 450)]
    rows += [(500, None), (600, []), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan")] * 4), (900, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1000, [1.0, 2.0]), (1001, [1.0, 2.0])]
    rows += [rows[7], rows[7], rows[100], (5000, rows[0][1]), (5001, rows[0][1]), (None, rows[0][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as v", "1 as width", "2 as score")
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0).collect()), key=str) == sorted(brute(rows, 10), key=str)
    assert B.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert sorted(map(tuple, B.top_k(df.where("vec_id < 3"), F.col("vec_id") % 100 == 0).collect())) == sorted(brute(rows[:3], 10))


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(int(i * 50), rng.normal(size=3).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(B, "HELD_BYTES", 6 * 24)
    got = B.top_k(df, F.col("vec_id") % 100 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 3))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one pass over the candidates for all blocks


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 6), st.integers(1, 12))
def test_branch_and_bound_loses_nothing(seed, n, width, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, width)).astype(np.float64)  # many ties
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    q = rng.integers(-3, 4, (5, width)).astype(np.float64)
    qid = np.arange(5)
    top = B.TopK(5, k)
    place = np.argsort(np.argsort(ids))
    for part in np.array_split(np.arange(n), 3):
        if len(part):
            B.Shard(ids[part], np.ones(len(part), bool), place[part], x[part]).search(qid, q, top)
    for i in range(5):
        want = sorted((-(q[i] @ v), c) for c, v in zip(place, x, strict=True) if ids[np.flatnonzero(place == c)[0]] != qid[i])[:k]
        got = [(-s, c) for s, c in zip(top.score[i], top.place[i], strict=True) if s > B.NONE]
        assert got == want


def test_products_beyond_float64(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-(2**18), 2**18, 8) + rng.integers(0, 1024, 8) / 1024).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(brute(rows, 10))


def test_rounds_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-40, 41, 5).astype(float).tolist()) for i in range(1500)] + [(7, [40.0] * 5)] * 40 + [(None, [39.0] * 5)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = sorted(brute(rows, 10), key=str)
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0).collect()), key=str) == want
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0, pilot_rows=20, grow=4).collect()), key=str) == want


def test_tasks_hand_on_few_rows(spark):
    """With rounds a query's rows don't grow with the number of tasks."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), rng.normal(size=4).tolist()) for i in range(4000)], "vec_id long, embedding array<double>").repartition(40)
    v = B.integer_vectors(df).select("vec_id", "v").persist()
    asked = v.where("vec_id % 100 = 0")
    found = B._search(v, asked, 4, 4000, 40, 8192.0, 10, 40, 4)
    assert found.count() < 40 * 10 * 12
    v.unpersist()


def test_large_components_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=3) * (1e12 if i % 7 == 0 else 1)).tolist()) for i in range(250)] + [(300, [1e300, -1e300, 5.0]), (301, [1e300, 1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    clipped = []
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q, qv in ((i, v) for i, v in good if i % 100 == 0):
        found = sorted((-max(-most, min(most, sum(a * b for a, b in zip(qv, v, strict=True)))), i) for i, v in good if i != q)
        clipped += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:10])]
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(clipped)
    wide = [(int(i), rng.normal(size=4096).tolist()) for i in range(220)] + [(500, [1e6] + [0.0] * 4095)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, B.top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(brute(wide, 10))


def test_vectors_same_as_sql(same_as_sql):
    same_as_sql(registry.op8_ball_tree, registry.ORACLE_SQL["op8_ball_tree"])


def test_licenses_same_as_sql(same_as_sql):
    same_as_sql(registry.op6_license_scan, registry.ORACLE_SQL["op6_license_scan"])


def test_license_forms(spark, odd, empty):
    shouted = "MIT Licence\n\nCopyright (c) 2020 Somebody\nAll rights reserved.\n\n" + dict(KNOWN)["MIT"].replace("merge", "MERGE").replace(" sublicense", " sub-license").replace("\n", "\r\n   ")
    docs = spark.createDataFrame([(1, shouted), (2, dict(KNOWN)["MIT"] + " more"), (3, None), (4, "..."), (5, dict(KNOWN)["ISC"]), (6, "released under the  MIT LICENSE"), (7, "Copyright 1999 x")], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in LS.scan(docs, LS.known_licenses(spark)).collect()}
    assert found == {1: "MIT-titled", 2: None, 3: None, 4: None, 5: "ISC", 6: None, 7: None}
    clash = odd.selectExpr("*", "text as license_id", "text as digest", "text as known")
    assert LS.scan(clash, LS.known_licenses(spark)).count() == odd.count()
    assert LS.scan(empty, LS.known_licenses(spark)).count() == 0
    twice = spark.createDataFrame([("b", "some text"), ("a", "Some, TEXT!"), ("c", None)], "license_id string, text string")
    assert [r.license_id for r in LS.scan(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), twice).collect()] == ["a"]


def test_every_known_licence_is_found_in_disguise(spark, data, duck, monkeypatch):
    import textwrap

    def disguise(i, text):
        # long texts have copyright lines of their own inside paragraphs
        wrapped = "\n".join(textwrap.fill(p, 60 + i % 30) for p in text.split("\n\n")) if len(text) < 5000 else text.replace("\n", " \n\t ")
        lines = ["", f"  Copyright {1990 + i} The Holder", f"* (c) {2000 + i} Other Holder", "© someone", "All Rights Reserved."]
        out = ("\n".join(lines[: i % 5 + 1]) + "\n\n" + wrapped).replace(" license", " licence").replace("organization", "organisation").replace("http:", "https:")
        return out.upper() if i % 2 else out.replace(". ", ".\r\n\t" if len(text) < 5000 else " .\t")

    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    rows = [(i, disguise(i, t), "en", "s", 1) for i, (_, t) in enumerate(texts())] + [(1000 + i, t[:-20], "en", "s", 1) for i, (_, t) in enumerate(texts()) if len(t) > 100]
    docs = spark.createDataFrame(rows, schema)
    want = {i: k for i, (k, _) in enumerate(texts())}
    got = LS.scan(docs, LS.known_licenses(spark))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.license_id for r in got.collect()} == {r[0]: want.get(r[0]) for r in rows}
    c = duck.cursor()
    c.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {r[0]: r[1] for r in c.execute(f"SELECT doc_id, license_id FROM ({registry.ORACLE_SQL['op6_license_scan']})").fetchall()} == {r[0]: want.get(r[0]) for r in rows}
    monkeypatch.setattr(LS, "BROADCAST_ROWS", 3)
    assert {r.doc_id: r.license_id for r in LS.scan(docs, LS.known_licenses(spark)).collect()} == {r[0]: want.get(r[0]) for r in rows}


def test_long_licences_are_known():
    long = {k for k, t in texts() if len(t) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= long and len(dict(texts())) == len(texts())
    assert all(len(t) > 400 for _, t in texts())


def test_a_folder_of_licences(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"L-{i}.txt").write_text(f"The Licence number {i}.\n\nCopyright (c) 2001 A\n\n" + "\n".join(f"Term {j} of {i}: do as you like." for j in range(400)))
    known = LS.read_licenses(spark, f"file://{tmp_path}")
    text = (tmp_path / "L-7.txt").read_text()
    docs = spark.createDataFrame([(1, text.upper().replace("2001 A", "2020 Z")), (2, text.replace("Term 399", "Term 398"))], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in LS.scan(docs, known).collect()} == {1: "L-7", 2: None}
