"""op11 against plain Python: removed words, spans and kept texts, with many small buckets, divided ones, and all odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import substring_dedup as S
from tessella.llm.common import discard, written
from tests.conftest import DATA


def plainly(rows):
    """(doc_id, text) to (doc_id, n_words, n_removed, kept)."""
    words = [(d, t.encode().split() if t else []) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - S.WINDOW + 1) if d is not None else ():
            key = tuple(w[i : i + S.WINDOW])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - S.WINDOW + 1) if d is not None else ():
            if first[tuple(w[i : i + S.WINDOW])] < d:
                gone |= set(range(i, i + S.WINDOW))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def found(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return sorted(map(tuple, df.select("doc_id", "n_words", removed, "kept").collect()), key=str)


def test_like_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plainly(rows)
    assert sum(r[2] for r in want) > 100
    assert found(S.remove_repeats(docs)) == want
    # many chunks and buckets, all of them above their bound and divided
    before = set(written(spark))
    assert found(S.remove_repeats(docs.repartition(3), chunk_bytes=20_000, bucket_bytes=2_000)) == want
    discard(spark, *(set(written(spark)) - before))


def test_hot_minimiser_and_copies(spark):
    line = " ".join(f"w{i}" for i in range(9))  # in every document, shorter than a window
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} c{i} {line} d{i} e{i} f{i} g{i}" + (f" {passage}" if i % 3 == 0 else "")) for i in range(400)] + [(1000 + i, f"x y {passage} z") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = S.remove_repeats(docs, chunk_bytes=5_000, bucket_bytes=500)
    assert found(out) == plainly(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(S.remove_repeats(odd)) == plainly(rows)
    assert S.remove_repeats(empty).collect() == []
    with pytest.raises(TypeError):
        S.remove_repeats(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_spans_and_repeats_inside_a_document(spark):
    w = " ".join(f"v{i}" for i in range(20))
    rows = [(1, f"{w} {w}"), (2, f"start {w} middle {w}"), (2, f"start {w} middle {w}")]
    out = {(r.doc_id, tuple((s.start, s.end) for s in r.spans), r.kept) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, (), f"{w} {w}"), (2, ((1, 21), (22, 42)), "start middle")}


def test_equal_hashes_are_compared_by_words(monkeypatch):
    words = [f"q{i} " for i in range(30)]
    text = "".join(words) + "".join(words) + "".join(reversed(words))
    w = S.Windows(text.encode(), np.array([90 - S.WINDOW + 1]))
    want = w.groups()
    monkeypatch.setattr(S, "_rolled", lambda x, length: np.zeros(max(0, len(x) - length + 1), np.uint64))
    got = w.groups()
    same = lambda g: g[:, None] == g
    assert (same(want) == same(got)).all()
    assert same(want)[:18, 30:48].diagonal().all()
