import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontaminate as D
from tessella.llm import registry

from .conftest import ROWS

ITEMS = [(10, "quick brown fox jumps over"), (10, "quick brown fox jumps over"), (9, "the lazy dog the quick brown fox jumps over the lazy dog the"), (11, None), (12, ""), (None, "some words"), (13, "!!!"), (2, "words ANYWAY")]


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = plain(t)
        for a in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for doc_id, t in docs:
        w, hit, found = plain(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        names = ",".join(sorted("" if x is None else str(x) for x in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, rows, **how):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.report(D.find_passages(docs, bench, **how)).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == brute([(r[0], r[1]) for r in rows], ITEMS)


def test_odd_rows(spark, odd):
    check(spark, odd, ROWS)


def test_blocks_of_phrases(spark, odd):
    check(spark, odd, ROWS, block_words=4)
    folder, blocks = D.write_blocks(spark.createDataFrame(ITEMS, "item_id long, text string"), block_words=1)
    assert len(blocks) > 2
    found = D.find_passages(odd, spark.createDataFrame(ITEMS, "item_id long, text string"), block_words=1)
    assert str(found._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1  # one pass over the texts for all blocks


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    words = [f"w{i * i % 37}" for i in range(300)]
    bench = spark.createDataFrame([("long", ", ".join(words)), ("short", "w1 w2")], "item_id string, text string")
    pieces = D.phrase_pieces(bench, piece=7).collect()
    assert max(len(r.words) for r in pieces) <= 7 + 9 and sum(r.n for r in pieces) == 291 + 1
    windows = {tuple(r.words[i : i + 10]) for r in pieces if r.item == "long" for i in range(len(r.words) - 9)}
    assert windows == {tuple(words[i : i + 10]) for i in range(291)}
    docs = spark.createDataFrame([(1, "x " + " ".join(words[40:55]) + " y"), (2, "w1; W2"), (3, " ".join(words[:9]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.report(D.find_passages(docs, bench, block_words=50)).collect()}
    assert got[1][0] >= 15 and got[2] == (2, 1) and got[3] == (0, 0)


def test_identifiers_of_any_type(spark, odd):
    bench = spark.createDataFrame([("b-1", "quick brown fox jumps over"), ("a,2", "quick brown"), (None, "lazy dog")], "item_id string, text string")
    got = D.report(D.find_passages(odd, bench)).where("doc_id = 4").first()
    assert (got.n_items, got.items_sha256) == (3, hashlib.sha256(b",a,2,b-1").hexdigest())


def test_empty(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_passages(empty, bench, out="__h").count() == 0
    assert not any(r.contaminated for r in D.report(D.find_passages(odd, bench.where("false"))).collect())


def test_same_as_sql(same_as_sql):
    same_as_sql(registry.op10_decontaminate, registry.ORACLE_SQL["op10_decontaminate"])


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Ah, quick BROWN fox; jumps-over the end. Quick brown fox jumps over!"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = D.find_passages(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert [r.text for r in D.remove_spans(found).orderBy("doc_id").collect()] == ["Ah,  the end. !", "clean", None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_index_finds_every_occurrence(strings, patterns):
    text = np.array([x for s in strings for x in [*s, 0]], np.int32)
    index = D.FMIndex(text)
    width = max(map(len, patterns))
    p = np.zeros((len(patterns), width), np.int64)
    for i, x in enumerate(patterns):
        p[i, width - len(x) :] = x
    low, high = index.search(p, np.array([len(x) for x in patterns]))
    flat = text.tolist()
    for i, x in enumerate(patterns):
        want = [a for a in range(len(flat)) if flat[a : a + len(x)] == x]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want
