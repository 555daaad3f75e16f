import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import simhash as S

from .conftest import ROWS


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for i, x in zip(ids, label, strict=True):
        groups.setdefault(x, []).append(i)
    return [min((i for i in groups[x] if i is not None), default=None) for x in label]


def check(rows, found):
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip(map(str, ids), (f"{f:016x}" for f in fps), map(str, plain_components(ids, fps)), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def query(docs):
    return S.near_duplicates(docs).select("doc_id", S.hex_fingerprint().alias("fingerprint"), "component_id").collect()


def test_odd_rows(odd):
    check(ROWS, query(odd))


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(docs.select("doc_id", "text").collect(), query(docs))


def test_empty(empty):
    assert query(empty) == []
    assert S.deduplicate(empty).columns == empty.columns and S.deduplicate(empty).count() == 0


def test_one_of_each_group_stays(odd):
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns
    # 2, 3, 6 and the row without id and text have fingerprint 0
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 4, 5, 7, -8, None]))
    assert kept.where("doc_id is null").first().text.startswith("no id")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 12), st.booleans())
def test_bit_sliced_links(seed, n, flips, dense):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < n:
        x = base if rng.random() < 0.5 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, flips):
            x ^= 1 << int(b)
        fps.add(x)
    f = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    i, j = np.nonzero(near)
    want = S._labels(n, i, j, np.arange(n))
    before = S.DENSE
    S.DENSE = 16 if dense else before
    try:
        assert (S.link(f, np.zeros(n, np.int64), list(range(64))) == want).all()
    finally:
        S.DENSE = before


def test_tables_cover_all_pairs_within_the_radius():
    for a in range(64):
        for b in range(64):
            x = (1 << a) | (1 << b)
            assert any(x & (S._mask(t) & (1 << 64) - 1) == 0 for t in range(len(S.TABLES)))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(1000, 1001 + i) for i in range(200)]
    found = {r.node: r.root for r in S.connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 51)}, **{1001 + i: 1000 for i in range(200)}}


def test_rounds_are_bounded(spark):
    with pytest.raises(RuntimeError):
        S.connected_components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), rounds=1)
