"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside pigeonhole buckets, connected components.

A fingerprint holds 64 bits. Two fingerprints within ``RADIUS`` = 2 bits agree wholly on at least four of six segments, so
each distinct fingerprint goes into 15 buckets, one for each choice of four segments. A bucket's members agree on 42 to 44
bits; there are at most 2**22 of them, as fingerprints are distinct, whatever the number of documents: a bucket's size has
a proven bound. Members are compared bit-sliced: bit planes of 64 members a machine word, carry-save counters, and blocks
abandoned once all lanes exceed the radius. Copies share a fingerprint and are never expanded into pairs.

Defined cases: null and empty texts have fingerprint 0, linked like any other; a text of one or two words is one shingle;
repeated rows get equal results; rows without doc_id take the smallest doc_id of their component (null if it has none); an
empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, cut, discard, fresh, new_path

RADIUS = 2
SHINGLE = 3
SEED = 42
#: First bit and width of the six segments.
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(combinations(range(6), 4))
#: Buckets above this size are divided again by the bits on which their members may differ.
DENSE = 4096
#: (member, block) pairs compared at a time.
SLICE = 1 << 18


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the shingles' hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def _bits(table: int) -> list[int]:
    """Bits outside the table's segments: the only ones on which bucket members can differ."""
    return [b for i, (at, n) in enumerate(SEGMENTS) if i not in TABLES[table] for b in range(at, at + n)]


def _mask(table: int) -> int:
    m = sum(((1 << n) - 1) << at for i, (at, n) in enumerate(SEGMENTS) if i in TABLES[table])
    return m - (1 << 64) if m >> 63 else m


def _planes(fps: np.ndarray, blocks: np.ndarray, bits: list[int]) -> np.ndarray:
    """(len(bits), blocks) words: lane i of a word is that bit of the block's i-th fingerprint. blocks: (n, 64) indices, -1 for none."""
    lanes = np.where(blocks >= 0, fps[blocks], np.uint64(0))
    out = np.empty((len(bits), len(blocks)), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.packbits(((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _within(fps: np.ndarray, query: np.ndarray, block: np.ndarray, planes: np.ndarray, bits: list[int], lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query, block): which lanes of the block are within the radius, as pair numbers and lane words.

    Carry-save counters of two bits and a saturation word follow all lanes of a block at once; every four planes the pairs
    whose lanes all exceed the radius are abandoned.
    """
    live = np.arange(len(query))
    q, b = fps[query], block
    one, two, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    wanted = lanes[block]
    for i, bit in enumerate(bits):
        d = planes[i][b] ^ (np.uint64(0) - ((q >> np.uint64(bit)) & np.uint64(1)))
        carry = one & d
        one ^= d
        over |= two & carry
        two ^= carry
        if i % 4 == 3 or i == len(bits) - 1:
            beyond = over | {0: one | two, 1: two, 2: one & two}[radius]
            keep = (wanted & ~beyond) != 0
            if not keep.all():
                live, q, b, one, two, over, wanted = (x[keep] for x in (live, q, b, one, two, over, wanted))
            if not len(live):
                break
    if not len(live):
        return live, np.zeros(0, np.uint64)
    return live, wanted & ~(over | {0: one | two, 1: two, 2: one & two}[radius])


def _labels(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index reachable, by repeated minimum and pointer jumping."""
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def link(fps: np.ndarray, group: np.ndarray, bits: list[int], radius: int = RADIUS) -> np.ndarray:
    """For fingerprints sorted by group: the smallest index linked to each inside its group, directly or through others."""
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [n])))
    for s, m in zip(starts[sizes > DENSE], sizes[sizes > DENSE], strict=True):
        if len(bits) < 3 * (radius + 1):
            continue
        rows = np.arange(s, s + m)
        for part in np.array_split(np.array(bits), radius + 1):
            key = np.bitwise_and(fps[rows], np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            sub = link(fps[rows[order]], key[order], [b for b in bits if b not in part], radius)
            label = _labels(n, rows[order], rows[order][sub], label)
    small = (sizes > 1) & ((sizes <= DENSE) | (len(bits) < 3 * (radius + 1)))
    starts, sizes = starts[small], sizes[small]
    if not len(starts):
        return label
    per = -(-sizes // 64)
    of = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    for lo in range(0, len(of), 4096):  # blocks at a time
        own, k = of[lo : lo + 4096], nth[lo : lo + 4096]
        first = starts[own] + 64 * k
        width = np.minimum(64, starts[own] + sizes[own] - first)
        blocks = np.where(np.arange(64) < width[:, None], first[:, None] + np.arange(64), -1)
        lanes = np.packbits(blocks >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
        planes = _planes(fps, blocks, bits)
        count = first + width - starts[own]  # members up to the block's end; each pair is met once or, inside a block, twice
        ends = np.cumsum(count)
        for at in range(0, int(ends[-1]), SLICE):
            pair = np.arange(at, min(at + SLICE, int(ends[-1])))
            block = np.searchsorted(ends, pair, side="right")
            query = starts[own][block] + pair - (ends - count)[block]
            hit, words = _within(fps, query, block, planes, bits, lanes, radius)
            if len(hit):
                lit = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, lane = np.nonzero(lit)
                left, right = query[hit[row]], first[block[hit[row]]] + lane
                other = left != right
                if other.any():
                    label = _labels(n, left[other], right[other], label)
    return label


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, key) to links (a, b) of a spanning forest of each bucket. Holds one batch and one bucket's members."""
    kept: list[np.ndarray] = []

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in np.unique(rows[0]):
            here = rows[:, rows[0] == t]
            fps = here[2].view(np.uint64)
            new = np.concatenate(([True], here[1][1:] != here[1][:-1]))
            size = np.bincount(np.cumsum(new) - 1)
            shared = (size > 1)[np.cumsum(new) - 1]
            if not shared.any():
                continue
            here, fps = here[:, shared], fps[shared]
            label = link(fps, here[1], _bits(int(t)))
            moved = label != np.arange(len(label))
            if moved.any():
                yield pa.RecordBatch.from_pydict({"a": pa.array(here[2][moved]), "b": pa.array(here[2][label[moved]])})

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "fp")]))
        if sum(x.shape[1] for x in kept) < 200_000:
            continue
        rows = np.concatenate(kept, axis=1)
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        if not last.all():
            at = int(np.argmax(last))
            yield from done(rows[:, :at])
            rows = np.ascontiguousarray(rows[:, at:])
        kept = [rows]
    if kept:
        yield from done(np.concatenate(kept, axis=1))


def links(fingerprints: DataFrame) -> DataFrame:
    """Distinct column ``fp`` (long) to links (a, b) that connect all fingerprints within the radius of each other, by way of others or directly."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(t)).cast("long")).alias("key")) for t in range(len(TABLES))])
    rows = fingerprints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_edges, "a long, b long").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) to (node, root), root the smallest node reachable: alternating large-star and small-star, each round written to the shared folder."""
    cols = ("a", "b")
    spark = edges.sparkSession
    at = new_path(spark, "links")
    edges = cut(edges.where("a <> b").select(F.greatest(*cols).alias("a"), F.least(*cols).alias("b")).distinct(), "links", at)
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, at = at, new_path(spark, "links")
        edges = cut(small.where("a <> b").distinct(), "links", at)
        discard(spark, last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, fp (long), root (a fingerprint that names the component), component_id. Fingerprints are made once and kept in the shared folder."""
    of = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprint_udf(F.col(text)).alias("fp"))
    of = cut(of, "fingerprints")
    reps = of.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(reps.select("fp")))
    in_root = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    in_root = cut(in_root, "roots")
    least = in_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = in_root.join(least, "root").select("fp", "root", "component_id")
    return of.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp (long), component_id."""
    return classes(docs, doc_id, text).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (rows without one last), then the smallest hash of the text."""
    id_, hash_ = fresh(docs, "__kept"), fresh(docs, "__hash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = classes(docs, doc_id, text).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = rows.groupBy("root").agg(F.min(first).alias("x"), F.min_by("n", first).alias("n")).select(F.col("x.doc_id").alias(id_), F.col("x.text_hash").alias(hash_), "n")
    kept = cut(kept, "kept")
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text)) == F.col(hash_))
    once = docs.join(kept.where("n = 1"), same, "left_semi")
    again = docs.join(kept.where("n > 1"), same, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(again)


def hex_fingerprint(fp: str = "fp") -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
