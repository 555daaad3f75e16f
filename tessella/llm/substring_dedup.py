"""Substring deduplication: word windows that an earlier document holds are removed, by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the smallest mixed hash of its 3-word runs, and consecutive windows of one
minimiser travel to its bucket as one packed string, the super-k-mer, of some 18 words instead of 13 a window. Equal windows
have equal minimisers and meet in one bucket, where their hashes are sorted, equal hashes are compared word by word, and the
smallest document of each window is found.

Three passes over written chunks of some 8 MB of text:

1. texts become chunks: words joined by one space, and how many bytes of distinct super-k-mers each bucket will get;
2. each chunk sends its distinct super-k-mers with the smallest and the largest document of each; a bucket answers with the
   windows that some document larger than the first has (a chunk's window has a number, its slot);
3. each chunk marks the words under such windows and puts the rest together.

Texts don't move in pass 1 and 2, and a super-k-mer that thousands of documents share leaves a chunk once. A bucket above its
bound (a minimiser that many windows share) is divided again: its windows travel one by one, dealt by the whole window's hash.
Equal windows meet there as well, and each chunk sends one once.

Defined cases: null texts and those without words have no words and lose none; texts shorter than a window lose none; rows
without doc_id lose nothing and are no earlier document; repeated rows (one doc_id) don't remove each other and lose the same
words; an empty table gives an empty result; other columns play no part. Identifiers are whole numbers; others are refused.
A task holds a chunk or a bucket, some 200 MB; a text longer than a chunk is a chunk of its own (some 30 bytes a byte of text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back
from .packing import byte_strings, chunk_numbers, gathered, mixed, pack, squeeze, unpack, unsqueeze

WINDOW, SEED_WORDS = 13, 3
CHUNK_BYTES = 1 << 23
#: Bytes of super-k-mers that a bucket is planned for; above HOT times as many it is divided again.
BUCKET_BYTES, HOT = 1 << 23, 4
#: Bytes of super-k-mers a byte of text, to plan the number of buckets.
SPREAD = 3
#: Odd multipliers, one for each place of a window; fixed by a rule.
PLACES = mixed(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
NONE = np.iinfo(np.int64).max

CHUNK = "chunk long, ids binary, known binary, ends binary, words binary, loads binary"
PART = "chunk long, bucket long, sub long, words binary, sizes binary, slots binary, low binary, high binary"
ANSWER = "chunk long, slots binary, first binary"
OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def word_offsets(words: bytes) -> np.ndarray:
    """Where words begin, and the end: each word ends in one space."""
    return np.concatenate(([0], np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1))


def _rolled(x: np.ndarray, length: int) -> np.ndarray:
    """For each start the mix of ``length`` neighbours in order."""
    n = len(x) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(length if n > 0 else 0):
        out += x[j : j + n] * PLACES[j]
    return mixed(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """For each start the smallest of ``width`` neighbours, by doubling."""
    have, w = x, 1
    while 2 * w <= width:
        have = np.minimum(have[:-w], have[w:])
        w *= 2
    return np.minimum(have[: len(have) - (width - w)], have[width - w :])


@dataclass
class Chunk:
    ids: np.ndarray
    known: np.ndarray
    ends: np.ndarray
    words: bytes

    def __post_init__(self) -> None:
        self.offsets = word_offsets(self.words)
        self.word_ends = np.searchsorted(self.offsets, self.ends)  # words up to each document's end
        self.counts = np.diff(self.word_ends, prepend=0)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(unpack(row["ids"]), unpack(row["known"]) > 0, unpack(row["ends"]), unsqueeze(row["words"]))


class SuperKmers:
    """A chunk's super-k-mers: occurrences (start, windows), the distinct ones by bucket, and the slots of their windows."""

    def __init__(self, chunk: Chunk, buckets: int):
        from xxhash import xxh64_intdigest

        n = len(chunk.doc)
        starts = np.arange(n - WINDOW + 1)
        fits = (chunk.doc[starts] == chunk.doc[starts + WINDOW - 1]) & chunk.known[chunk.doc[starts]] if n >= WINDOW else np.zeros(0, bool)
        if not fits.any():
            self.start = self.windows = self.unique = self.bucket = self.sizes = self.slot = self.low = self.high = np.zeros(0, np.int64)
            self.texts = byte_strings(b"", np.zeros(1))
            return
        codes = byte_strings(chunk.words, chunk.offsets).dictionary_encode()
        hashes = np.fromiter((xxh64_intdigest(w) for w in codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))[codes.indices.to_numpy()]
        least = _least(_rolled(hashes, SEED_WORDS), WINDOW - SEED_WORDS + 1)
        at = np.flatnonzero(fits)
        first = np.concatenate(([True], (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])))
        self.start = at[first]
        self.windows = np.diff(np.concatenate((np.flatnonzero(first), [len(at)])))
        a, b = chunk.offsets[self.start].tolist(), chunk.offsets[self.start + self.windows + WINDOW - 1].tolist()
        found = pa.array([chunk.words[x:y] for x, y in zip(a, b, strict=True)], pa.large_binary()).dictionary_encode()
        of = found.indices.to_numpy()
        m = len(found.dictionary)
        some = np.empty(m, np.int64)
        some[of[::-1]] = np.arange(len(of))[::-1]  # the first occurrence of each
        bucket = (mixed(least[self.start[some]]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        self.unique = place[of]  # of each occurrence, which distinct super-k-mer it is
        self.texts, self.bucket, self.sizes = found.dictionary.take(pa.array(order)), bucket[order], self.windows[some][order]
        self.slot = np.cumsum(self.sizes) - self.sizes
        doc = chunk.ids[chunk.doc[self.start]]
        self.low, self.high = np.full(m, NONE), np.full(m, -NONE - 1)
        np.minimum.at(self.low, self.unique, doc)
        np.maximum.at(self.high, self.unique, doc)

    def loads(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and the bytes for each."""
        size = np.diff(self._ends())
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return self.bucket[at], np.add.reduceat(size, at) if len(at) else at

    def _ends(self) -> np.ndarray:
        return np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset : self.texts.offset + len(self.texts) + 1]

    def parts(self, number: int, split: dict[int, int]) -> Iterator[dict]:
        """Rows of PART. split: into how many parts a bucket is divided."""
        if not len(self.bucket):
            return
        ends, data = self._ends(), self.texts.buffers()[2]
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(self.bucket)], strict=True):
            bucket, words = int(self.bucket[lo]), data.slice(int(ends[lo]), int(ends[hi] - ends[lo])).to_pybytes()
            size, slot, low, high = self.sizes[lo:hi], self.slot[lo:hi], self.low[lo:hi], self.high[lo:hi]
            if bucket not in split:
                yield _part(number, bucket, 0, words, size, slot, low, high)
                continue
            w = Windows(words, size)
            slots, low, high = slot[w.item] + w.nth, low[w.item], high[w.item]
            texts = pa.array([words[a:b] for a, b in zip(w.offsets[w.at].tolist(), w.offsets[w.at + WINDOW].tolist(), strict=True)], pa.large_binary())
            sub = (w.by_text() % np.uint64(split[bucket])).astype(np.int64)
            for s in np.unique(sub):
                mine = np.flatnonzero(sub == s)
                yield _part(number, bucket, int(s) + 1, b"".join(texts.take(pa.array(mine)).to_pylist()), np.ones(len(mine), np.int64), slots[mine], low[mine], high[mine])


def _part(chunk: int, bucket: int, sub: int, words: bytes, sizes: np.ndarray, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
    return {"chunk": chunk, "bucket": bucket, "sub": sub, "words": squeeze(words), "sizes": pack(sizes), "slots": pack(slots), "low": pack(low), "high": pack(high - low)}


class Windows:
    """All windows of packed super-k-mers: where they start, whose they are and their place in it."""

    def __init__(self, words: bytes, sizes: np.ndarray):
        self.offsets = word_offsets(words)
        self.codes = byte_strings(words, self.offsets).dictionary_encode()
        first = np.cumsum(sizes + WINDOW - 1) - (sizes + WINDOW - 1)
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.nth = np.arange(len(self.item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at = first[self.item] + self.nth

    def by_text(self) -> np.ndarray:
        """Hashes that depend on the words alone, alike in all tasks."""
        from xxhash import xxh64_intdigest

        own = np.fromiter((xxh64_intdigest(w, 1) for w in self.codes.dictionary.to_pylist()), np.uint64, len(self.codes.dictionary))
        return _rolled(own[self.codes.indices.to_numpy()], WINDOW)[self.at]

    def groups(self) -> np.ndarray:
        """A number for each window, equal for equal word sequences: sorted by hash, then word by word where hashes agree."""
        codes = self.codes.indices.to_numpy().astype(np.int64)
        keys = _rolled(mixed(codes.astype(np.uint64) + np.uint64(1)), WINDOW)[self.at]
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        run = np.cumsum(new) - 1
        first = order[new][run]
        unlike = np.zeros(len(order), bool)
        several = np.flatnonzero(~new)
        for j in range(WINDOW):
            unlike[several] |= codes[self.at[order[several]] + j] != codes[self.at[first[several]] + j]
        if unlike.any():  # different words under one hash: those runs are sorted by their words
            bad = np.flatnonzero(np.isin(run, run[unlike]))
            rows = codes[self.at[order[bad]][:, None] + np.arange(WINDOW)]
            _, kind = np.unique(rows, axis=0, return_inverse=True)
            run = run.copy()
            run[bad] = run[-1] + 1 + kind.ravel()
        out = np.empty(len(order), np.int64)
        out[order] = run
        return out


def _chunks(text_at: str, id_at: str, buckets: int, chunk_bytes: int):  # noqa: ANN202
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = chunk_numbers()
        for batch in gathered(batches, text_at, chunk_bytes):
            texts = [b" ".join(t.split()) + b" " if t and not t.isspace() else b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            ids = batch.column(id_at)
            chunk = Chunk(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), np.cumsum([len(t) for t in texts]), b"".join(texts))
            where, load = SuperKmers(chunk, buckets).loads()
            row = {"chunk": next(numbers), "ids": pack(chunk.ids), "known": pack(chunk.known), "ends": pack(chunk.ends), "words": squeeze(chunk.words), "loads": pack(np.stack((where, load)).ravel())}
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(CHUNK))
        give_back()

    return make


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to the loads of buckets, one row for each bucket of a task's chunks."""
    sums: dict[int, int] = {}
    for batch in batches:
        for data in batch.column("loads").to_pylist():
            where, load = unpack(data).reshape(2, -1)
            for b, n in zip(where.tolist(), load.tolist(), strict=True):
                sums[b] = sums.get(b, 0) + n
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(sums), pa.int64()), "load": pa.array(list(sums.values()), pa.int64())})


def _send(buckets: int):  # noqa: ANN202
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                split = {x["bucket"]: x["subs"] for x in row.get("split") or ()}
                rows, size = [], 0
                for part in SuperKmers(Chunk.of(row), buckets).parts(row["chunk"], split):
                    rows.append(part)
                    size += len(part["words"])
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(PART))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(PART))
        give_back()

    return send


def _answer(parts: pa.Table) -> pa.Table:
    """A bucket's parts to the slots whose window starts in a document smaller than their largest, and that first document."""
    rows = parts.to_pylist()
    sizes = [unpack(r["sizes"]) for r in rows]
    low = np.concatenate([unpack(r["low"]) for r in rows])
    high = np.concatenate([unpack(r["high"]) for r in rows]) + low
    slots = np.concatenate([unpack(r["slots"]) for r in rows])
    w = Windows(b"".join(unsqueeze(r["words"]) for r in rows), np.concatenate(sizes))
    group = w.groups()
    first = np.full(int(group.max()) + 1, NONE)
    np.minimum.at(first, group, low[w.item])
    hit = np.flatnonzero(first[group] < high[w.item])
    row = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])[w.item[hit]]
    out = []
    for r in np.unique(row).tolist():
        mine = hit[row == r]
        out.append({"chunk": rows[r]["chunk"], "slots": pack(slots[w.item[mine]] + w.nth[mine]), "first": pack(first[group[mine]])})
    return pa.Table.from_pylist(out, schema=_arrow(ANSWER))


def _removed(chunk: Chunk, answers: list[dict], buckets: int) -> np.ndarray:
    """Which words of the chunk go."""
    n = len(chunk.doc)
    if not answers:
        return np.zeros(n, bool)
    k = SuperKmers(chunk, buckets)
    first = np.full(int(k.sizes.sum()), NONE)
    for a in answers:
        first[unpack(a["slots"])] = unpack(a["first"])
    item = np.repeat(np.arange(len(k.start)), k.windows)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(k.windows) - k.windows, k.windows)
    at = k.start[item] + nth
    at = at[first[k.slot[k.unique[item]] + nth] < chunk.ids[chunk.doc[at]]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _kept(buckets: int):  # noqa: ANN202
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                gone = _removed(chunk, row["answers"] or [], buckets)
                length = np.diff(chunk.offsets)
                text = np.frombuffer(chunk.words, np.uint8)[np.repeat(~gone, length)].tobytes()
                ends = np.concatenate(([0], np.cumsum(np.where(gone, 0, length))))[chunk.word_ends]
                kept = [text[a : max(a, b - 1)].decode() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                base = np.repeat(chunk.word_ends - chunk.counts, chunk.counts)
                same = np.concatenate(([False], chunk.doc[1:] == chunk.doc[:-1])) if len(gone) else gone
                start = np.flatnonzero(gone & ~(np.concatenate(([False], gone[:-1])) & same))
                stop = np.flatnonzero(gone & ~(np.concatenate((gone[1:], [False])) & np.concatenate((same[1:], [False]))))
                of = np.searchsorted(start, np.concatenate(([0], chunk.word_ends)))
                spans = pa.StructArray.from_arrays([pa.array(start - base[start], pa.int64()), pa.array(stop + 1 - base[stop], pa.int64())], ["start", "end"])
                yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64(), mask=~chunk.known), pa.array(chunk.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans), pa.array(kept, pa.string())], schema=kind)
        give_back()

    return keep


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, spans (of removed words, from word number to word number, end exclusive) and kept, the
    words that stay, joined by one space. ``common.discard(spark, *common.written(spark))`` frees the chunks once that is stored."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is {docs.schema[doc_id].dataType.simpleString()}; documents are ordered by whole numbers")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-SPREAD * size // bucket_bytes))
    chunks = cut(docs.mapInArrow(_chunks("text", "doc_id", buckets, chunk_bytes), CHUNK), "chunks")
    loads = chunks.select("loads").mapInArrow(_spread, "bucket long, load long").groupBy("bucket").agg(F.sum("load").alias("load"))
    hot = loads.where(F.col("load") > HOT * bucket_bytes).select("bucket", F.ceil(F.col("load") / bucket_bytes).alias("subs"))
    hot = cut(hot, "hot")
    sent = chunks.drop("loads")
    if not hot.isEmpty():
        touched = chunks.select("chunk", F.explode(_bucket_list("loads")).alias("bucket")).join(hot, "bucket")
        touched = cut(touched.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "subs")).alias("split")), "split")
        sent = sent.join(touched, "chunk", "left")
    parts = sent.mapInArrow(_send(buckets), PART)
    answers = cut(parts.groupBy("bucket", "sub").applyInArrow(_answer, ANSWER), "answers")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("slots", "first")).alias("answers"))
    return chunks.drop("loads").join(by_chunk, "chunk", "left").mapInArrow(_kept(buckets), OUT)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bucket_list(loads: pd.Series) -> pd.Series:
    return loads.map(lambda x: unpack(x).reshape(2, -1)[0])
