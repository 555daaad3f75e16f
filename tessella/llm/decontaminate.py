"""Benchmark decontamination: an FM-index over each shard of training documents, searched for every benchmark phrase.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or a whole shorter item. A shard is a run
of up to 1,000 documents or 8 million characters. Its texts become strings over the phrases' alphabet: words that no phrase holds end a string, and
strings shorter than the shortest phrase can't hold one, so they aren't indexed. The shard's index is the Burrows-Wheeler
transform of these strings with a wavelet matrix for ranks and sampled suffix positions; backward search gives each phrase
its interval, last-to-first steps lead from its rows to sampled positions, and the occurrences merge into removal spans.

Phrases never pass through the driver. Spark cuts the items into pieces of at most ``PIECE`` windows and deals these to blocks
of about ``BLOCK_WORDS`` words by a hash; a task a block makes the table of its distinct phrases and writes it into the shared
folder. A search task reads one block at a time, some 50 bytes a word, for each shard of documents that it holds: texts are
read and split once, whatever the size of the benchmark, and the spans of all blocks are merged.

Defined cases: null and empty texts have no words and aren't contaminated; an item with null or wordless text has no window;
item identifiers may be of any type that has a text form, a null one counts as an item and as the empty string in the digest;
repeated items count once; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, file_system, new_path, portions

WINDOW = 10
#: Words of phrases in a block, about; windows of a piece at most.
BLOCK_WORDS, PIECE = 500_000, 4096
#: Every so many positions of a string, the suffix position is stored.
SAMPLE = 8

#: The same words for Spark, of text in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII bytes that aren't letters or digits end words; A-Z become a-z; bytes from 0x80 belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Hits of a document: total words, merged spans [from, to) in words, and the items whose windows occur.
HITS = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class WaveletMatrix:
    """rank(c, i): occurrences of symbol c before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.zeros, self.ones = width, [], []
        for level in range(width - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.width - 1 - level)) & 1
            a, b = ones[start], ones[i]
            start = np.where(bit == 1, zeros + a, start - a)
            i = np.where(bit == 1, zeros + b, i - b)
        return i - start


def suffix_order(text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Suffix array of strings laid end to end. text: symbols from 1 on, 0 at each string's end; last: for each position the end
    of its string. Ends sort below all symbols and among each other by place, so suffixes never compare past their string."""
    n, ends = len(text), np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    span = 1
    places = np.arange(n)
    while True:
        key = rank * (n + len(ends) + int(text.max(initial=0)) + 2) + rank[np.minimum(places + span, last)]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


class FMIndex:
    """Index of strings laid end to end (see suffix_order)."""

    def __init__(self, text: np.ndarray):
        ends = np.flatnonzero(text == 0)
        last = ends[np.searchsorted(ends, np.arange(len(text)))]
        order = suffix_order(text, last)
        first = np.concatenate(([0], ends[:-1] + 1))
        self.bwt = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.matrix = WaveletMatrix(self.bwt.astype(np.int64), max(1, int(text.max(initial=0)).bit_length()))
        marked = np.zeros(len(text), bool)
        marked[first] = True
        offset = np.arange(len(text)) - first[np.searchsorted(ends, np.arange(len(text)))]
        marked |= offset % SAMPLE == 0
        self.marked = marked[order]
        self.before = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns together. patterns: one a row, its symbols at the right. Returns intervals [low, high)."""
        n = len(self.bwt)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        live = np.arange(len(patterns))
        top = len(self.below) - 1
        for step in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= step) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, -step]
            known = c < top
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.below[c] + self.matrix.rank(c, low[live])
            high[live] = self.below[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps towards the sampled positions."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            at = rows[live]
            there = self.marked[at]
            out[live[there]] = self.samples[self.before[at[there]]] + steps
            live, at = live[~there], at[~there]
            c = self.bwt[at].astype(np.int64)
            rows[live] = self.below[c] + self.matrix.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Distinct windows of a block of pieces (item, words): patterns (one a row, its codes at the right), their lengths and items."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in pieces}, key=lambda x: (x is not None, x))
        number = {x: k for k, x in enumerate(self.ids)}
        self.known: dict[bytes, int] = {}
        rows, items = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in pieces:
            w = np.fromiter((self.known.setdefault(x.encode(), len(self.known) + 1) for x in text), np.int32, len(text))
            if len(w):
                rows.append(np.lib.stride_tricks.sliding_window_view(w, window) if len(w) >= window else np.concatenate((np.zeros(window - len(w), np.int32), w))[None])
                items.append(np.full(len(rows[-1]), number[item], np.int32))
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window))
        pair = np.unique(of.ravel().astype(np.int64) * max(1, len(self.ids)) + np.concatenate(items))
        self.items = pair % max(1, len(self.ids))
        self.item_at = np.searchsorted(pair // max(1, len(self.ids)), np.arange(len(self.patterns) + 1))


def search_shard(shard: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each document of a shard, given as its words: merged spans of words hit, numbers of the items found."""
    get = phrases.known.get
    sizes = np.fromiter(map(len, shard), np.int64, len(shard))
    codes = [np.fromiter((get(x, 0) for x in w), np.int32, len(w)) for w in shard]
    none = [([], []) for _ in shard]
    doc_at = np.concatenate(([0], np.cumsum(sizes + 1)))  # a 0 ends each document
    text = np.zeros(int(doc_at[-1]), np.int32)
    for at, c in zip(doc_at[:-1], codes, strict=True):
        text[at : at + len(c)] = c
    ends = np.flatnonzero(text == 0)
    if not len(ends) or not len(phrases.lengths):
        return none
    long = np.diff(np.concatenate(([-1], ends))) > phrases.shortest
    keep = np.repeat(long, np.diff(np.concatenate(([-1], ends))))
    place = np.flatnonzero(keep)
    if not len(place):
        return none
    index = FMIndex(text[place])
    low, high = index.search(phrases.patterns.astype(np.int64), phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return none
    count = (high - low)[found]
    pattern = np.repeat(found, count)
    rows = np.repeat(low[found], count) + np.arange(len(pattern)) - np.repeat(np.cumsum(count) - count, count)
    at = place[index.locate(rows)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[pattern], -1)
    hit = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
    turn = np.diff(hit)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    span_doc = np.searchsorted(doc_at, begin, side="right") - 1
    doc = np.searchsorted(doc_at, at, side="right") - 1
    pair = np.unique(doc * len(phrases.lengths) + pattern)
    doc, pattern = pair // len(phrases.lengths), pair % len(phrases.lengths)
    out = none
    for d, b, e in zip(span_doc.tolist(), (begin - doc_at[span_doc]).tolist(), (end - doc_at[span_doc]).tolist(), strict=True):
        out[d][0].append((b, e))
    many = (phrases.item_at[1:] - phrases.item_at[:-1])[pattern]
    item = phrases.items[np.repeat(phrases.item_at[pattern], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    for x in np.unique(np.repeat(doc, many) * len(phrases.ids) + item).tolist():
        out[x // len(phrases.ids)][1].append(x % len(phrases.ids))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of several blocks to disjoint ones in order."""
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and out[-1]["end"] >= start:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


@functools.lru_cache(maxsize=1)
def _load(folder: str, block: int) -> Phrases:
    """A written block; a worker keeps the last one."""
    from pyarrow import parquet

    system, base = file_system(folder)
    return pickle.loads(parquet.read_table(f"{base}/block={block}", filesystem=system, columns=["phrases"])["phrases"][0].as_py())


def _searcher(folder: str, blocks: list[int]):  # noqa: ANN202
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts, rows = list(texts), []
            for at in portions(texts):
                shard = [words(t) for t in texts[at]]
                spans, items = [[] for _ in shard], [set() for _ in shard]
                for b in blocks:
                    phrases = _load(folder, b)
                    for k, (s, x) in enumerate(search_shard(shard, phrases)):
                        spans[k] += s
                        items[k].update(phrases.ids[i] for i in x)
                rows += [(len(w), _joined(s), list(x)) for w, s, x in zip(shard, spans, items, strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search


def phrase_pieces(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """item, words (array), n (windows): the distinct items in overlapping pieces, so that each window is in one piece of its item."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(piece))
    cut_ = F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(piece + window - 1)))
    return items.select("item", F.explode(cut_).alias("words")).withColumn("n", F.greatest(F.lit(1), F.size("words") - (window - 1)).cast("long"))


def write_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[str, list[int]]:
    """Folder and numbers of the written blocks of phrases."""
    spark = benchmark.sparkSession
    pieces = cut(phrase_pieces(benchmark, item_id, text, window), "phrase-pieces")
    n = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, list[str]]] = []
        at = None
        made = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "phrases": pa.array([pickle.dumps(Phrases(held, window))], pa.binary())})
        for batch in batches:
            for b, item, w in zip(*(batch.column(c).to_pylist() for c in ("block", "item", "words")), strict=True):
                if held and b != at:
                    yield made()
                    held.clear()
                at = b
                held.append((item, w))
        if held:
            yield made()

    block = F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int")
    made = pieces.select(block.alias("block"), "item", "words").repartition(n, "block").sortWithinPartitions("block").mapInArrow(build, "block int, phrases binary")
    folder = new_path(spark, "phrases")
    made.write.partitionBy("block").parquet(folder)
    return folder, sorted(r[0] for r in spark.read.schema("phrases binary, block int").parquet(folder).select("block").collect())


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of docs, with column ``out`` (instead of one of that name): struct of n_words, removal spans [start, end) in words, items found."""
    folder, blocks = write_blocks(benchmark, window=window, block_words=block_words)
    return docs.withColumn(out, _searcher(folder, blocks)(F.col(text)))


def contaminated(hits: str = "hits") -> Column:
    return F.size(F.col(hits)["spans"]) > 0


def report(found: DataFrame, doc_id: str = "doc_id", hits: str = "hits") -> DataFrame:
    """Digest columns of find_passages()."""
    h = F.col(hits)
    names = F.array_sort(F.transform(h["items"], lambda x: F.coalesce(x, F.lit(""))))
    return found.select(
        F.col(doc_id).alias("doc_id"),
        h["n_words"].alias("n_words"),
        F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
        h["spans"].alias("spans"),
    )


@F.pandas_udf(T.StringType())
def _cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is None or not len(s):
            out.append(t)
            continue
        raw = t.encode()
        inside = np.concatenate(([0], np.frombuffer(raw.translate(_WORDS), np.uint8) != 32, [0])).astype(np.int8)
        begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        at, parts = 0, []
        for x in s:
            parts.append(raw[at : begin[x["start"]]])
            at = end[x["end"] - 1]
        out.append(b"".join([*parts, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def remove_spans(found: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """The documents of find_passages() with the words of all spans, and what stands between them, cut from the text."""
    return found.withColumn(text, _cut_words(F.col(text), F.col(hits)["spans"]))
