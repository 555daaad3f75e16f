"""Alignment of two tokenizers' tokens over the same texts, and how often each pair of ids is linked in the corpus.

A text's tokens of A and of B cover the same bytes. Where a token of both ends is a shared cut; cuts divide a text into groups.
They are found by divide and conquer: in each open interval of A's ends a shared one near the middle is looked for by bisecting
into B's ends, farther and farther from the middle; both sides of it are intervals again, and an interval that has none is a
leaf, a group. All intervals of a chunk of documents take each step together.

Inside a group no ends agree, so tokens of A and B overlap in one staircase: each stretch between neighbouring ends of either is
one link. Links are counted by pair of ids in each chunk of some 2 MB of text, pairs are summed over all chunks by Spark, the
highest count of each id of B is joined (a row for each id of its vocabulary), and the sums go back to the chunks that asked;
texts are encoded once and don't move.

Defined cases: texts null or empty, and those whose tokens' bytes of A or B aren't the text's, have no tokens and zeros; repeated
rows count each; rows without doc_id are rows like others; an empty table gives an empty result; other columns play no part.
A task holds a chunk, some 60 bytes a byte of text; a longer text is a chunk of its own.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, portions
from .packing import chunk_numbers, gathered, pack, pack_codes, squeeze, unpack, unpack_codes, unsqueeze

CHUNK_BYTES = 1 << 21
#: Pieces of a byte-level tokenizer before merging: fixed value, the published pattern of that kind of tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = "chunk long, ids binary, known binary, n_a binary, n_b binary, n_groups binary, n_links binary, groups binary, pairs binary, counts binary, links binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Vocabulary:
    """Bytes of each id, side by side, and a table of the ids in decimal."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each byte whether the tokens say it; both of one length."""
        long = self.length[ids]
        place = np.repeat(self.first[ids] - (np.cumsum(long) - long), long)
        place += np.arange(len(place))
        return self.bytes[place] == text


class ByteLevel(Vocabulary):
    """A byte-level tokenizer file of the tokenizers library; special tokens' strings are plain text. Where its merges are numbered in
    their order, tiktoken gives the same ids in a quarter of the time; texts that it refuses (white space of some 100,000 characters
    in a row) go through the library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        own = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        words = {i: bytes(own[c] for c in t) for t, i in said["model"]["vocab"].items()}
        tokens = words | {t["id"]: t["content"].encode() for t in said["added_tokens"] if t["id"] not in words}
        super().__init__([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        self.fast = None
        merges = [(m if isinstance(m, list) else m.split(" ")) for m in said["model"].get("merges", ())]
        split = said["pre_tokenizer"] or {}
        if (said["model"]["type"] == "BPE" and said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                and not any(said["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
                and len(words) == 256 + len(merges) and all(words[256 + i] == bytes(own[c] for c in "".join(m)) for i, m in enumerate(merges))):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks={t: i for i, t in words.items()}, special_tokens={})

    @functools.cached_property
    def library(self):  # noqa: ANN202
        """The library's own encoder, loaded when a text needs it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            except ValueError:  # too much white space for its patterns
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces(Vocabulary):
    """A sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        super().__init__([bytes([int(piece(i)[1:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks that a worker process runs."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def _nearest(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval [lo, hi) of A's ends a shared one near its middle, -1 if it has none: 1, 2, 4 ... more ends on either side are
    bisected into B's until one is found."""
    middle = (lo + hi) // 2
    out = np.full(len(lo), -1)
    live, left, right, width = np.arange(len(lo)), middle, middle, 1
    while len(live):
        down, up = np.maximum(lo[live], left - width), np.minimum(hi[live], right + width)
        n = (left - down) + (up - right)
        owner = np.repeat(np.arange(len(live)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        below = (left - down)[owner]
        tried = np.where(k < below, down[owner] + k, right[owner] + k - below)
        shared = np.flatnonzero(b[np.searchsorted(b, a[tried])] == a[tried])
        best = np.full(len(live), np.iinfo(np.int64).max)
        far = np.abs(2 * tried[shared] + 1 - 2 * middle[live][owner[shared]])
        np.minimum.at(best, owner[shared], far * 2 + (tried[shared] < middle[live][owner[shared]]))
        hit = best < np.iinfo(np.int64).max
        at, below = (best // 2 - 1) // 2, best % 2 == 1
        out[live[hit]] = np.where(below, middle[live] - 1 - at, middle[live] + at)[hit]
        more = ~hit & ((down > lo[live]) | (up < hi[live]))
        live, left, right, width = live[more], down[more], up[more], 2 * width
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of A's ends (ascending, as B's) are B's as well, for documents that hold A's ends [first, last), the last one shared."""
    found = [last - 1]
    lo, hi = first, last - 1
    while (open_ := lo < hi).any():
        lo, hi = lo[open_], hi[open_]
        at = _nearest(a, b, lo, hi)
        split = at >= 0  # the others are leaves
        found.append(at[split])
        lo, hi = np.concatenate((lo[split], at[split] + 1)), np.concatenate((at[split], hi[split]))
    return np.sort(np.concatenate(found))


@functools.lru_cache(maxsize=2)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to size - 1, right-aligned, and which places they use."""
    width = len(str(max(1, size - 1)))
    n = np.arange(size)
    places = 10 ** np.arange(width - 1, -1, -1)
    return (n[:, None] // places % 10 + 48).astype(np.uint8), (n[:, None] >= places) | (places == 1)


def _written(ids: np.ndarray, mark: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """Ids in decimal, each followed by its mark (none if 0), and where each ends."""
    digits, used = _decimals(size)
    chars = np.concatenate((digits[ids], mark[:, None]), axis=1)
    there = np.concatenate((used[ids], mark[:, None] > 0), axis=1)
    return chars[there].tobytes(), np.cumsum(there.sum(axis=1))


class Aligned:
    """A chunk's documents, tokens of both sides, groups and links."""

    def __init__(self, texts: list[str | None], va: Vocabulary, vb: Vocabulary):
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        a, b = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        for part in portions(texts, 200, 1 << 20):
            there = [i for i in range(part.start, part.stop) if texts[i]]
            for out, v in ((a, va), (b, vb)):
                for i, ids in zip(there, v.encode([texts[i] for i in there]), strict=True):
                    out[i] = ids
        for i in range(n):
            if len(a[i]):
                said = np.frombuffer((" " + texts[i]).encode(), np.uint8)
                if va.length[a[i]].sum() != len(said) or vb.length[b[i]].sum() != len(said) or not va.spells(a[i], said).all() or not vb.spells(b[i], said).all():
                    a[i] = b[i] = np.zeros(0, np.int64)
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        self.va, self.vb = va, vb
        self.docs = np.flatnonzero(self.n_a)
        self.cut_a = self.cut_b = self.key = np.zeros(0, np.int64)
        if not len(self.docs):
            return
        ends_a, ends_b = np.cumsum(va.length[self.a]), np.cumsum(vb.length[self.b])
        last = np.cumsum(self.n_a)[self.docs]
        self.cut_a = shared_cuts(ends_a, ends_b, last - self.n_a[self.docs], last)
        self.cut_b = np.searchsorted(ends_b, ends_a[self.cut_a])
        self.n_groups[self.docs] = np.diff(np.searchsorted(self.cut_a, last), prepend=0)
        self.n_links = np.where(self.n_a > 0, self.n_a + self.n_b - self.n_groups, 0)
        own = np.ones(len(ends_a), bool)
        own[self.cut_a] = False
        stops = np.sort(np.concatenate((ends_b, ends_a[own])), kind="stable")
        self.key = self.b[np.searchsorted(ends_b, stops)] * va.size + self.a[np.searchsorted(ends_a, stops)]

    def groups(self) -> list[bytes]:
        """Each document's groups as text: a1,a2|b1;a3|b2,b3. Empty without tokens."""
        if not len(self.docs):
            return [b""] * len(self.n_a)
        is_a, is_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        is_a[self.cut_a], is_b[self.cut_b] = 1, 1
        in_a, in_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b  # groups
        at_a = np.arange(len(self.a)) + np.concatenate(([0], self.cut_b + 1))[in_a]
        at_b = np.arange(len(self.b)) + self.cut_a[in_b] + 1
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[self.cut_a]], mark[at_b[self.cut_b]] = ord("|"), ord(";")
        last = np.cumsum(self.n_a + self.n_b)
        mark[last[self.docs] - 1] = 0
        text, ends = _written(ids, mark, max(self.va.size, self.vb.size))
        stop = np.concatenate(([0], ends))[last].tolist()
        return [text[x:y] for x, y in zip([0, *stop], stop, strict=False)]


def _encode(path_a: str, path_b: str, digest: bool, chunk_bytes: int):  # noqa: ANN202
    kind = _arrow(CHUNK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(path_a), vocabulary(path_b)
        numbers = chunk_numbers()
        for batch in gathered(batches, "text", chunk_bytes):
            x = Aligned(batch.column("text").to_pylist(), va, vb)
            said = x.groups()
            pairs, links, counts = np.unique(x.key, return_inverse=True, return_counts=True)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_pylist([{
                "chunk": next(numbers), "ids": pack(ids.fill_null(0).to_numpy(zero_copy_only=False)), "known": pack(ids.is_valid().to_numpy(zero_copy_only=False)),
                "n_a": pack(x.n_a), "n_b": pack(x.n_b), "n_groups": pack(x.n_groups), "n_links": pack(x.n_links),
                "groups": squeeze(b"\n".join(sha256(g).hexdigest().encode() if digest and g else g for g in said)),
                "pairs": pack(pairs), "counts": pack(counts), "links": pack_codes(links.astype(np.int32)),
            }], schema=kind)
        give_back()

    return encode


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to their pairs: chunk, slot (the pair's place in the chunk), pair, n."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = unpack(row["pairs"])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(pairs), row["chunk"])), "slot": pa.array(np.arange(len(pairs))), "pair": pa.array(pairs), "n": pa.array(unpack(row["counts"]))})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the answers to their pairs to rows of documents."""
    for batch in batches:
        answers = batch.column("answers")
        for i, row in enumerate(batch.select([c for c in batch.schema.names if c != "answers"]).to_pylist()):
            links, n_links = unpack_codes(row["links"]), unpack(row["n_links"])
            total, best = np.zeros(len(unpack(row["pairs"])), np.int64), np.zeros(len(unpack(row["pairs"])), np.int64)
            if answers[i].is_valid:
                got = answers[i].values
                slot = got.field("slot").to_numpy()
                total[slot], best[slot] = got.field("total").to_numpy(), got.field("best").to_numpy()
            ends = np.cumsum(n_links)
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[links])))[ends], prepend=0) for v in (best, total)]
            known = unpack(row["known"]) > 0
            yield pa.RecordBatch.from_arrays([pa.array(unpack(row["ids"]), mask=~known), *[pa.array(unpack(row[c])) for c in ("n_a", "n_b", "n_groups", "n_links")], *map(pa.array, sums), pa.array(unsqueeze(row["groups"]).decode().split("\n"))], schema=_arrow(OUT))
    give_back()


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is counted most often of its B id), count_sum (of
    its links' counts) and groups, as text (some nine times the document) or as its SHA-256 in hex, made where the text is.

    path_a: a byte-level tokenizer file of the tokenizers library; path_b: a sentencepiece model."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is {docs.schema[doc_id].dataType.simpleString()}; documents are numbered by whole numbers")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = cut(docs.mapInArrow(_encode(path_a, path_b, digest, chunk_bytes), CHUNK), "aligned")
    asked = chunks.select("chunk", "pairs", "counts").mapInArrow(_asked, "chunk long, slot long, pair long, n long")
    totals = cut(asked.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    id_b = F.expr(f"pair div {vocabulary(path_a).size}").alias("b")
    most = totals.groupBy(id_b).agg(F.max("total").alias("most"))
    scored = totals.withColumn("b", id_b).join(F.broadcast(most), "b")  # a row for each id of B's vocabulary at most
    answers = asked.join(scored, "pair").groupBy("chunk").agg(F.collect_list(F.struct("slot", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))).alias("answers"))
    return chunks.drop("counts").join(answers, "chunk", "left").mapInArrow(_summed, OUT)
