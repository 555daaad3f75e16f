"""Token-ID output as sorted string tables: one record a document, keyed by identifier.

A shard is one file of a range of identifiers, files and records in ascending order. Its layout, integers little-endian:

    block*      zstd-compressed; records one after another: shared (u16), rest (u16), count (u64), key bytes that differ from
                the key before (the first record of a block shares none), then count token ids of width bytes
    index       for each block: key length (u16), first key, offset (u64), stored bytes (u64)
    filter      Bloom filter of all keys, its bits as bytes
    footer      64 bytes: index offset, filter offset, filter hashes, blocks, records, ids, id width, magic

Lookup reads the footer, asks the filter, finds the block by binary search in the sparse index and scans that one block.
Keys are 0x01 and the identifier as big-endian unsigned 64-bit number with its sign bit flipped, so bytes sort as numbers
do, or 0x02 and the identifier's UTF-8 bytes; a missing identifier has the key 0x00 and sorts first. Repeated identifiers are
records of their own, side by side.

Whole texts go through the tokenizers library, some hundred at a time; any tokenizer file of that library serves. If the file's
own steps show that white space parts every text for good, as word_bpe's do, the library gets each different word of the
texts once and its ids are remembered (WordEncoder); every other file gets the texts in one piece (Encoder).

Files go to a folder that all executors share, by pyarrow's file systems (local, HDFS, S3, GCS). A task writes under a name
of its attempt and moves the file into place when it is whole, so attempts that are lost or repeated leave one file.

Defined cases: a null or empty text has only the end id; identifiers are whole numbers or strings, any other type is refused;
an empty table has no files and no rows; extra columns don't matter.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, file_system, fresh, give_back, new_path, portions

END_ID = 1
MAGIC = 0x54535354_41424C45
FOOTER = struct.Struct("<8Q")
#: Bytes of records in a block before compression.
BLOCK_BYTES = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Texts and characters encoded together: in one piece, and by words.
AT_ONCE, AT_ONCE_CHARS = 200, 1 << 20
WORDWISE_AT_ONCE, WORDWISE_AT_ONCE_CHARS = 2_000, 1 << 22
#: Words given to the library together.
WORDS_AT_ONCE = 2_000
#: What a worker process remembers: bytes of the newer half, of the longest word, and of an entry beside word and ids.
MEMO_BYTES, MEMO_WORD, ENTRY_BYTES = 100 << 20, 256, 160
#: Header of a record: shared key bytes, further key bytes, ids.
RECORD = struct.Struct("<HHQ")


class Encoder:
    """Ids of whole texts by the tokenizers library, packed. A text's encoding takes some 100 bytes a token while it is made."""

    at_once = AT_ONCE, AT_ONCE_CHARS

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


class WordEncoder(Encoder):
    """Ids of whole texts, put together from the ids that the library gives each different word.

    Right only where parts_at_white_space() holds: NFC and case folding never reach over ASCII white space, the pattern has no
    match that holds white space or looks around, and the model sees one match at a time. So a text's ids are those of its words.
    """

    at_once = WORDWISE_AT_ONCE, WORDWISE_AT_ONCE_CHARS
    #: Words that are one match of the pattern, letters of Latin-1, or two, letters and marks of ASCII.
    PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]+)?")

    def __init__(self, path: str):
        super().__init__(path)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _plain(self, words: list[bytes], matches: list[int]) -> list[bytes]:
        """Ids of words of so many matches each. They make one text for the library; a match's last token alone has the mark of an end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(matches) - 1
        if len(ends) != last[-1] + 1:
            return super().encode([w.decode() for w in words])
        raw, at = ids.tobytes(), (ends[last] * self.width).tolist()
        return [raw[lo:hi] for lo, hi in itertools.pairwise([0, *at])]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the memo lacks, from the older half or from the library."""
        older, match = self.older, self.PLAIN.fullmatch
        found, plain, matches, other = {}, [], [], []
        for w in new:
            if w in older:
                found[w] = older[w]
            elif m := match(w):
                plain.append(w)
                matches.append(2 if m.lastindex else 1)
            else:
                other.append(w)
        for i in range(0, len(plain), WORDS_AT_ONCE):
            at = slice(i, i + WORDS_AT_ONCE)
            found |= zip(plain[at], self._plain(plain[at], matches[at]), strict=True)
        for i in range(0, len(other), WORDS_AT_ONCE):
            some = other[i : i + WORDS_AT_ONCE]
            found |= zip(some, super().encode([w.decode() for w in some]), strict=True)
        return found

    def _remember(self, found: dict[bytes, bytes]) -> None:
        for w in [w for w in found if len(w) > MEMO_WORD]:
            del self.memo[w], found[w]
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        if self.held > MEMO_BYTES:
            # a batch of very many words isn't kept
            self.older, self.memo, self.held = self.memo if self.held <= 2 * MEMO_BYTES else {}, {}, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, words))
        found = self._learn([w for w, known in zip(words, ids, strict=True) if known is None])
        ids = np.array([found[w] if known is None else known for w, known in zip(words, ids, strict=True)], object)
        self.memo |= found
        self._remember(found)
        dealt, at = ids[coded.indices.to_numpy()].tolist(), split.offsets.to_numpy().tolist()
        return [b"".join(dealt[lo:hi]) for lo, hi in itertools.pairwise(at)]


#: Steps after which no token and no rule reaches over white space.
WORDWISE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def parts_at_white_space(steps: dict) -> bool:
    """Whether a tokenizer file's steps are those of WORDWISE, its model is plain BPE that marks ends of words, and its control strings, like <|this|>, can't be parted."""
    model = steps["model"]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["continuing_subword_prefix"])
    whole = all(re.fullmatch(r"<\|[a-z]+\|>", a["content"]) and not (a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]) for a in steps["added_tokens"])
    return plain and whole and all(steps.get(k) == v for k, v in WORDWISE.items())


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    whole = Encoder(path)
    return WordEncoder(path) if parts_at_white_space(json.loads(whole.tokenizer.to_str())) else whole


def key_bytes(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b"\0"
    key = b"\2" + doc_id.encode() if isinstance(doc_id, str) else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)
    if len(key) >= 1 << 16:
        raise ValueError("identifiers have at most 65,534 bytes")
    return key


def key_value(key: bytes) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if key[:1] == b"\2" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _identifier(df: DataFrame, doc_id: str) -> tuple[Column, str]:
    """The identifier as the tables store it, and its type: whole numbers as long, texts as string."""
    kind = df.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType | T.StringType):
        raise TypeError(f"{doc_id} is {kind.simpleString()}; token tables are keyed by whole numbers or strings")
    name = "string" if isinstance(kind, T.StringType) else "long"
    return F.col(doc_id).cast(name), name


def _bloom_at(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes records in key order to a binary stream."""

    def __init__(self, out, width: int):  # noqa: ANN001
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.out, self.width, self.at = out, width, 0
        self.parts, self.size, self.first, self.last = [], 0, None, b""
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.parts += [RECORD.pack(shared, len(key) - shared, len(ids) // self.width), key[shared:], ids]
        self.size += RECORD.size + len(key) - shared + len(ids)
        self.last = key
        self.keys.append(key)
        self.ids += len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.parts:
            data = self.pack(b"".join(self.parts))
            self.index.append((self.first, self.at, len(data)))
            self._write(data)
            self.parts, self.size, self.first = [], 0, None

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index))
        bits = max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_at(k, bits)] = 1
        bloom_at = self.at
        self._write(np.packbits(bloom).tobytes())
        self._write(FOOTER.pack(index_at, bloom_at, BLOOM_HASHES, len(self.index), len(self.keys), self.ids, self.width, MAGIC))


class TableReader:
    """Random-access file to records; one block is in memory at a time."""

    def __init__(self, file):  # noqa: ANN001
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.file = file
        size = file.size()
        index_at, bloom_at, self.hashes, blocks, self.records, self.ids, self.width, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        raw, at = file.read_at(bloom_at - index_at, index_at), 0
        self.first, self.place = [], []
        for _ in range(blocks):
            (n,) = struct.unpack_from("<H", raw, at)
            self.first.append(raw[at + 2 : at + 2 + n])
            self.place.append(struct.unpack_from("<QQ", raw, at + 2 + n))
            at += 18 + n
        self.bloom = np.frombuffer(file.read_at(size - FOOTER.size - bloom_at, bloom_at), np.uint8)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, n = self.place[i]
        raw, at, key = self.unpack(self.file.read_at(n, offset)), 0, b""
        while at < len(raw):
            shared, rest, count = RECORD.unpack_from(raw, at)
            at += RECORD.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.width}", count, at)
            at += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.place)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all records of an identifier."""
        key = key_bytes(doc_id)
        bits = 8 * len(self.bloom)
        if not all(self.bloom[x >> 3] >> (7 - (x & 7)) & 1 for x in _bloom_at(key, bits)):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.first)):
            if self.first[i] > key:
                break
            out += [ids.copy() for k, ids in self.block(i) if k == key]
        return out


def write_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the files and returns one row each: shard, file, records, ids, keys (type of the identifiers). Rows are dealt by ranges of the identifier and sorted inside them."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-table")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, base = file_system(folder)
                system.create_dir(base, recursive=True)
                final = f"shard-{task.partitionId():06d}.tokens"
                temporary = f"{base}/_{final}.{task.taskAttemptId()}"
                encoder = shared_encoder(tokenizer_path)
                out = system.open_output_stream(temporary)
                writer = TableWriter(out, encoder.width)
                end = encoder.pack([END_ID])
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for at in portions(texts, *encoder.at_once):
                for k, packed in zip(ids[at], encoder.encode(texts[at]), strict=True):
                    writer.add(key_bytes(k), packed + end)
        if writer is not None:
            writer.close()
            out.close()
            system.move(temporary, f"{base}/{final}")
            give_back()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "file": [f"{folder}/{final}"], "records": pa.array([len(writer.keys)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    key, kind = _identifier(docs, doc_id)
    rows = docs.select(key.alias("doc_id"), F.col(text).alias("text"))
    parts = [shards] if shards else []
    files = rows.repartitionByRange(*parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard int, file string, records long, ids long")
    return cut(files.withColumn("keys", F.lit(kind)), "token-files")


def _kind(files: DataFrame) -> str:
    first = files.select("keys").first()
    return first[0] if first else "long"


def read_table(files: DataFrame) -> DataFrame:
    """Rows of all files, read back by a task a file: doc_id, shard, local_start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    kind = _kind(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                folder, _, base = name.rpartition("/")
                system, root = file_system(folder)
                with system.open_input_file(f"{root}/{base}") as file:
                    table, at = TableReader(file), 0
                    rows: list[tuple] = []
                    for key, ids in table:
                        rows.append((key_value(key), shard, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows, kind)
                            rows = []
                    if rows:
                        yield _rows(rows, kind)

    # a few rows name much work, so their partitions are counted out; Spark would merge them into one
    parts = max(1, files.count())
    return files.select("shard", "file").repartitionByRange(parts, "shard").mapInArrow(read, f"doc_id {kind}, shard int, local_start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
    names, kinds = ("doc_id", "shard", "local_start", "n_tokens", "ids_crc32"), (pa.string() if kind == "string" else pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def documents_in(files: DataFrame) -> DataFrame:
    """Per document as read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard. The sums of earlier files come from their one-row summaries."""
    before = files.select(F.col("shard").alias("of"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    rows = read_table(files)
    return rows.join(before, rows["shard"] == before["of"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def lookup(files: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids of wanted identifiers: each file gets the identifiers inside its range and finds them by filter and sparse index."""
    key = fresh(wanted, "__key")
    kind = _kind(files)
    arrow = pa.string() if kind == "string" else pa.int64()
    asked = wanted.select(F.col(doc_id).cast(kind).alias(key)).distinct()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                folder, _, base = name.rpartition("/")
                system, root = file_system(folder)
                with system.open_input_file(f"{root}/{base}") as file:
                    table = TableReader(file)
                    *_, last = table.block(len(table.place) - 1)
                    yield pa.RecordBatch.from_pydict({"first": pa.array([table.first[0]], pa.binary()), "last": pa.array([last[0]], pa.binary()), "file": [name]})

    # one row a file: its first and last key; files are disjoint and ascend, so a binary search names the only one that can hold a key
    ranges = sorted(tuple(r) for r in files.select("file").mapInArrow(edges, "first binary, last binary, file string").collect())
    firsts, lasts, names = ([bytes(r[i]) if i < 2 else r[i] for r in ranges] for i in range(3))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [bisect.bisect_right(firsts, key_bytes(k)) - 1 for k in ids]
            there = [i >= 0 and key_bytes(k) <= lasts[i] for i, k in zip(at, ids, strict=True)]
            yield pa.RecordBatch.from_pydict({"file": pa.array([names[i] for i, t in zip(at, there, strict=True) if t], pa.string()), key: pa.array([k for k, t in zip(ids, there, strict=True) if t], arrow)})

    pairs = asked.mapInArrow(route, f"file string, `{key}` {kind}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = table = file = None
        for batch in batches:
            for at, k in zip(batch.column("file").to_pylist(), batch.column(key).to_pylist(), strict=True):
                if at != name:
                    if file:
                        file.close()
                    folder, _, base = at.rpartition("/")
                    system, root = file_system(folder)
                    file = system.open_input_file(f"{root}/{base}")
                    name, table = at, TableReader(file)
                for ids in table.get(k):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k], arrow), "ids": pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))})
        if file:
            file.close()

    return pairs.repartition(max(1, len(names)), "file").sortWithinPartitions("file", key).mapInArrow(find, f"doc_id {kind}, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes and reads back: documents_in() of write_table()."""
    return documents_in(write_table(docs, tokenizer_path or default_tokenizer()))
