"""Chunks of documents as rows: arrays of numbers and bytes packed into binary columns, for operators that send a chunk's parts to
buckets and take the answers back. A chunk is written once before anything refers to it, so its number stays its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the finaliser of a published 64-bit mixer (splitmix64); fixed values.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def squeeze(data: bytes | memoryview) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, byte planes apart."""
    return pack_codes(np.diff(np.asarray(x, np.int64), prepend=np.int64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_codes(data))


def pack_codes(x: np.ndarray) -> bytes:
    """Whole numbers of no order, compressed, byte planes apart; their own width is kept."""
    x = np.ascontiguousarray(x)
    return bytes([x.itemsize]) + squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(unsqueeze(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<i{width}").ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def byte_strings(data: bytes, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """Slices of a buffer at ascending offsets, without copying them."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def chunk_numbers() -> Iterator[int]:
    """Numbers of the chunks that a task makes: its partition in the upper bits."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to pieces of some ``most`` bytes of text each, of one document at least."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(np.fromiter((n or 0 for n in pc.binary_length(column).to_pylist()), np.int64, batch.num_rows))
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most - size, "right")))
            kept.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            lo = hi
            if size >= most or lo < batch.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches(max_chunksize=1 << 62)[0]
                kept, size = [], 0
    if kept and (table := pa.Table.from_batches(kept).combine_chunks()).num_rows:
        yield table.to_batches(max_chunksize=1 << 62)[0]
