"""Shared helpers: the folder that driver and executors share, lineage cuts, portions of a batch of texts, byte tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, written  # noqa: F401  for those who store results
from ..sources.tables import shared_path as new_path

#: A-Z to a-z; everything else, UTF-8 bytes above 0x7F included, stays.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of ``documents`` are maximal runs of anything but these bytes; ``bytes.split()`` splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts and characters of texts that a task works on at a time, one text at least. What Spark sends to a worker at once is
#: bounded in rows and bytes by spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch, 64 MB by default.
AT_ONCE_ROWS, AT_ONCE_CHARS = 1000, 1 << 23


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table: lineage ends there, and no executor's loss costs it."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", most: int = 200_000, salts: int = 64) -> DataFrame:
    """Joins rows with a table of distinct keys of the same name. A key that holds over ``most`` rows, and over a thousandth of all, so at
    most 1000 keys, is dealt over ``salts`` tasks by its rows' hashes, which a task that runs again finds again; of the table such a key is there once
    for each."""
    if (total := rows.count()) <= most:
        return rows.join(other, key, how)
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(most, total // 1000)).select(F.col(key).alias("__hot")), "hot")
    if hot.isEmpty():
        return rows.join(other, key, how)
    mark = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")  # noqa: E731  at most 1000 rows
    left = mark(rows).withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).cast("int")).drop("__hot")
    each = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.join(mark(other).withColumn("__salt", F.explode(each)).drop("__hot"), [key, "__salt"], how).drop("__salt")


def portions(texts: Sequence[str | None], rows: int = AT_ONCE_ROWS, chars: int = AT_ONCE_CHARS) -> Iterator[slice]:
    """Slices of a batch, each of at most so many texts and characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and (i - lo >= rows or size + n > chars):
            yield slice(lo, i)
            lo, size = i, 0
        size += n
    if len(texts):
        yield slice(lo, len(texts))


def file_system(folder: str):  # noqa: ANN201
    """pyarrow's file system of a shared folder (local, HDFS, S3, GCS) and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system, so that workers waiting for their next task stay small."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)
