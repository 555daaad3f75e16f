"""Running queries batch by batch, and a sink that a replayed batch doesn't write twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter


def drain(writer: DataStreamWriter) -> int:
    """Runs a query until it has taken what is there, one batch after the other, and stops it. Returns how many batches its checkpoint
    has seen; an error of the query is raised."""
    q = writer.trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        last = q.lastProgress
    finally:
        q.stop()
    return last["batchId"] + 1 if last else 0


def batch_folders(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch replaces the folder of its own number, so a batch that is replayed after a failure, with the same
    offsets, is there once. ``after`` is called when a batch is written."""

    def write(df: DataFrame, batch: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if after:
            after(batch)

    return write


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all batches, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a table of updates the last state of each key: one aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", after: Callable[[int], None] | None = None) -> DataStreamWriter:
    """A writer into batch folders, for drain()."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch_folders(path, after=after))
