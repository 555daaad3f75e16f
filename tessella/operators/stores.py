"""Stores that are kept and rewritten: invocation records by day, snapshots by name, and bucketed tables.

A record store has one folder a day. Retention and log cleaning list the folders, drop whole days by name, and rewrite only the days
that change, by dynamic partition overwrite: new files are staged whole before old ones go, and other days keep their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import discard, folders
from .records import expired_snapshots, live_documents, strip_logs
from .relational import clean_keys

DAY_MS = 86_400_000


def day_number(ms: str) -> Column:
    """Days since 1970 in UTC, whatever the session's time zone."""
    return F.floor(F.col(ms) / DAY_MS).cast("int")


def write_days(acts: DataFrame, path: str, start: str = "start", day: str = "day") -> None:
    """Adds records to a store by day. Rows are dealt by day before they are written, a large day to several tasks, small ones together,
    so a day has few files."""
    acts.withColumn(day, day_number(start)).hint("rebalance", day).write.mode("append").partitionBy(day).parquet(path)


def days(spark: SparkSession, path: str, day: str = "day") -> list[int]:
    """Days that a store has, from the names of its folders."""
    return sorted(int(n.partition("=")[2]) for n in folders(spark, path) if n.startswith(f"{day}="))


def _rewrite(rows: DataFrame, path: str, day: str) -> None:
    rows.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retain_days(spark: SparkSession, path: str, now_ms: int, keep_days: int, start: str = "start", day: str = "day") -> dict[str, list[int]]:
    """Drops records older than so many days: whole days by name, without reading them; the day that the cutoff divides is rewritten.
    Returns which days were dropped and rewritten."""
    cutoff = now_ms - keep_days * DAY_MS
    edge, there = cutoff // DAY_MS, days(spark, path, day)
    old = [d for d in there if d < edge]
    discard(spark, *[f"{path}/{day}={d}" for d in old])
    rewritten = []
    if edge in there and cutoff % DAY_MS:
        rows = spark.read.parquet(path).where(F.col(day) == edge)
        kept = rows.where(F.col(start) >= cutoff)
        if kept.isEmpty():
            discard(spark, f"{path}/{day}={edge}")
            old.append(edge)
        elif not rows.where(~F.coalesce(F.col(start) >= cutoff, F.lit(False))).isEmpty():
            _rewrite(kept, path, day)
            rewritten.append(edge)
    return {"dropped": old, "rewritten": rewritten}


def strip_old_logs(spark: SparkSession, path: str, now_ms: int, keep_days: int, start: str = "start", day: str = "day") -> list[int]:
    """Older records of a store lose their logs, but for those of kind sequence. Only days that still have such logs are read whole and
    rewritten; run again, none is. Returns them."""
    cutoff = now_ms - keep_days * DAY_MS
    sequence = F.coalesce(S.annotation("annotations", "kind") == "sequence", F.lit(False))
    rows = spark.read.parquet(path).where(F.col(day) <= cutoff // DAY_MS)
    wanting = rows.where((F.col(start) < cutoff) & ~sequence & (F.size("logs") > 0)).select(day).distinct()
    found = sorted(r[0] for r in wanting.collect())  # at most a row a day
    if found:
        _rewrite(strip_logs(rows.where(F.col(day).isin(found)), now_ms, keep_days), path, day)
    return found


def write_snapshots(docs: DataFrame, path: str, name: str = "snapshot") -> None:
    """Copies of live documents, a folder for each name in a column."""
    live_documents(docs).hint("rebalance", name).write.mode("append").partitionBy(name).parquet(path)


def drop_expired(spark: SparkSession, path: str, now_s: int, keep_s: int, prefix: str = "backup_", exclude: tuple[str, ...] = (), name: str = "snapshot") -> list[str]:
    """Deletes the folders of snapshots that have expired, by their names alone, and returns those."""
    names = [n.partition("=")[2] for n in folders(spark, path) if n.startswith(f"{name}=")]
    if not names:
        return []
    gone = sorted(r[0] for r in expired_snapshots(spark.createDataFrame([(n,) for n in names], "name string"), now_s, keep_s, prefix, exclude).collect())
    discard(spark, *[f"{path}/{name}={n}" for n in gone])
    return gone


def store_bucketed(df: DataFrame, table: str, key: str, n: int, path: str | None = None) -> DataFrame:
    """A table in n buckets by a key, sorted in each, one file a bucket; tables of one n join on their keys without moving a row. For
    keys without hot values, as a bucket is one task's; ``relational.partitioned_join`` leaves those to Spark."""
    writer = clean_keys(df, key).repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def bucketed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins bucketed tables bucket by bucket."""
    return left.join(right.hint("merge"), key, how)
