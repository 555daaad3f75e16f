"""Readers and writers of delimited tables, reports and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders given out by shared_path(), by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a temporary folder is set
    for a local session, whose executors are the driver; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(spark: SparkSession) -> list[str]:
    """Folders that were given out for this application and that discard() hasn't deleted. Once the results that come from them are
    stored, ``discard(spark, *written(spark))`` frees the space."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where, fs = _hadoop(spark, path)
        fs.delete(where, True)
        if path in own:
            own.remove(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it isn't there."""
    where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName()[0] not in "._")


def read_dsv(spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = "|", null: str = "-") -> DataFrame:
    """Headerless delimited files, one or many (names, folders or globs), each row ended by a separator. Empty and ``null`` fields are missing."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*declared.fields, T.StructField("_tail", T.StringType())])
    rows = spark.read.schema(full).option("sep", sep).option("nullValue", null).option("mode", "PERMISSIVE").csv(path)
    texts = {f.name: F.when(F.col(f.name) != "", F.col(f.name)) for f in declared.fields if isinstance(f.dataType, T.StringType)}
    return rows.drop("_tail").withColumns(texts) if texts else rows.drop("_tail")


def read_matrix(spark: SparkSession, path: str, n_cols: int) -> DataFrame:
    """Headerless numeric CSV: columns c0, c1, ..."""
    return spark.read.schema(", ".join(f"c{i} double" for i in range(n_cols))).csv(path)


def read_report_csv(spark: SparkSession, path: str, drop_like: str | None = None) -> DataFrame:
    """Headered CSV with inferred types, without columns whose names match a pattern."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.select(df.colRegex(f"`^(?!{drop_like}).*`")) if drop_like else df


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def append_metrics(df: DataFrame, table: str, path: str | None = None) -> None:
    """Adds rows to a metric table, made if absent: in the warehouse, or at a path."""
    writer = df.write.mode("append").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A named intermediate table: a view, or Parquet at a path when several jobs read it; names and types are kept."""
    if path:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def flatten_bench_json(df: DataFrame, layout: str = "split", col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nested benchmark JSON (one document a row) to long tables: throughput (concurrent, op_type, tput) and latency (concurrent, op_type, size, lat).

    layout "split": concurrency -> {tput: [{op: x}], lat: [{size: {op: x}}]}; "points": concurrency -> [{tput: {op: x}, lats: {size: {op: x}}}].
    """
    ops = "map<string, double>"
    if layout == "split":
        kind = f"map<string, struct<tput: array<{ops}>, lat: array<map<string, {ops}>>>>"
        runs = df.select(F.explode(F.from_json(col, kind)).alias("concurrent", "m"))
        tput, lat = runs.select("concurrent", F.explode("m.tput").alias("t")), runs.select("concurrent", F.explode("m.lat").alias("l"))
    elif layout == "points":
        kind = f"map<string, array<struct<tput: {ops}, lats: map<string, {ops}>>>>"
        runs = df.select(F.explode(F.from_json(col, kind)).alias("concurrent", "p")).select("concurrent", F.explode("p").alias("m"))
        tput, lat = runs.select("concurrent", F.col("m.tput").alias("t")), runs.select("concurrent", F.col("m.lats").alias("l"))
    else:
        raise ValueError(f"unknown layout {layout}")
    number = F.col("concurrent").cast("int").alias("concurrent")
    return (
        tput.select(number, F.explode("t").alias("op_type", "tput")),
        lat.select(number, F.explode("l").alias("size", "by_op")).select("concurrent", F.col("size").cast("int").alias("size"), F.explode("by_op").alias("op_type", "lat")).select("concurrent", "op_type", "size", "lat"),
    )
