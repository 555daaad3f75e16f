"""Log readers: marker lines, resource snapshots, container logs, telemetry payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINER_LOG = "time string, stream string, log string"
RESOURCES = ("cpu", "memory", "storage")


def read_marker_logs(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Lines of text files that hold a marker and none of the excluded words: value, component (file name)."""
    return marker_lines(spark.read.text(path).withColumn("component", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)), exclude)


def marker_lines(df: DataFrame, exclude: Sequence[str] = (), col: str = "value") -> DataFrame:
    out = df.where(F.col(col).contains("[marker:"))
    for word in exclude:
        out = out.where(~F.col(col).contains(word))
    return out


def parse_resource_log(df: DataFrame, pools: Sequence[str] = ("pool1", "pool2", "pool3"), col: str = "value") -> DataFrame:
    """Resource snapshots to ts (milliseconds) and nine measures <pool>_<cpu|memory|storage>. Lines with other numbers of numbers drop out.

    All whole numbers of a line are read by position: seven of the time stamp, then for each pool the processors, their
    decimals (skipped), memory and storage.
    """
    n = F.regexp_extract_all(F.col(col), F.lit(r"\d+"), F.lit(0))
    # exploding one array keeps Spark from writing the pattern out once for each number
    rows = df.select(F.explode(F.array(F.transform(n, lambda x: x.try_cast("bigint")))).alias("n")).where(F.size("n") == 7 + 4 * len(pools))
    at = lambda i: F.get("n", i)
    ts = F.unix_millis(F.try_make_timestamp(at(0).cast("int"), at(1).cast("int"), at(2).cast("int"), at(3).cast("int"), at(4).cast("int"), (at(5) + at(6) / 1000.0).cast("decimal(8,6)"), F.lit("UTC")))
    measures = [at(7 + 4 * p + (0, 2, 3)[m]).alias(f"{pool}_{name}") for p, pool in enumerate(pools) for m, name in enumerate(RESOURCES)]
    return rows.select(ts.alias("ts"), *measures)


def read_container_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTAINER_LOG).json(path)


def _payload(col: str):  # noqa: ANN202
    """Object and points of ``object=X&point=ts,cpu,mem,(name,a,b)*`` as arrays of fields."""
    parts = F.split(F.col(col), "&")
    named = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.split(F.substring_index(p, "=", -1), ",").alias("f")))
    return F.get(F.filter(named, lambda p: p["name"] == "object"), F.lit(0))["f"][0], F.filter(named, lambda p: (p["name"] != "object") & (F.size(p["f"]) >= 3))


def _networks(fields, order: tuple[str, str]):  # noqa: ANN001, ANN202
    """Triples after the first three fields: struct (name, rx, tx)."""
    count = F.floor((F.size(fields) - 3) / 3).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    a, b = (2, 1) if order == ("tx", "rx") else (1, 2)
    return F.transform(index, lambda i: F.struct(F.get(fields, 3 + 3 * i).alias("name"), F.get(fields, 3 + 3 * i + a).try_cast("double").alias("rx"), F.get(fields, 3 + 3 * i + b).try_cast("double").alias("tx")))


def parse_profile_payload(df: DataFrame, col: str = "value", order: tuple[str, str] = ("rx", "tx")) -> DataFrame:
    """Long rows (name, point, field, value, logtime) of a telemetry payload: CPU, MEM, RXBytes-<peer>, TXBytes-<peer>."""
    name, points = _payload(col)
    rows = df.select(name.alias("name"), F.explode(points).alias("p")).select("name", F.col("p.name").alias("point"), F.col("p.f").alias("f"))
    fixed = F.array(F.struct(F.lit("CPU").alias("field"), F.get("f", 1).try_cast("double").alias("value")), F.struct(F.lit("MEM").alias("field"), F.get("f", 2).try_cast("double").alias("value")))
    peers = F.flatten(F.transform(_networks(F.col("f"), order), lambda n: F.array(F.struct(F.concat(F.lit("RXBytes-"), n["name"]).alias("field"), n["rx"].alias("value")), F.struct(F.concat(F.lit("TXBytes-"), n["name"]).alias("field"), n["tx"].alias("value")))))
    long = rows.select("name", "point", F.get("f", 0).alias("logtime"), F.explode(F.concat(fixed, peers)).alias("x"))
    return long.select("name", "point", "x.field", "x.value", "logtime")


def parse_profile_points(df: DataFrame, col: str = "value", order: tuple[str, str] = ("rx", "tx")) -> DataFrame:
    """One row a point: name, point, timestamp, cpu, memory, network (map of peer to rx, tx)."""
    name, points = _payload(col)
    rows = df.select(name.alias("name"), F.explode(points).alias("p")).select("name", F.col("p.name").alias("point"), F.col("p.f").alias("f"))
    peers = F.map_from_entries(F.transform(_networks(F.col("f"), order), lambda n: F.struct(n["name"], F.struct(n["rx"].alias("rx"), n["tx"].alias("tx")))))
    return rows.select("name", "point", F.get("f", 0).alias("timestamp"), F.get("f", 1).try_cast("double").alias("cpu"), F.get("f", 2).try_cast("double").alias("memory"), peers.alias("network"))


def format_exposition(df: DataFrame, name: str = "name", labels: str = "labels", value: str = "value") -> DataFrame:
    """Metric rows (name, map of labels, value) as exposition text lines ``name{a="b"} value``."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    tags = F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return df.select(F.concat(F.col(name), tags, F.lit(" "), F.col(value).cast("string")).alias("line"))
