"""Event metrics: parsing, counters, timings, gauges and rate limits, for batch and streaming frames alike.

Counters are by event-time window. A streaming frame carries a watermark (ten minutes unless told otherwise): later rows are
dropped, and repeated activation ids are counted once inside it. A batch frame gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.event_log import stream_log

BODY = "name string, activationId string, statusCode int, duration bigint, waitTime bigint, initTime bigint, kind string, conductor boolean, memory int, causedBy string, size int, userDefinedStatusCode int, metricName string, metricValue bigint"
ENVELOPE = f"source string, body struct<{BODY.replace(' ', ': ').replace(',:', ',')}>, subject string, namespace string, userId string, eventType string, timestamp bigint"
WATERMARK = "10 minutes"
LIMIT_METRICS = ("ConcurrentRateLimit", "TimedRateLimit")


def read_events(spark: SparkSession, source: Mapping[str, str]) -> DataFrame:
    """Stream of raw event texts: ``{"format": "kafka", ...options}``, ``{"format": "event_log", "path": log, ...options}`` (sources.event_log)
    or ``{"format": "text", "path": folder}``. Offsets live in the query's checkpoint."""
    options = {k: v for k, v in source.items() if k not in ("format", "path")}
    if source["format"] == "event_log":
        return stream_log(spark, source["path"], options.get("group"), int(options.get("most", 0))).select("value")
    reader = spark.readStream.format(source["format"]).options(**options)
    if source["format"] == "kafka":
        return reader.option("subscribe", options.get("subscribe", "events")).load().select(F.col("value").cast("string").alias("value"))
    return reader.load(source["path"])


def parse_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """Envelope and body fields; times not above zero are read as zero. Texts that aren't events drop out (see bad_events). A text is
    parsed once: what comes out of explode() isn't put together with the filter and the fields, as a plain column would be."""
    e = raw.select(F.explode(F.array(F.from_json(col, ENVELOPE))).alias("e")).where("e.body is not null and e.timestamp is not null")
    b = F.col("e.body")
    times = {c: F.when(b["metricName"].isNull(), F.greatest(F.coalesce(b[c], F.lit(0)), F.lit(0))) for c in ("duration", "waitTime", "initTime")}
    fields = [times.get(n, b[n]).alias(n) for n in [x.split()[0] for x in BODY.split(", ")]]
    return e.select("e.source", "e.subject", F.col("e.namespace").alias("initiator"), "e.userId", "e.eventType", F.timestamp_millis(F.col("e.timestamp")).alias("ts"), F.coalesce(S.namespace_of(b["name"]), F.col("e.namespace")).alias("namespace"), S.action_of(b["name"]).alias("action"), *fields)


def bad_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """The texts that parse_events() leaves out, for a side table."""
    e = F.from_json(col, ENVELOPE)
    return raw.where(e["body"].isNull() | e["timestamp"].isNull())


def with_watermark(ev: DataFrame, delay: str = WATERMARK, once: bool = True) -> DataFrame:
    """Watermark on a stream, and each activation once; on a batch frame only the latter."""
    if ev.isStreaming:
        ev = ev.withWatermark("ts", delay)
        return ev.dropDuplicatesWithinWatermark(["activationId"]) if once else ev
    return ev.dropDuplicates(["activationId"]) if once else ev


def exclude_namespaces(ev: DataFrame, names: Sequence[str], col: str = "namespace") -> DataFrame:
    return ev.where(~F.coalesce(F.col(col).isin(list(names)), F.lit(False)))


def rename_tags(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def _windowed(ev: DataFrame, window: str, *keys: str | Column):  # noqa: ANN202
    return ev.groupBy(F.window("ts", window).alias("w"), *keys)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), *[c for c in df.columns if c != "w"])


def global_counters(ev: DataFrame, window: str = "1 hour") -> DataFrame:
    """Activations, metrics, each status, failures (status other than success) and cold starts."""
    act = F.col("metricName").isNull()
    counts = {"activations": act, "metrics": ~act, **{name: act & (F.col("statusCode") == k) for k, name in enumerate(S.STATUS_NAMES)}, "failures": act & (F.col("statusCode") != 0), "cold_starts": act & S.is_cold_start("initTime")}
    return _flat(_windowed(ev, window).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]))


def action_counters(ev: DataFrame, window: str = "1 hour") -> DataFrame:
    """By namespace, initiator, action, kind and memory: activations, cold starts, statuses and user status codes set."""
    act = ev.where(F.col("metricName").isNull())
    return _flat(_windowed(act, window, "namespace", "initiator", "action", "kind", "memory").agg(
        F.count("*").alias("activations"), F.count_if(S.is_cold_start("initTime")).alias("cold_starts"),
        *[F.count_if(F.col("statusCode") == k).alias(n) for k, n in enumerate(S.STATUS_NAMES)], F.count("userDefinedStatusCode").alias("user_statuses")))


def action_timings(ev: DataFrame, window: str = "1 hour", edges: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    """Count, sum and buckets of wait and run times, of init times of cold starts and of sizes where present."""
    act = ev.where(F.col("metricName").isNull())
    values = {"wait": F.col("waitTime"), "run": F.col("duration"), "init": F.when(S.is_cold_start("initTime"), F.col("initTime")), "size": F.col("size")}
    aggs = [a for n, v in values.items() for a in (F.count(v).alias(f"{n}_count"), F.coalesce(F.sum(v), F.lit(0)).alias(f"{n}_sum"), *[F.count_if(v <= e).alias(f"{n}_le_{e}") for e in edges])]
    return _flat(_windowed(act, window, "namespace", "action").agg(*aggs))


def last_gauge(ev: DataFrame, value: str = "memory", window: str = "1 hour", keys: Sequence[str] = ("namespace", "action")) -> DataFrame:
    """The value reported last; of equal times the largest activation id's."""
    return _flat(_windowed(ev.where(F.col("metricName").isNull()), window, *keys).agg(F.max_by(value, F.struct("ts", "activationId")).alias(value)))


def limit_counters(ev: DataFrame, window: str = "1 hour") -> DataFrame:
    """How often a namespace met its limits; other metrics are ignored."""
    m = ev.where(F.col("metricName").isin(*LIMIT_METRICS))
    return _flat(_windowed(m, window, "initiator").agg(*[F.count_if(F.col("metricName") == n).alias(n) for n in LIMIT_METRICS]))


def minute_requests(ev: DataFrame, limit: int, key: str = "namespace") -> DataFrame:
    """Requests by key and calendar minute, and how many exceed the limit."""
    out = _flat(_windowed(ev, "1 minute", key).agg(F.count("*").alias("requests")))
    return out.withColumn("over_limit", F.greatest(F.col("requests") - limit, F.lit(0)))


def pair_begin_finish(begin: DataFrame, finish: DataFrame, within: str = "1 hour", delay: str = WATERMARK, key: str = "id") -> DataFrame:
    """Begin and finish of an id, finish not before begin and within a time, with the milliseconds between; the rest has no row.

    On streams both sides carry watermarks, so state older than the bound is let go.
    """
    b = begin.select(F.col(key).alias("id"), F.col("ts").alias("began"))
    f = finish.select(F.col(key).alias("__id"), F.col("ts").alias("finished"))
    if b.isStreaming:
        b, f = b.withWatermark("began", delay), f.withWatermark("finished", delay)
    bound = F.expr(f"id = __id AND finished >= began AND finished <= began + INTERVAL {within}")
    return b.join(f, bound).select("id", "began", "finished", (F.unix_millis(F.col("finished").cast("timestamp")) - F.unix_millis(F.col("began").cast("timestamp"))).alias("duration_ms"))


def change_messages(changes: DataFrame, own: str | None) -> DataFrame:
    """Change feed to invalidation messages: those of other clusters, with their lag behind the feed."""
    from ..operators.records import foreign_changes

    return foreign_changes(changes, own).select("_id", "clusterId", S.change_lag("token", "lsn").alias("lag"))


def timing_sketches(ev: DataFrame, value: str = "duration", window: str = "1 minute", keys: Sequence[str] = ("namespace", "action"), k: int = 400) -> DataFrame:
    """A mergeable KLL sketch of a time by window and keys: window_start, keys, n, sketch. Sketches are small whatever they count."""
    act = ev.where(F.col("metricName").isNull() & F.col(value).isNotNull())
    return _flat(_windowed(act, window, *keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_bigint(value, k).alias("sketch")))


def merged_quantiles(sketches: DataFrame, window: str = "1 hour", quantiles: Sequence[float] = (0.5, 0.9, 0.99), keys: Sequence[str] = ("namespace", "action"), k: int = 400) -> DataFrame:
    """Sketches of short windows merged to longer ones, and their quantiles: window_start, keys, n, q50, q90 and so on."""
    merged = sketches.groupBy(F.window("window_start", window).alias("w"), *keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    at = {f"q{q * 100:g}".replace(".", "_"): F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))) for q in quantiles}
    return merged.select(F.col("w.start").alias("window_start"), *keys, "n", *[v.alias(n) for n, v in at.items()])


def pair_or_time_out(begin: DataFrame, finish: DataFrame, within: str = "1 hour", delay: str = WATERMARK, key: str = "id") -> DataFrame:
    """pair_begin_finish() with a row for each begin that no finish met in time (finished and duration null). On streams such a row comes
    when the watermark has passed the begin's time and the bound."""
    b = begin.select(F.col(key).alias("id"), F.col("ts").alias("began"))
    f = finish.select(F.col(key).alias("__id"), F.col("ts").alias("finished"))
    if b.isStreaming:
        b, f = b.withWatermark("began", delay), f.withWatermark("finished", delay)
    out = b.join(f, F.expr(f"id = __id AND finished >= began AND finished <= began + INTERVAL {within}"), "left")
    return out.select("id", "began", "finished", (F.unix_millis(F.col("finished").cast("timestamp")) - F.unix_millis(F.col("began").cast("timestamp"))).alias("duration_ms"))


def read_changes(raw: DataFrame, col: str = "value") -> DataFrame:
    """Change feed messages (JSON: _id, clusterId, token, lsn) to rows; other texts drop out."""
    kind = "_id string, clusterId string, token string, lsn bigint"
    return raw.select(F.explode(F.array(F.from_json(col, kind))).alias("c")).where("c._id is not null").select("c.*")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """Starts a query that takes what is there and ends; files are the sink."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
