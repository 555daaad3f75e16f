"""Telemetry, benchmark and load-test reports, log latencies, event dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import series
from ..sources.logs import RESOURCES, parse_resource_log
from ..sources.tables import shared_path

LATENCIES = ("ta", "ad", "oea", "oer", "ora", "rtt", "ortt", "d")
COUNTERS = ("attempts", "invocations", "activations", "requests")


def element_profile(points: DataFrame, element: str = "name", activation: str = "activation", measures: Sequence[str] = ("cpu", "memory")) -> DataFrame:
    """Mean by activation, then the largest of an element's activations."""
    by = points.groupBy(element, activation).agg(*[F.avg(m).alias(m) for m in measures])
    return by.groupBy(element).agg(*[F.max(m).alias(m) for m in measures])


def peer_profile(points: DataFrame, peer: str, element: str = "name", activation: str = "activation") -> DataFrame:
    """element_profile() of the bytes received from and sent to one peer."""
    net = F.try_element_at("network", F.lit(peer))
    return element_profile(points.withColumns({"rx": net["rx"], "tx": net["tx"]}), element, activation, ("rx", "tx"))


def utilisation_report(lines: DataFrame, pools: Sequence[str] = ("pool1", "pool2", "pool3"), offset: float = 0.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Resource log lines to elapsed seconds and percent used of each pool's resources. Lines are parsed once into a written stage, which the minimum, the maxima and the rows read."""
    parsed = parse_resource_log(lines, pools)
    rows = parsed.sparkSession.read.schema(parsed.schema).parquet(_stage(parsed, "resources"))
    cols = [f"{p}_{r}" for p in pools for r in RESOURCES]
    return series.utilisation(series.elapsed(rows, F.col("ts") / 1000.0, offset, low, high), cols)


def _stage(df: DataFrame, name: str) -> str:
    df.write.parquet(path := shared_path(df.sparkSession, name))
    return path


def overhead_report(df: DataFrame, labels: Sequence[str] | None = None, skip_time: float | None = None) -> DataFrame:
    """Overhead by element of each configuration (chain_length / func_time), one column a label, largest group first."""
    rows = series.overhead(df, "func_time", "chain_length")
    if skip_time is not None:
        rows = rows.where(F.col("func_time") != skip_time)
    rows = rows.withColumn("group", F.concat_ws(" / ", "chain_length", "func_time"))
    return series.pivot_report(rows, "group", "label", "per_unit", labels).orderBy(F.desc("group"))


def config_label(system: str, prewarmed: str, cold: str):  # noqa: ANN201
    """``<system> w/ Prewarming - Cold`` and the like."""
    return F.concat(F.col(system), F.when(F.col(prewarmed), " w/ Prewarming").otherwise(" w/o Prewarming"), F.when(F.col(cold), " - Cold").otherwise(" - Warm"))


def percent_overhead(df: DataFrame, func_time: float, by: Sequence[str]) -> DataFrame:
    """Overhead in percent of a function time, mean by configuration."""
    rows = df.where(F.col("func_time") == func_time).withColumn("percent", F.col("overhead_per_object") * 100.0 / F.col("func_time"))
    return rows.groupBy(*by).agg(F.avg("percent").alias("percent")).orderBy(*by)


def bench_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"), F.count("*").alias("n")).orderBy(*by)


def load_samples(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Load-test samples (client, bi, ts, as, ae, d, ai, taidError, aaidError) with their counts and, for whole invocations inside [start, stop], latency spans.

    A sample begun outside the window counts nowhere; a failed one is a request and an error; a trigger inside the window is
    an activation of its own.
    """
    begun = F.col("bi").between(start, stop)
    t_err, a_err = F.col("taidError").isNotNull(), F.col("aaidError").isNotNull()
    trigger = begun & ~t_err & F.coalesce(F.col("ts").between(start, stop), F.lit(False))
    failed = begun & (t_err | a_err)
    whole = begun & ~t_err & ~a_err & F.coalesce((F.col("as") >= start) & (F.col("ae") <= stop), F.lit(False))
    spans = {"d": F.col("d"), "ta": F.col("as") - F.col("ts"), "ad": F.col("ae") - F.col("as"), "oea": F.col("as") - F.col("bi"), "oer": F.col("ae") - F.col("bi") - F.col("d"), "ora": F.col("ai") - F.col("ae"), "rtt": F.col("ai") - F.col("bi"), "ortt": F.col("ai") - F.col("bi") - F.col("d")}
    one = lambda c: c.cast("long")
    return df.select(
        "client", one(begun).alias("attempts"), one(whole).alias("invocations"), (one(trigger) + one(whole)).alias("activations"),
        (one(failed) + one(trigger) + one(whole)).alias("requests"), one(failed).alias("errors"), *[F.when(whole, spans[k]).alias(k) for k in LATENCIES],
    )


def latency_summary(samples: DataFrame, compat: bool = False) -> DataFrame:
    """Rows (span, avg, std, min, max, n) of load_samples(). Averages are over the spans that exist; compat skips zeros and divides by all invocations."""
    value = (lambda k: F.when(F.col(k) != 0, F.col(k))) if compat else F.col
    n = F.sum("invocations")
    rows = []
    for k in LATENCIES:
        v = value(k)
        if compat:
            avg = F.sum(v) / n
            std = F.sqrt(F.sum(v * v) / n - avg * avg)
        else:
            avg, std = F.avg(v), F.stddev_pop(v)
        rows.append(F.struct(F.lit(k).alias("span"), avg.cast("double").alias("avg"), std.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")))
    return samples.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def throughput_summary(samples: DataFrame, seconds: float, apart: object) -> DataFrame:
    """Rows (counter, total, per_second, without, percent_difference), without leaving one client out, and errors with their percent of requests."""
    rows = []
    for k in COUNTERS:
        total, rest = F.sum(k), F.sum(F.when(F.col("client") != apart, F.col(k)).otherwise(0))
        rows.append(F.struct(F.lit(k).alias("counter"), total.alias("total"), (total / seconds).alias("per_second"), (rest / seconds).alias("without"), F.try_divide((total - rest) * 100.0, total).alias("percent")))
    rows.append(F.struct(F.lit("errors").alias("counter"), F.sum("errors").alias("total"), F.lit(None).cast("double").alias("per_second"), F.lit(None).cast("double").alias("without"), F.try_divide(F.sum("errors") * 100.0, F.sum("requests")).alias("percent")))
    return samples.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def marker_table(lines: DataFrame, tid_at: int = 2, col: str = "value", order: str = "line_no") -> DataFrame:
    """Marker lines to (tid, stage, millis, line_no)."""
    m = S.marker(col)
    return lines.select(S.transaction_id(col, tid_at).alias("tid"), S.marker_stage(m).alias("stage"), S.marker_millis(m).alias("millis"), F.col(order).alias("line_no")).where("millis is not null")


def marker_cdfs(lines: DataFrame, tid_at: int = 2) -> DataFrame:
    """Distribution of all latencies of each marker."""
    return series.cdf(marker_table(lines, tid_at), "millis", "stage")


def pipeline_cdfs(lines: DataFrame, pairs: Sequence[tuple[str, str]], tid_at: int = 2) -> DataFrame:
    """Distribution of each pair's stage latencies."""
    return series.cdf(series.stage_latencies(marker_table(lines, tid_at), "tid", "stage", "millis", "line_no", pairs), "latency", "pair")


def dashboard(ev: DataFrame, k: int = 10) -> DataFrame:
    """Panels (panel, label, value) over activation events: totals, means, starts by state and top-k lists; none of an empty table.

    One pass over grouped sums: grouping sets make all panels at once, and one ranked window keeps the k largest of each list.
    """
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    tops = ("namespace", "memory", "kind", "name")
    base = ev.where(F.col("metricName").isNull()).groupBy(*[label(c) for c in tops]).agg(
        F.count("*").alias("n"), F.sum("waitTime").alias("wait"), F.sum("size").alias("size"), F.count("size").alias("sized"), F.count_if(S.is_cold_start("initTime")).alias("cold"))
    sums = base.groupingSets([*[[c] for c in tops], []], *tops).agg(F.grouping_id().alias("of"), *[F.sum(c).alias(c) for c in ("n", "wait", "size", "sized", "cold")])
    row = lambda panel, name, value: F.struct(F.lit(panel).alias("panel"), name.alias("label"), value.cast("double").alias("value"))
    none = F.lit("")
    rows = F.array(row("activations", none, F.col("n")), row("mean_wait", none, F.try_divide("wait", "n")), row("mean_size", none, F.try_divide("size", "sized")), row("starts", F.lit("cold"), F.col("cold")), row("starts", F.lit("warm"), F.col("n") - F.col("cold")))
    for i, c in enumerate(tops):
        rows = F.when(F.col("of") == (15 ^ (8 >> i)), F.array(row(f"top_{c}", F.col(c), F.col("n")))).otherwise(rows)
    out = sums.select(F.explode(rows).alias("p")).select("p.*")
    nth = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("value"), "label"))
    return out.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


#: Panels of counters, by the labels that their lines keep, and of gauges, a line an instance.
COUNTER_PANELS = {"expired_prewarms": ("containerPool_prewarmExpired", ("kind", "memory")), "prewarm_coldstarts": ("containerPool_prewarmColdstart", ("kind", "memory")), "container_starts": ("invoker_containerStart", ("containerState",))}
GAUGE_PANELS = {"prewarm_containers": "containerPool_prewarmCount", "active_containers": "containerPool_activeCount"}


def container_panels(samples: DataFrame, interval: str, order: Sequence[str] = ()) -> DataFrame:
    """Container panels of scraped samples (metric, instance, kind, memory, containerState, ts, value): panel, label, window_start, value.

    Counters are the growth of each series, restarts included, by interval, summed over the instances by the panel's labels; gauges are
    the last value of an instance in each interval. Panels of one interval are one pass over the samples.
    """
    labels = ("metric", "instance", "kind", "memory", "containerState")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counters = samples.where(F.col("metric").isin([m for m, _ in COUNTER_PANELS.values()])).withColumn("series", F.concat_ws("\x1f", *[text(c) for c in labels]))
    grown = series.increase(counters.select("series", "ts", "value", *order), "series", "ts", "value", interval, order)
    part = F.split("series", "\x1f")
    grown = grown.select(*[part[i].alias(c) for i, c in enumerate(labels)], "window_start", "increase")
    line = F.coalesce(*[F.when(F.col("metric") == m, F.struct(F.lit(p).alias("panel"), F.concat_ws(" ", *[F.col(c) for c in by]).alias("label"))) for p, (m, by) in COUNTER_PANELS.items()])
    rows = grown.groupBy(line.alias("line"), "window_start").agg(F.sum("increase").alias("value")).select("line.*", "window_start", "value")
    gauges = samples.where(F.col("metric").isin(list(GAUGE_PANELS.values())))
    panel = F.coalesce(*[F.when(F.col("metric") == m, F.lit(p)) for p, m in GAUGE_PANELS.items()])
    last = gauges.groupBy(panel.alias("panel"), F.col("instance").alias("label"), F.window("ts", interval).alias("w")).agg(F.max_by("value", F.struct("ts", *order)).alias("value"))
    return rows.unionByName(last.select("panel", "label", F.col("w.start").alias("window_start"), F.col("value").cast("double").alias("value")))
