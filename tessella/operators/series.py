"""Time series and sequences: counter rates, last-k windows, minute limits, running concurrency, distribution functions, pivots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .relational import WINDOW_ROWS, group_totals, largest_group, running_totals, with_positions

#: Rows of a block that a hot key is cut into.
BLOCK = 262_144


def look_back(df: DataFrame, key: str, order: Sequence[str], k: int, columns: Callable[[WindowSpec], Mapping[str, Column]], most: int = WINDOW_ROWS, block: int = BLOCK) -> DataFrame:
    """Adds columns that look at up to k rows before a row of its key, in an order.

    While no key has more than ``most`` rows, a window by key. Otherwise rows are numbered in the order of (key, order) by ranges and cut
    into blocks of ``block`` rows (more than k), each of which also gets the last k rows of the block before it: a hot key is as many
    tasks as it has blocks.
    """
    if largest_group(df, [key]) <= most:
        return df.withColumns(dict(columns(Window.partitionBy(key).orderBy(*order))))
    own, at = F.expr(f"__pos div {block}"), F.col("__pos") % block
    rows = with_positions(df, [key, *order], "__pos").withColumn("__block", F.explode(F.when(at >= block - k, F.array(own, own + 1)).otherwise(F.array(own))))
    out = rows.withColumns(dict(columns(Window.partitionBy("__block", key).orderBy("__pos"))))
    return out.where(F.col("__block") == own).drop("__block", "__pos")


def counter_rate(df: DataFrame, key: str, ts: str, c: str, order: Sequence[str] = (), out: str = "rate", most: int = WINDOW_ROWS, block: int = BLOCK) -> DataFrame:
    """Percent of elapsed time that a cumulative counter advanced; 0 for the first sample and for no elapsed time."""

    def rate(w: WindowSpec) -> dict[str, Column]:
        gone, grown = F.col(ts) - F.lag(ts).over(w), F.col(c) - F.lag(c).over(w)
        return {out: F.coalesce(F.when(gone > 0, grown * 100.0 / gone), F.lit(0.0))}

    return look_back(df, key, [ts, *order], 1, rate, most, block)


def _steps(df: DataFrame, key: str, ts: str, counters: Mapping[str, str], interval: str, order: Sequence[str], most: int, block: int) -> DataFrame:
    """Growth of counters by key and interval (w): one look back for all of them, then one aggregate."""

    def step(w: WindowSpec) -> dict[str, Column]:
        before = {n: F.lag(c).over(w) for n, c in counters.items()}
        return {f"__{n}": F.when(before[n].isNull(), 0.0).when(F.col(c) < before[n], F.col(c)).otherwise(F.col(c) - before[n]) for n, c in counters.items()}

    rows = look_back(df, key, [ts, *order], 1, step, most, block)
    return rows.groupBy(key, F.window(F.col(ts), interval).alias("w")).agg(*[F.sum(f"__{n}").alias(n) for n in counters])


def increase(df: DataFrame, key: str, ts: str, c: str, interval: str, order: Sequence[str] = (), most: int = WINDOW_ROWS, block: int = BLOCK) -> DataFrame:
    """Growth of a counter by interval: key, window_start, increase and rate per second. A fall is a restart from 0."""
    out = _steps(df, key, ts, {"increase": c}, interval, order, most, block)
    long = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return out.select(key, F.col("w.start").alias("window_start"), "increase", (F.col("increase") / long).alias("rate"))


def mean_from_counters(df: DataFrame, key: str, ts: str, total: str, count: str, interval: str, order: Sequence[str] = (), most: int = WINDOW_ROWS, block: int = BLOCK) -> DataFrame:
    """Growth of a sum over growth of its count, by interval; null where nothing was counted."""
    out = _steps(df, key, ts, {"total": total, "count": count}, interval, order, most, block)
    return out.select(key, F.col("w.start").alias("window_start"), F.try_divide("total", "count").alias("mean"))


def recent_error_state(df: DataFrame, key: str, ts: str, is_error: Column, last: int = 10, tolerance: int = 5, order: Sequence[str] = (), most: int = WINDOW_ROWS, block: int = BLOCK) -> DataFrame:
    """Errors among the last outcomes of each key; more than the tolerance is unhealthy."""
    out = look_back(df, key, [ts, *order], last - 1, lambda w: {"recent_errors": F.count_if(is_error).over(w.rowsBetween(1 - last, 0))}, most, block)
    return out.withColumn("healthy", F.col("recent_errors") <= tolerance)


def minute_rate(df: DataFrame, key: str, ts: str, limit: int, order: Sequence[str] = ()) -> DataFrame:
    """Number of a request inside its key's calendar minute, allowed while it is within the limit. A minute is the unit of a task's work."""
    w = Window.partitionBy(key, F.date_trunc("minute", F.col(ts))).orderBy(ts, *order)
    return df.withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.col("nth") <= limit)


def concurrency(df: DataFrame, key: str, start: str, end: str, limit: int, order: Sequence[str] = (), most: int = WINDOW_ROWS) -> DataFrame:
    """Others in flight at each arrival, allowed while below the limit. What ends at an instant has ended when another starts then.

    Arrivals are +1, ends -1, and their running sum by key counts who is there; of a key with more than ``most`` of them the sum goes by
    ranges of time, each range beginning with what those before it have left open.
    """
    ends = df.select(F.col(key).alias(key), F.col(end).alias("__t"), F.lit(0).alias("__kind"), F.lit(-1).alias("__d"))
    both = df.withColumns({"__t": F.col(start), "__kind": F.lit(1), "__d": F.lit(1)}).unionByName(ends, allowMissingColumns=True)
    places = ["__t", "__kind", *order]
    if largest_group(both, [key]) <= most:
        w = Window.partitionBy(key).orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = both.withColumn("in_flight", F.sum("__d").over(w) - 1)
    else:
        run = running_totals(both, [key, *places], "__d", "__open")
        first = run.groupBy(F.col(key).alias("__key")).agg(F.min_by("__open", F.struct(*places)).alias("__from"))
        run = run.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn("in_flight", F.col("__open") - F.col("__from")).drop("__key", "__from", "__open")
    return run.where("__kind = 1").drop("__t", "__kind", "__d").withColumn("allowed", F.col("in_flight") < limit)


def elapsed(df: DataFrame, ts: Column, offset: float = 0.0, low: float | None = None, high: float | None = None, out: str = "elapsed") -> DataFrame:
    """Seconds since the first sample less an offset; only what lies strictly inside (low, high)."""
    first = df.agg(F.min(ts).alias("__first"))  # one row
    out_df = df.crossJoin(F.broadcast(first)).withColumn(out, ts - F.col("__first") - offset).drop("__first")
    if low is not None:
        out_df = out_df.where(F.col(out) > low)
    return out_df.where(F.col(out) < high) if high is not None else out_df


def utilisation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percent used of what the largest free value shows to be there."""
    most = df.agg(*[F.max(c).alias(f"__{c}") for c in cols])  # one row
    used = df.crossJoin(F.broadcast(most)).withColumns({c: 100 - F.try_divide(F.col(c), F.col(f"__{c}")) * 100 for c in cols})
    return used.drop(*[f"__{c}" for c in cols])


def overhead(df: DataFrame, total: str, units: str) -> DataFrame:
    """Overhead by unit and in percent of the total time."""
    return df.withColumn("per_unit", F.try_divide(F.col("overhead"), F.col(units))).withColumn("percent", F.try_divide(F.col("overhead") * 100.0, F.col(total)))


def cdf(df: DataFrame, c: str, by: str | None = None, most: int = WINDOW_ROWS) -> DataFrame:
    """Share of values at or below each distinct value, zeros included: counts first, then a running sum over distinct values."""
    keys = [by] if by else []
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"))
    run = group_totals(counts, by, c, "n", "__before", "__all", most)
    return run.select(*keys, c, "n", ((F.col("__before") + F.col("n")) / F.col("__all")).alias("cdf"))


def histogram(df: DataFrame, c: str, low: float, width: float, n: int, by: str | None = None) -> DataFrame:
    """Linear buckets: how many values are at or below each upper edge, cumulative; the last edge is infinite."""
    keys = [by] if by else []
    edge = F.least(F.greatest(F.ceil((F.col(c) - low) / width), F.lit(0)), F.lit(n)).cast("int")
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, edge.alias("bucket")).agg(F.count("*").alias("n"))
    labels = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = labels.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n))))
    w = Window.partitionBy(*keys).orderBy("bucket")
    full = every.join(counts, [*keys, "bucket"], "left").withColumn("count", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "bucket", F.when(F.col("bucket") < n, F.lit(low) + F.col("bucket") * F.lit(width)).otherwise(F.lit(float("inf"))).alias("le"), F.sum("count").over(w).alias("cumulative"))


def pivot_report(df: DataFrame, index: str | Sequence[str], cols: str, val: str, labels: Sequence[str] | None = None, agg=F.first) -> DataFrame:  # noqa: ANN001
    """A column for each label; given labels fix their order and save a pass."""
    keys = [index] if isinstance(index, str) else list(index)
    g = df.groupBy(*keys)
    return (g.pivot(cols, list(labels)) if labels is not None else g.pivot(cols)).agg(agg(val))


def stage_latencies(df: DataFrame, tid: str, stage: str, millis: str, order: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per transaction and pair (from, to): to's time less from's. A stage's last line wins; missing and negative ones drop out."""
    stages = list(dict.fromkeys(s for p in pairs for s in p))
    last = df.groupBy(tid).agg(*[F.max_by(F.when(F.col(stage) == s, F.col(millis)), F.when(F.col(stage) == s, F.col(order))).alias(f"__{i}") for i, s in enumerate(stages)])
    at = {s: F.col(f"__{i}") for i, s in enumerate(stages)}
    rows = F.array(*[F.struct(F.lit(f"{a}->{b}").alias("pair"), (at[b] - at[a]).alias("latency")) for a, b in pairs])
    return last.select(tid, F.explode(rows).alias("x")).select(tid, "x.pair", "x.latency").where("latency >= 0")
