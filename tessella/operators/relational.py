"""Projection, filters, joins, grouped aggregates, top-k and concatenation.

Missing keys never join and form no group: NaN counts as missing, so ``clean_keys`` turns it into null first. Join sides are
broadcast only below a size that ``broadcast_limit`` checks; otherwise Spark chooses by its own statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_path

#: Rows of a group up to which a window takes the group in one task; larger ones go by ranges.
WINDOW_ROWS = 1_000_000


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def clean_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """NaN in floating-point keys becomes null."""
    floats = [k for k in _list(keys) if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({k: F.nanvl(F.col(k), F.lit(None).cast(df.schema[k].dataType)) for k in floats}) if floats else df


def drop_missing(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return clean_keys(df, keys).dropna(subset=_list(keys))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Some columns by a mapping, or all by a list of names."""
    return df.withColumnsRenamed(dict(mapping)) if isinstance(mapping, Mapping) else df.toDF(*mapping)


def inner_join(left: DataFrame, right: DataFrame, lkey: str | Sequence[str], rkey: str | Sequence[str], lcols: Sequence[str], rcols: Sequence[str]) -> DataFrame:
    """Many-to-many equality join; the chosen left columns, then the chosen right ones. Columns of the right side may share names with the left's keys."""
    lk, rk = _list(lkey), _list(rkey)
    left = clean_keys(left, lk).select(*dict.fromkeys([*lcols, *lk]))
    right = clean_keys(right, rk).select(*[F.col(c).alias(f"__r_{c}") for c in dict.fromkeys([*rcols, *rk])])
    on = [F.col(a) == F.col(f"__r_{b}") for a, b in zip(lk, rk, strict=True)]
    return left.join(right, on).select(*lcols, *[F.col(f"__r_{c}").alias(c) for c in rcols])


def broadcast_limit(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if df has at most so many rows, as a count that stops there finds; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_join(fact: DataFrame, dim: DataFrame, fkey: str, dkey: str, dcols: Sequence[str], max_rows: int = 100_000) -> DataFrame:
    """Fact columns and dimension columns; the dimension is sent whole to all tasks only while it has at most max_rows rows."""
    small = broadcast_limit(clean_keys(dim, dkey).select(F.col(dkey).alias("__d"), *[F.col(c).alias(f"__d_{c}") for c in dcols]), max_rows)
    return clean_keys(fact, fkey).join(small, F.col(fkey) == F.col("__d")).select(*fact.columns, *[F.col(f"__d_{c}").alias(c) for c in dcols])


def semi_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    return clean_keys(left, lkey).join(clean_keys(right, rkey).select(F.col(rkey).alias("__k")), F.col(lkey) == F.col("__k"), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    return clean_keys(left, lkey).join(clean_keys(right, rkey).select(F.col(rkey).alias("__k")), F.col(lkey) == F.col("__k"), "left_anti")


def with_group_avg(df: DataFrame, key: str, val: str, out: str = "group_avg") -> DataFrame:
    """Each row with the mean of its group: aggregated with map-side sums and joined back, so a large group is no single task."""
    means = df.groupBy(F.col(key).alias("__k")).agg(F.avg(val).alias(out))
    return df.join(means, F.col(key) == F.col("__k")).drop("__k")


def parts_for(*dfs: DataFrame, rows_each: int = 1_000_000) -> int:
    """Partitions for a deal of the larger table: one for so many rows, the session's shuffle partitions at least."""
    return max(int(dfs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), *[-(-d.count() // rows_each) for d in dfs])


def partitioned_join(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """Both sides dealt into n partitions by the key, then joined partition by partition without a further shuffle."""
    return clean_keys(left, key).repartition(n, key).join(clean_keys(right, key).repartition(n, key).hint("merge"), key)


def group_sum(df: DataFrame, keys: str | Sequence[str], val: str, out: str = "total") -> DataFrame:
    """Sum by present keys; a group of missing values only sums to 0."""
    return drop_missing(df, keys).groupBy(*_list(keys)).agg(F.coalesce(F.sum(val), F.lit(0)).alias(out))


def group_mean(df: DataFrame, keys: str | Sequence[str], val: str, out: str = "mean") -> DataFrame:
    return drop_missing(df, keys).groupBy(*_list(keys)).agg(F.avg(val).alias(out))


def keys_with_many(df: DataFrame, key: str, val: str, n: int = 1) -> DataFrame:
    """Keys that have more than n distinct values: duplicates collapse before the shuffle by key."""
    pairs = drop_missing(df.select(key, val), key).where(F.col(val).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n_distinct")).where(F.col("n_distinct") > n)


def group_apply(df: DataFrame, keys: str | Sequence[str], fn, schema: str, several: bool = False, rows_each: int = 50_000) -> DataFrame:  # noqa: ANN001
    """fn(pandas frame of a group) -> pandas frame, for functions that only the caller knows; a group must fit into a task. What Spark's own aggregates can say belongs to them.

    A call for each group costs some milliseconds. A fn that groups by the keys itself can take ``several`` whole groups a call: keys are
    dealt by hash into frames of some ``rows_each`` rows, or of one larger group."""
    rows = drop_missing(df, keys)
    if not several:
        return rows.groupBy(*_list(keys)).applyInPandas(fn, schema)
    # 0.0 and -0.0 are one key
    floating = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("float", "double")]
    frames = F.pmod(F.xxhash64(*[F.col(k) + F.lit(0.0) if k in floating else F.col(k) for k in _list(keys)]), F.lit(max(1, -(-rows.count() // rows_each))))
    return rows.groupBy(frames.alias("__frame")).applyInPandas(fn, schema)


def totals(df: DataFrame, distinct_col: str, sum_cols: Sequence[str]) -> DataFrame:
    return df.agg(F.countDistinct(distinct_col).alias("n_distinct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sum_cols])


def distinct_values(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    return df.select(*_list(cols)).distinct()


def top_k(df: DataFrame, keys: str | Sequence[str], val: str, k: int = 10, out: str = "total") -> DataFrame:
    """The k groups of largest total, ties by key."""
    return df.groupBy(*_list(keys)).agg(F.sum(val).alias(out)).orderBy(F.desc(out), *_list(keys)).limit(k)


def concat_tables(dfs: Sequence[DataFrame], ordinal: str = "part") -> DataFrame:
    """Rows of tables of one schema, with the number of the table; another schema is refused."""
    kinds = [[(f.name, f.dataType) for f in d.schema] for d in dfs]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("tables differ in columns or types")
    out = None
    for i, d in enumerate(dfs):
        part = d.withColumn(ordinal, F.lit(i))
        out = part if out is None else out.union(part)
    return out


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: one aggregate, combined before the shuffle."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def group_totals(counts: DataFrame, by: str | None, c: str, n: str, before: str, whole: str, most: int = WINDOW_ROWS) -> DataFrame:
    """Rows (by, c, n), distinct in (by, c), with the sum of n over the smaller c of their group and over the whole group: by a window
    while the largest group has at most ``most`` rows, else by ranges of (by, c), so a task never has more than its range."""
    keys = [by] if by else []
    if largest_group(counts, keys) <= most:
        w = Window.partitionBy(*keys)
        return counts.withColumn(before, F.sum(n).over(w.orderBy(c)) - F.col(n)).withColumn(whole, F.sum(n).over(w))
    run = running_totals(counts, [*keys, c], n, "__upto")
    if not by:
        return run.crossJoin(F.broadcast(run.agg(F.sum(n).alias(whole)))).withColumnRenamed("__upto", before)  # one row
    of = run.groupBy(F.col(by).alias("__by")).agg(F.min("__upto").alias("__from"), F.sum(n).alias(whole))
    return run.join(of, F.col(by).eqNullSafe(F.col("__by"))).withColumn(before, F.col("__upto") - F.col("__from")).drop("__by", "__from", "__upto")


def medians(df: DataFrame, c: str, by: str | None = None, out: str = "median", most: int = WINDOW_ROWS) -> DataFrame:
    """Exact median of present values: one row, or one a group (column ``by``). Equal values are counted before they move; distinct ones
    are summed by group_totals()."""
    keys = [by] if by else []
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("__n"))
    run = group_totals(counts, by, c, "__n", "__before", "__all", most)
    holds = lambda at: (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    two = run.where(holds(low) | holds(high)).groupBy(*keys).agg(F.max(F.when(holds(low), F.col(c))).alias("__l"), F.max(F.when(holds(high), F.col(c))).alias("__h"))
    return two.select(*keys, ((F.col("__l") + F.col("__h")) / 2).alias(out))


def reject_outliers(df: DataFrame, c: str, m: float = 3, by: str | None = None) -> DataFrame:
    """Rows with abs(x - median) < m * population standard deviation, of all rows or of the row's group."""
    if by:
        stats = df.groupBy(F.col(by).alias("__by")).agg(F.stddev_pop(c).alias("__std"))
        stats = stats.join(medians(df, c, by, "__mid").withColumnRenamed(by, "__key"), F.col("__by") == F.col("__key")).drop("__key")
        joined = df.join(stats, F.col(by) == F.col("__by"))
    else:
        stats = df.agg(F.stddev_pop(c).alias("__std")).crossJoin(F.broadcast(medians(df, c, out="__mid")))  # one row each
        joined = df.crossJoin(F.broadcast(stats))
    return joined.where(F.abs(F.col(c) - F.col("__mid")) < m * F.col("__std")).select(*df.columns)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 0, most: int | None = None) -> DataFrame:
    """Rows [skip, skip + limit) in an order that must be unique; limit 0 means no limit, most caps it."""
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must not be negative")
    if most is not None:
        limit = most if limit == 0 else min(limit, most)
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out.limit(limit) if limit else out


def sort_documents(df: DataFrame, c: str, desc: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Numeric order, missing values as 0."""
    key = F.coalesce(F.col(c), F.lit(0))
    return df.orderBy(key.desc() if desc else key.asc(), *ties)


def slice_rows(df: DataFrame, start: int, end: int, order_by: Sequence[str]) -> DataFrame:
    """Rows [start, end) of a given order. Numbers are given partition by partition over a range-sorted table, not in one task."""
    return with_positions(df, order_by, "__pos").where((F.col("__pos") >= start) & (F.col("__pos") < end)).drop("__pos")


def _dealt(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges and sorted, with their partition and place in it. They are written once to the shared folder, for another run would draw other ranges."""
    id_ = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("__id", id_)
    ranged = ranged.withColumns({"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
    ranged.write.parquet(path := shared_path(df.sparkSession, "dealt"))
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def _shifted(ranged: DataFrame, size: Column, inside: Column, out: str) -> DataFrame:
    """inside plus the sizes of the partitions before; a row a partition is broadcast."""
    sizes = ranged.groupBy("__part").agg(size.alias("__size"))
    before = sizes.select(F.col("__part").alias("__of"), (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"))
    return ranged.join(F.broadcast(before), F.col("__part") == F.col("__of")).withColumn(out, F.col("__start") + inside).drop("__part", "__of", "__row", "__start")


def with_positions(df: DataFrame, order_by: Sequence[str], out: str = "pos") -> DataFrame:
    """Position of each row from 0 in an order without ties: its place inside its range plus the sizes of the ranges before."""
    return _shifted(_dealt(df, order_by), F.count("*"), F.col("__row"), out)


def running_totals(df: DataFrame, order_by: Sequence[str], weight: str, out: str) -> DataFrame:
    """Sum of weight over the rows before each row, in an order without ties, by ranges as in with_positions()."""
    w = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _shifted(_dealt(df, order_by), F.sum(weight), F.sum(weight).over(w) - F.col(weight), out)
