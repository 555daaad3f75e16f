"""Column operators: value counts, modes, duplicates, dense codes, membership, lookups, positions. Every order is an explicit column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import clean_keys, with_positions


def value_counts(df: DataFrame, c: str, dropna: bool = True) -> DataFrame:
    df = clean_keys(df.select(c), c)
    return (df.where(F.col(c).isNotNull()) if dropna else df).groupBy(c).agg(F.count("*").alias("n"))


def mode_all(df: DataFrame, c: str, dropna: bool = True) -> DataFrame:
    """All values of the largest count; the maximum is one row beside one row a value."""
    counts = value_counts(df, c, dropna)
    most = counts.agg(F.max("n").alias("__most"))
    return counts.join(F.broadcast(most), F.col("n") == F.col("__most")).drop("__most")


def duplicated(df: DataFrame, cols: Sequence[str], order_by: str, keep: str | bool = "first", out: str = "is_duplicate") -> DataFrame:
    """Flags rows that repeat an earlier one (keep first), a later one (last) or any other (False).

    The kept row of a value is found by map-side minimum or maximum of order_by (unique) and joined back, so a value of any
    frequency is aggregated before it moves.
    """
    return duplicates(df, cols, order_by, {out: keep})


def duplicates(df: DataFrame, cols: Sequence[str], order_by: str, flags: Mapping[str, str | bool]) -> DataFrame:
    """Several flags of duplicated() (name -> keep) by one aggregate and one join."""
    if set(flags.values()) - {"first", "last", False}:
        raise ValueError("keep must be 'first', 'last' or False")
    stats = df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)]).agg(F.count("*").alias("__n"), F.min(order_by).alias("__first"), F.max(order_by).alias("__last"))
    same = None
    for i, c in enumerate(cols):
        term = F.col(c).eqNullSafe(F.col(f"__k{i}"))
        same = term if same is None else same & term
    flag = {"first": F.col("__first") != F.col(order_by), "last": F.col("__last") != F.col(order_by), False: F.col("__n") > 1}
    return df.join(stats, same).select(*df.columns, *[flag[keep].alias(out) for out, keep in flags.items()])


def factorize(df: DataFrame, c: str, order_by: str, prior: DataFrame | None = None, out: str = "code") -> DataFrame:
    """Dense codes in the order in which values are first seen, missing ones -1; with prior (value, code) numbering continues.

    Only distinct values are numbered, by ranges of their first place.
    """
    df = clean_keys(df, c)
    return lookup_code(df, dictionary(df, c, order_by, prior), c, "value", "code", out)


def dictionary(df: DataFrame, c: str, order_by: str, prior: DataFrame | None = None) -> DataFrame:
    """(value, code) of factorize()."""
    seen = clean_keys(df, c).where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min(order_by).alias("__first"))
    if prior is not None:
        seen = seen.join(prior.select(F.col("value").alias("__v")), F.col("value") == F.col("__v"), "left_anti")
    new = with_positions(seen, ["__first", "value"], "code").select("value", F.col("code").cast("long").alias("code"))
    if prior is None:
        return new
    start = prior.agg((F.coalesce(F.max("code"), F.lit(-1)) + 1).alias("__start"))
    return prior.select("value", F.col("code").cast("long")).unionByName(new.crossJoin(F.broadcast(start)).select("value", (F.col("code") + F.col("__start")).alias("code")))


def lookup_code(df: DataFrame, codes: DataFrame, key: str, value: str = "value", code: str = "code", out: str = "code") -> DataFrame:
    """Code of each row's key, -1 if the dictionary lacks it."""
    d = codes.select(F.col(value).alias("__v"), F.col(code).alias("__c"))
    return df.join(d, F.col(key) == F.col("__v"), "left").withColumn(out, F.coalesce("__c", F.lit(-1))).drop("__v", "__c")


def build_lookup(df: DataFrame, key: str, val: str, order_by: str) -> DataFrame:
    """Key to the value written last."""
    return clean_keys(df, key).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(val, order_by).alias(val))


def member_flag(left: DataFrame, right: DataFrame, key: str, out: str = "is_member", rkey: str | None = None) -> DataFrame:
    keys = clean_keys(right, rkey or key).select(F.col(rkey or key).alias("__k")).where("__k is not null").distinct()
    return clean_keys(left, key).join(keys, F.col(key) == F.col("__k"), "left").withColumn(out, F.col("__k").isNotNull()).drop("__k")


def first_positions(df: DataFrame, label: str, pos: str) -> DataFrame:
    """First position of each label but -1, in order of labels."""
    return df.where(F.col(label) != -1).groupBy(label).agg(F.min(pos).alias("first_pos")).orderBy(label)


def group_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def group_sort(df: DataFrame, label: str, then: Sequence[str] = ()) -> DataFrame:
    """Rows dealt by ranges of the label and sorted in each partition: read in order of partitions they are grouped."""
    return df.repartitionByRange(label, *then).sortWithinPartitions(label, *then)


def take_positions(df: DataFrame, idx_df: DataFrame, idx_col: str, pos: str = "pos") -> DataFrame:
    """Rows of df (with a position column) at the positions that idx_df lists, repeats included."""
    return idx_df.select(F.col(idx_col).alias("__at")).join(df, F.col("__at") == F.col(pos)).drop("__at")


def column_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: low_<c> and high_<c> of every column, in one pass."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("low", F.min), ("high", F.max))])
