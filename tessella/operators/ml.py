"""Min-max scaling, k folds, logistic regression by full-batch gradient descent, cross-validation.

The gradient is that of the squared error through the sigmoid: err * p * (1 - p). Rows are packed once into blocks of numbers; each
epoch is one aggregate over all blocks for all folds at once; only folds x (features + 1) numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import discard, shared_path
from .columns import column_minmax


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column to 0-1; constant columns become null."""
    stats = column_minmax(df, cols)  # one row
    scaled = df.crossJoin(F.broadcast(stats)).withColumns({c: S.min_max(c, F.col(f"low_{c}"), F.col(f"high_{c}")) for c in cols})
    return scaled.drop(*stats.columns)


def kfold(df: DataFrame, k: int, seed: int, key: str, out: str = "fold", slice_rows: int = 500_000) -> DataFrame:
    """Fold 0..k-1 by a seeded random order of keys (unique); folds are equal, the n mod k rows that come last drop out.

    The order is that of 60 bits of an md5 of key and seed. Positions are counted in slices of the hash range of some ``slice_rows``
    rows and shifted by the slices before, so no task orders all rows.
    """
    slices = max(1, -(-df.count() // slice_rows))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("__h", h).withColumn("__s", F.floor(F.col("__h") / F.lit(float(1 << 60) / slices)))
    sizes = rows.groupBy("__s").agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy()
    before = sizes.select("__s", (F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).alias("__before"), F.sum("__n").over(all_).alias("__all"))  # one row a slice
    pos = F.col("__before") + F.row_number().over(Window.partitionBy("__s").orderBy("__h", key)) - 1
    numbered = rows.join(F.broadcast(before), "__s").withColumn("__pos", pos).where(F.col("__pos") < F.floor(F.col("__all") / k) * k)
    return numbered.withColumn(out, F.pmod("__pos", F.lit(k)).cast("int")).drop("__h", "__s", "__n", "__before", "__all", "__pos")


def _features(features: Sequence[str] | str) -> Column:
    return F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])


def blocks(df: DataFrame, features: Sequence[str] | str, label: str, fold: str | None = None) -> tuple[DataFrame, int]:
    """Rows that a model can learn from, as blocks of numbers (x row by row, y, f) of a batch each, and the number of features. Rows that
    miss a feature, the label or the fold teach nothing."""
    rows = df.select(_features(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("long").alias("f"))
    width = max(0, rows.select(F.max(F.size("x"))).first()[0] or 0)
    whole = (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull() & F.col("f").isNotNull()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, f = b.column("x").flatten(), b.column("y"), b.column("f")
                yield pa.RecordBatch.from_pydict({n: pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for n, c in (("x", x), ("y", y), ("f", f))})

    return rows.where(whole).withColumn("x", F.transform("x", lambda v: v.cast("double"))).mapInArrow(pack, "x binary, y binary, f binary"), width


def _gradients(parts: DataFrame, held: Sequence[int], c: np.ndarray) -> DataFrame:
    """Sums of the gradients of all models (h, d, n): in a task, of all its blocks, a row a model."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            for bx, by, bf in zip(*(b.column(k).to_pylist() for k in ("x", "y", "f")), strict=True):
                y, f = np.frombuffer(by)[:, None], np.frombuffer(bf, np.int64)[:, None]
                x = np.frombuffer(bx).reshape(len(y), c.shape[1] - 1)
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(c[:, 0] + x @ c[:, 1:].T)))
                learns = f != np.array(held)
                g = np.where(learns, (y - p) * p * (1 - p), 0.0)
                d[:, 0] += g.sum(axis=0)
                d[:, 1:] += g.T @ x
                n += learns.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"h": pa.array(held, pa.int64()), "d": pa.array(d.tolist(), pa.list_(pa.float64())), "n": pa.array(n)})

    each = parts.mapInArrow(of, "h long, d array<double>, n long").where("n > 0")
    return each.groupBy("h").agg(Summarizer.sum(array_to_vector("d")).alias("d"), F.sum("n").alias("n"))


def fit_logistic(df: DataFrame, features: Sequence[str] | str, label: str, epochs: int = 100, lr: float = 0.1, fold: str | None = None, k: int = 1) -> dict[int | None, list[float]]:
    """Coefficients (intercept first) of a model for each held-out fold, or of one model {None: ...}. Steps are lr times the mean gradient.
    Blocks are written first, so an epoch has as many tasks as their bytes ask for, not as the shuffle before them."""
    spark = df.sparkSession
    parts, width = blocks(df, features, label, fold)
    parts.write.parquet(path := shared_path(spark, "blocks"))
    parts = spark.read.schema(parts.schema).parquet(path).persist()
    held = list(range(k)) if fold else [-2]
    c = np.zeros((len(held), width + 1))
    try:
        for _ in range(epochs):
            for r in _gradients(parts, held, c.copy()).collect():
                c[held.index(r["h"])] += lr * r["d"].toArray() / r["n"]
    finally:
        parts.unpersist()
        discard(spark, path)
    return {h if fold else None: row.tolist() for h, row in zip(held, c, strict=True)}


def predict_logistic(df: DataFrame, features: Sequence[str] | str, coef: Sequence[float], out: str = "predicted") -> DataFrame:
    """Label 0 or 1: the probability rounded half to even."""
    return df.withColumn(out, F.rint(S.sigmoid_dot(F.transform(_features(features), lambda v: v.cast("double")), F.array(*[F.lit(float(c)) for c in coef]))))


def accuracy(df: DataFrame, actual: str = "label", predicted: str = "predicted", by: str | None = None) -> DataFrame:
    score = (F.avg((F.col(actual) == F.col(predicted)).cast("double")) * 100).alias("accuracy")
    return df.groupBy(by).agg(score) if by else df.agg(score)


def cross_validate(df: DataFrame, features: Sequence[str] | str, label: str, key: str, k: int = 5, seed: int = 1, epochs: int = 100, lr: float = 0.1) -> DataFrame:
    """Rows (fold, accuracy) of models that were trained without the fold, and their mean in the row without fold."""
    rows = kfold(df, k, seed, key)
    coef = fit_logistic(rows, features, label, epochs, lr, "fold", k)
    models = F.element_at(F.array(*[F.array(*[F.lit(v) for v in coef[h]]) for h in range(k)]), F.col("fold") + 1)
    scored = rows.withColumn("predicted", F.rint(S.sigmoid_dot(F.transform(_features(features), lambda v: v.cast("double")), models)))
    by = accuracy(scored.withColumn("label_", F.col(label).cast("double")), "label_", "predicted", "fold")
    return by.rollup("fold").agg(F.avg("accuracy").alias("accuracy")).orderBy(F.asc_nulls_last("fold"))
