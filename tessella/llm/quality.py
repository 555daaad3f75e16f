"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by flattened arrays.

``document_statistics`` maps a whole text to a fixed row of numbers. Trees are grown on a sample of labelled documents of at
most ``FIT_ROWS`` rows (the documented bound of what reaches the driver: rows of statistics, no texts), chosen by a hash of
doc_id (of documents with repeated identifiers, at most twice as many rows). Each statistic is cut into at most 64 bins at quantiles of the sample; a tree splits on histograms of gradients. All
trees lie in one set of arrays (feature, threshold, children, value); a batch of documents walks them level by level in
numpy. The model, some 100 kB, goes to the tasks with the function.

Defined cases: null and empty texts have statistics of an empty text and get a score like any other; documents with several
labels take the mean of their labels, half and half being no label; rows with a null label or doc_id teach nothing; with no
labels, or labels of one kind, the score is the smoothed share of label 1 (0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the trees may be fitted on.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LAMBDA, LEAST = 60, 4, 0.2, 64, 1.0, 5
ACCEPT = 0.7

STATISTICS = (
    "log_bytes", "log_words", "letters", "upper", "digits", "marks", "spaces", "high_bytes", "word_bytes", "distinct_words", "top_word",
    "repeat_next", "marked_words", "upper_words", "short_words", "lone_marks", "log_lines", "distinct_lines", "stops", "word_entropy", "mark_variety",
)
_KIND = np.zeros(256, np.int64)
_KIND[list(range(97, 123))] = 1
_KIND[list(range(65, 91))] = 2
_KIND[list(range(48, 58))] = 3
_KIND[list(range(128, 256))] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_MARK = [c for c in range(33, 127) if _KIND[c] == 0]
_STRIP = bytes(c for c in range(33, 127) if _KIND[c] == 0)


def document_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, by_byte, 6)
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    each = np.fromiter(counts.values(), np.float64, len(counts))
    share = each / m
    repeated = sum(map(bytes.__eq__, words[1:], words)) if len(words) > 1 else 0
    marked = upper = short = lone = 0
    for w, c in counts.items():
        last = w[-1]
        if last < 128 and not (48 <= last <= 57 or 65 <= last <= 90 or 97 <= last <= 122):
            marked += c
            if not w.strip(_STRIP):
                lone += c
        if len(w) > 1 and w.isupper():
            upper += c
        if len(w) <= 2:
            short += c
    lines = [x for x in raw.split(b"\n") if x]
    marks = by_byte[_MARK]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (kinds[1] + kinds[2] + kinds[4]) / n, kinds[2] / n, kinds[3] / n, kinds[0] / n, kinds[5] / n, kinds[4] / n,
        (n - kinds[5]) / m, len(counts) / m, each.max(initial=0) / m, repeated / m, marked / m, upper / m, short / m, lone / m, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), (by_byte[46] + by_byte[44]) / m, float(-(share * np.log(share)).sum()) / np.log(m + 1.0), int((marks > 0).sum()),
    ]


@dataclass
class Trees:
    """All trees flattened: node i sends a row to left[i] if x[feature[i]] <= threshold[i], else to right[i]; leaves lead to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return out + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Logistic loss, Newton leaf values, splits by histograms over quantile bins."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), base)
        columns = np.arange(x.shape[1]) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int, g: np.ndarray = g, h: np.ndarray = h, margin: np.ndarray = margin) -> int:
                me = len(nodes)
                nodes.append([0, np.inf, me, me, 0.0])
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * LEAST:
                    flat = (binned[rows] + columns).ravel()
                    shape = (x.shape[1], BINS)
                    gl, hl, nl = (np.cumsum(np.bincount(flat, w, columns[-1] + BINS).reshape(shape), axis=1) for w in (np.repeat(g[rows], x.shape[1]), np.repeat(h[rows], x.shape[1]), np.ones(len(flat))))
                    gain = gl**2 / (hl + LAMBDA) + (gs - gl) ** 2 / (hs - hl + LAMBDA) - gs**2 / (hs + LAMBDA)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        best = (int(f), int(b))
                if best is None:
                    nodes[me][4] = -rate * gs / (hs + LAMBDA)
                    margin[rows] += nodes[me][4]
                    return me
                f, b = best
                low = binned[rows, f] <= b
                nodes[me][:2] = f, cuts[f][b]
                nodes[me][2] = grow(rows[low], level + 1)
                nodes[me][3] = grow(rows[~low], level + 1)
                return me

            roots.append(grow(np.arange(len(y)), 0))
    flat = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    return Trees(np.array(roots, np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], base, depth)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([document_statistics(t) for t in texts], dtype=object)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from the labelled documents that satisfy ``learn``, at most fit_rows of them (chosen by a hash of doc_id)."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("__y")).dropna()
    if learn is not None:
        known = known.withColumnRenamed("__id", "doc_id").where(learn).withColumnRenamed("doc_id", "__id")
    known = known.groupBy("__id").agg(F.avg("__y").alias("__y")).where("__y <> 0.5")
    n = known.count()
    # a little over the bound by hash, then the first of them in a fixed order: reruns agree
    share = min(1 << 30, int((1 << 30) * min(1.0, fit_rows / max(1, n) * 1.02) + 1))
    key = F.xxhash64("__id")
    known = known.where(F.pmod(key, F.lit(1 << 30)) < share).orderBy(key, "__id").limit(fit_rows)
    # at most fit_rows pairs of numbers are broadcast, so the documents' texts aren't shuffled for a sample of them
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id").select("__id", statistics_udf("__text").alias("x"), (F.col("__y") > 0.5).cast("int").alias("y"))
    found = rows.orderBy(key, "__id", "x").limit(2 * fit_rows).collect()
    x = np.array([r["x"] for r in found], np.float64).reshape(len(found), len(STATISTICS))
    return fit_trees(x, np.array([r["y"] for r in found], np.float64))


def score(model: Trees, text: str | Column = "text") -> Column:
    """Score of each whole text, 0 to 1; the document's other columns stay in the JVM."""

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([document_statistics(t) for t in s], np.float64).reshape(len(s), len(STATISTICS))
            yield pd.Series(model.score(x))

    return of(F.col(text) if isinstance(text, str) else text)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
