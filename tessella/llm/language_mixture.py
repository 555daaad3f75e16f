"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed character n-grams (two and three characters of lower-cased text, what isn't a
letter read as a space), learned from labelled documents. A text's n-grams are taken as draws from a mixture of languages;
expectation-maximisation estimates the proportions. The set of languages grows one at a time while the penalised
log-likelihood grows: each further language costs ``PENALTY`` * ln(n-grams). The prediction is the language of largest
proportion, its score that proportion times the weight of the chosen set's best language against all single languages.

Learning counts n-grams of about ``FIT_DOCS`` documents a language at most and ``FIT_ALL`` in all, chosen by a hash of doc_id;
prediction reads every whole text. The model goes to every task: up to ``DENSE`` languages as 2**15 numbers each, more of them by
the n-grams that each has shown, 12 bytes each. All languages' single likelihoods are compared, and each may join the mixture, however
many there are.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with nothing learned all are ``und``; ties go to
the language that sorts first; documents with a null lang or doc_id teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a language learns from, at most.
FIT_DOCS = 4_000
FIT_ALL = 1_000_000
#: Languages up to which the model is a full matrix, 0.26 MB each.
DENSE = 256
BUCKETS = 1 << 15
#: Cost of one more language, in natural logarithms of the number of n-grams.
PENALTY = 6.0
STEPS = 30
#: Characters counted at a time.
CHUNK = 1 << 18

_SPACE = np.uint32(32)


def _letters() -> np.ndarray:
    """For the basic plane: the lower-case form of a letter, or a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD = _letters()


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None if the text has no letter."""
    if not text:
        return None
    total = None
    seen = False
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 2) : at + CHUNK] if at else " " + text[:CHUNK]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = c >= 1 << 16
        folded = _FOLD[np.where(high, _SPACE, c)]
        if high.any():
            at_high = np.flatnonzero(high)
            folded[at_high[[chr(int(x)).isalpha() for x in c[at_high]]]] = 0x10FFFF
        if at + CHUNK >= len(text):
            folded = np.append(folded, _SPACE)
        seen = seen or bool((folded != 32).any())
        a, b, d = folded[:-2], folded[1:-1], folded[2:]
        two = (a * np.uint32(2654435761) ^ b * np.uint32(40503)) * np.uint32(2246822519)
        three = (two ^ d * np.uint32(3266489917)) * np.uint32(668265263)
        inner = b != 32
        keys = np.concatenate((two[(a != 32) | inner], three[inner])) >> np.uint32(17)
        n = np.bincount(keys, minlength=BUCKETS)
        total = n if total is None else total + n
    return total if seen else None


class Mixture:
    """Languages and their n-gram log-probabilities (languages x BUCKETS)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))

    def _likely(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, Callable[[int], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
        """For n-grams and their counts: the single likelihoods of all languages, the n-grams' probabilities in a language, and their sums,
        weighted, in all languages. A probability is one of its n-gram's largest."""
        log_p = self.log_p[:, at].T
        p = np.exp(log_p - log_p.max(axis=1)[:, None])
        return n @ log_p, lambda k: p[:, k], lambda w: w @ p

    def _em(self, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """p: n-grams x languages. Proportions and log-likelihood."""
        pi = start
        before = -np.inf
        for _ in range(STEPS):
            joint = p * pi
            total = joint.sum(axis=1)
            now = float(n @ np.log(total))
            pi = (n / total) @ joint
            pi /= pi.sum()
            if now - before < 1e-3:
                break
            before = now
        return pi, now

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0, {}
        at = np.flatnonzero(counts)
        n = counts[at].astype(np.float64)
        single, column, sums = self._likely(at, n)
        chosen = [int(single.argmax())]
        p = column(chosen[0])[:, None]
        pi, best = np.ones(1), float(n @ np.log(p[:, 0]))
        cost = PENALTY * np.log(n.sum() + 1)
        while len(chosen) < len(self.languages):
            # the language whose small share would raise the likelihood fastest
            gain = sums(n / (p @ pi))
            gain[chosen] = -np.inf
            k = int(gain.argmax())
            more = np.column_stack((p, column(k)))
            new, value = self._em(more, n, np.append(pi * 0.9, 0.1))
            if value - best <= cost:
                break
            chosen.append(k)
            p, pi, best = more, new, value
        shares = {self.languages[k]: float(x) for k, x in zip(chosen, pi, strict=True)}
        top = min(shares, key=lambda x: (-shares[x], x))
        weight = 1.0
        if len(chosen) == 1:  # how sure the single language is against the others
            weight = float(1 / np.exp(np.clip((single - single.max()) / np.sqrt(n.sum() + 1), -50, 0)).sum())
        return top, min(1.0, max(0.0, shares[top] * weight)), shares


class WideMixture(Mixture):
    """The same over any number of languages: an n-gram that a language hasn't shown has the language's own base probability, and only
    those that it has shown are kept, by n-gram."""

    def __init__(self, languages: list[str], number: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages = languages
        self.base = -np.log(2 * np.bincount(number, n, len(languages)) + BUCKETS)
        order = np.argsort(bucket, kind="stable")
        self.number, self.more = number[order].astype(np.int32), np.log(2.0 * n[order] + 1)
        self.first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def _likely(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, Callable[[int], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
        """The same from what languages have shown of the n-grams: all others of a language have its base probability."""
        long = self.first[at + 1] - self.first[at]
        row = np.repeat(np.arange(len(at)), long)
        place = np.arange(len(row)) + np.repeat(self.first[at] - (np.cumsum(long) - long), long)
        number, more = self.number[place], self.more[place]
        single = n.sum() * self.base + np.bincount(number, n[row] * more, len(self.languages))
        shown = self.base[number] + more
        most = np.full(len(at), self.base.max())
        np.maximum.at(most, row, shown)
        extra = np.exp(shown - most[row]) - np.exp(self.base[number] - most[row])
        lift = np.exp(self.base.max() - most)

        def column(k: int) -> np.ndarray:
            log_p = np.full(len(at), self.base[k])
            mine = number == k
            log_p[row[mine]] += more[mine]
            return np.exp(log_p - most)

        def sums(w: np.ndarray) -> np.ndarray:
            return np.exp(self.base - self.base.max()) * (w @ lift) + np.bincount(number, w[row] * extra, len(self.languages))

        return single, column, sums


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, fit_docs: int = FIT_DOCS, fit_all: int = FIT_ALL, dense: int = DENSE) -> Mixture:
    """Counts n-grams by language on the executors; only the counts, 2**15 numbers a language and task, are summed and fetched."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    if learn is not None:
        rows = rows.where(learn)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted((r["lang"] for r in sizes.select("lang").collect()), key=lambda x: x.encode())  # the model's own list
    if not languages:
        return Mixture([], np.zeros((0, BUCKETS)))
    each = min(fit_docs, max(1, fit_all // len(languages)))
    share = sizes.select(F.col("lang").alias("of"), F.least(F.lit(1 << 30), F.floor(F.lit(float(1 << 30)) * each / F.col("n"))).alias("share"))
    share = F.broadcast(share) if len(languages) <= dense else share
    rows = rows.join(share, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, n in totals.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at].astype(np.int64))})
            totals.clear()

        for batch in batches:
            for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (n := ngram_counts(t)) is not None:
                    totals[k] = totals[k] + n if k in totals else n
                    if len(totals) > DENSE:
                        yield from out()
        yield from out()

    found = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {k: i for i, k in enumerate(languages)}
    codes = found["lang"].combine_chunks().dictionary_encode() if found.num_rows else None
    of = np.array([number[k] for k in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()] if found.num_rows else np.zeros(0, np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    if len(languages) > dense:
        return WideMixture(languages, of, bucket, n)
    counts = np.zeros((len(languages), BUCKETS))
    counts[of, bucket] = n
    return Mixture(languages, counts)


def infer(model: Mixture, text: str = "text") -> Column:
    """Struct of lang_pred, score and shares (map of the chosen languages' proportions)."""

    @F.pandas_udf("lang_pred string, score double, shares map<string, double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [model.infer(t) for t in s]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "shares": [x[2] for x in found]})

    return of(F.col(text))
