"""Spelling variants: words of a corpus within one edit of each other, by composing finite-state machines.

Words are runs of letters, lower-cased in A-Z, of at least 6 code points and 5 occurrences over all documents. Counts are summed in
tasks and then by Spark. Near words (one code point inserted, deleted or replaced) are those that the vocabulary's minimal acceptor,
a one-edit transducer and the acceptor again accept together, and the composed machine is enumerated by partitions of its initial
states: of two near words of n and n or n + 1 code points, both have either the first n // 2 or the last n - n // 2 in common, so
each word goes to the partitions of its halves, one as the shorter and one as the longer of a pair, and a machine starts there in
the state that the fixed half leads to. A partition above ``MOST`` words is divided again by the halves of what isn't fixed yet,
until it fits or one code point is left (where a few thousand words are all there can be). A pair belongs to one partition only: to
that of the first half if both serve.

A partition returns for each of its words how many near words it met and the best of them, so pairs never leave a task. Forms are
followed to their roots by pointer doubling, in written rounds; counts grow fivefold a step, so a few rounds suffice.

Defined cases: null texts have no words; a row without doc_id counts with an empty identifier; repeated rows count each; an empty
table gives an empty result; runs of any length are words; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, discard, give_back, new_path

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many runs of a document, by its checksum, loses a code point.
SLIP = 199
#: Words of a partition, above which it is divided again; distinct words that a task counts before it passes them on.
MOST, HELD = 20_000, 300_000
#: What a partition has fixed, and the LCP that its pairs must stay below.
KEY = ["n", "left", "right", "limit"]
NO_LIMIT = 2**31 - 1


def slipped(run: str, prefix: int) -> str:
    """The run, without a code point if its checksum says so. prefix: the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):  # noqa: ANN202
    runs = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                prefix = zlib.crc32(f"{id_ or ''}:".encode())
                for run, n in Counter(runs(text.translate(ASCII_LOWER).decode())).items():
                    word = slipped(run, prefix)
                    if len(word) >= least:
                        found[word] += n
                if len(found) >= HELD:
                    yield out()
                    found = Counter()
        yield out()
        give_back()

    return count


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words and how often they occur."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_counted(least_length), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of KEY, longer, rest, count to those of the two halves of what isn't fixed; rest has r or, if longer, r + 1 code points."""
    r = F.col("n") - F.length("left") - F.length("right")
    h = F.floor(r / 2).cast("int")
    size = F.length("rest")
    head = F.struct("n", F.concat("left", F.expr("substring(rest, 1, h)")).alias("left"), F.col("right"), F.col("limit"), "longer", F.expr("substring(rest, h + 1)").alias("rest"), "count")
    keep = F.expr("m - (r - h)")
    tail = F.struct("n", F.col("left"), F.concat(F.substring("rest", keep + 1, F.col("m")), F.col("right")).alias("right"), F.least("limit", F.length("left") + F.col("h")).alias("limit"), "longer", F.substring("rest", F.lit(1), keep).alias("rest"), "count")
    out = rows.withColumns({"r": r, "h": h, "m": size}).select(F.explode(F.array(head, tail)).alias("x"))
    return out.select("x.*")


class Machine:
    """A minimal acyclic acceptor: states by their transitions, alike ones once. Several word lists may share one."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.next: list[dict[str, int]] = []

    def _state(self, final: bool, to: dict[str, int]) -> int:
        key = (final, *to.items())
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.final)
            self.final.append(final)
            self.next.append(to)
        return at

    def accept(self, sorted_words: list[str]) -> int:
        """The initial state for a list in ascending order."""
        path: list[dict[str, int]] = [{}]
        ends = [False]
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                state = self._state(ends.pop(), path.pop())
                path[-1][last[len(path) - 1]] = state

        for w in sorted_words:
            same, most = 0, min(len(w), len(last))
            while same < most and w[same] == last[same]:
                same += 1
            close(same)
            for _ in range(len(w) - same):
                path.append({})
                ends.append(False)
            ends[-1] = True
            last = w
        close(0)
        return self._state(ends[0], path[0])

    def common(self, p: int, q: int, but: str = "") -> list[str]:
        """What both states accept, not beginning with ``but``."""
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, said = stack.pop()
            if self.final[p] and self.final[q]:
                out.append(said)
            to_p, to_q = self.next[p], self.next[q]
            if len(to_q) < len(to_p):
                to_p, to_q = to_q, to_p
            for c, x in to_p.items():
                if c in to_q and (said or c != but):
                    stack.append((x, to_q[c], said + c))
        return out

    def replaced(self, root: int) -> Iterator[tuple[int, str, str]]:
        """Accepted pairs that differ by one replaced symbol, and where."""
        known: dict[int, list[tuple[str, str, str]]] = {}
        stack = [(root, "")]
        while stack:
            p, said = stack.pop()
            if p not in known:
                to = list(self.next[p].items())
                known[p] = [(c, d, v) for i, (c, x) in enumerate(to) for d, y in to[i + 1 :] for v in self.common(x, y)]
            for c, d, v in known[p]:
                yield len(said), said + c + v, said + d + v
            stack += [(x, said + c) for c, x in self.next[p].items()]

    def inserted(self, short: int, long: int) -> Iterator[tuple[int, str, str]]:
        """Accepted pairs of which the second has one symbol more, at the last place that serves."""
        known: dict[tuple[int, int], list[tuple[str, str]]] = {}
        stack = [(short, long, "")]
        while stack:
            p, q, said = stack.pop()
            if (p, q) not in known:
                known[p, q] = [(d, v) for d, y in self.next[q].items() for v in self.common(p, y, but=d)]
            for d, v in known[p, q]:
                yield len(said), said + v, said + d + v
            to_q = self.next[q]
            stack += [(x, to_q[c], said + c) for c, x in self.next[p].items() if c in to_q]


def partition_pairs(short: list[str], long: list[str]) -> Iterator[tuple[int, str, str]]:
    """Pairs of one edit among the shorter rests, and of a shorter and a longer one."""
    m = Machine()
    root = m.accept(short)
    if len(short) > 1:
        yield from m.replaced(root)
    if short and long:
        yield from m.inserted(root, m.accept(long))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by KEY, longer, rest to (word, n_near, best_n, best), one row for each word of a partition that has near ones."""
    rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in (*KEY, "longer", "rest", "count")], strict=True))
    out: list[tuple[str, int, int, str]] = []
    for (_, left, right, limit), members in groupby(rows, key=lambda r: r[:4]):
        of = [(r[4], r[5], r[6]) for r in members]
        if len(of) < 2:
            continue
        # the shorter and the longer have different lengths, so a rest names one word
        short, long, count = [x for more, x, _ in of if not more], [x for more, x, _ in of if more], {x: n for _, x, n in of}
        met: dict[str, list] = {}
        for at, x, y in partition_pairs(short, long):
            if len(left) + at >= limit:
                continue
            for a, b in ((x, y), (y, x)):
                best = (-count[b], b)
                if (have := met.get(a)) is None:
                    met[a] = [1, best]
                else:
                    have[0] += 1
                    if best < have[1]:
                        have[1] = best
        out += [(left + x + right, n, -best[0], left + best[1] + right) for x, (n, best) in met.items()]
        if len(out) >= 50_000:
            yield _rows(out)
            out = []
    yield _rows(out)


def _rows(out: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """Words (word, n) to (word, n_near, best_n, best): how many words are one edit away, and of those the most frequent, ties to the
    smallest in code-point order. Words without near ones have no row."""
    size = F.length("word")
    as_shorter = vocabulary.select(size.alias("n"), F.lit(False).alias("longer"), "word", "n").toDF("n", "longer", "rest", "count")
    as_longer = vocabulary.where(size > least_length).select((size - 1).alias("n"), F.lit(True).alias("longer"), "word", "n").toDF("n", "longer", "rest", "count")
    whole = as_shorter.union(as_longer).withColumns({"left": F.lit(""), "right": F.lit(""), "limit": F.lit(NO_LIMIT)})
    rows, fit = _halves(whole), None
    while True:
        size_of = rows.groupBy(*KEY).agg(F.count("*").alias("members"))
        large = size_of.where((F.col("members") > most) & (F.col("n") - F.length("left") - F.length("right") > 1)).select(KEY)
        large = cut(large, "large")
        if large.isEmpty():
            fit = rows if fit is None else fit.union(rows)
            break
        small = rows.join(large, KEY, "left_anti").select(rows.columns)
        fit = small if fit is None else fit.union(small)
        rows = cut(_halves(rows.join(large, KEY, "left_semi").select(*KEY, "longer", "rest", "count")), "halves")
    met = fit.repartition(*KEY).sortWithinPartitions(*KEY, "longer", "rest").select(*KEY, "longer", "rest", "count").mapInArrow(_near, "word string, n_near long, best_n long, best string")
    first = F.struct((-F.col("best_n")).alias("less"), "best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """Links (word, form) without cycles to (word, root), by pointer doubling; each round is written to the shared folder."""
    spark = forms.sparkSession
    at = new_path(spark, "forms")
    now = cut(forms.select("word", F.col("form").alias("root")), "forms", at)
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        last, at = at, new_path(spark, "forms")
        step = cut(now.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms", at)
        discard(spark, last)
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """One row a word: word, form (its most frequent near word, if that is ``ratio`` times as frequent), root (where forms lead), n,
    n_near, form_n."""
    vocabulary = cut(words(docs, doc_id, text, least_length, least_count), "words")
    near = near_words(vocabulary, least_length, most)
    said = F.col("best_n") >= ratio * F.col("n")
    own = vocabulary.join(near, "word", "left").select("word", F.when(said, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(said, F.col("best_n")).alias("form_n"))
    own = cut(own, "variants")
    return own.join(roots(own.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
