"""URL filter: rules first, then naive Bayes over words of the host and path, host names split into words by Viterbi.

Rules (host, path prefix) fit a host and all its subdomains; of several that fit, the longest text host + path wins. A URL
without a rule is judged by a multinomial naive Bayes model. Its tokens are the words of the path and the words of the
host, whose concatenated names are split by the most probable sequence under a unigram model (Viterbi).

The evidence are the rules: a page that a rule fits is labelled by its verdict, and the model learns which words of hosts
and paths go with block and with allow (``learn`` holds pages out of that). What the rule itself says, the labels of its host and
its path prefix, isn't learned from such a page, and a top-level domain is never a token, else the model would only learn the
rules again. Rules are no sample of the pages, so both classes start alike: the words decide. Counts are kept in 2**16 hashed
buckets a class (a documented bound of the model).

The unigram model counts all words of the pages' own text, of paths and of hyphenated host names; ``dictionary``, a table
(w, n), adds further counts. It stays a table: the pieces of up to ``LONGEST`` letters of each distinct run of letters of a
host are joined with it, and each run is split once, by the costs of its own pieces. Pieces are made from a name at a time, so
time and space grow with its length; keys that hold many rows of a join (a short piece, a common name, a large host) are salted.

Words are runs of letters of any script, lower-cased, with percent escapes decoded; digits are no words.

Defined cases: null URLs and URLs without "://" have empty host and path, no rule, and the score of no tokens at all (0.5, allow);
so have all pages without a rule if no rule fits any page, and hosts of one label with a path of no words; null page texts have no
words; hosts may have any length; repeated pages are rows of their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

LONGEST = 24
BUCKETS = 1 << 16
SMOOTH = 20.0
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"[\p{L}\p{M}]+"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict, labels and prefix of the rule's host and path) of the longest rule that fits, or null. For up to some
    hundred rules, which become one expression."""
    out = F.lit(None).cast("struct<rule: string, verdict: string, labels: int, prefix: int>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        own = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(name.count(".") + 1).alias("labels"), F.lit(len(prefix)).alias("prefix"))
        out = F.when(fits, own).otherwise(out)
    return out


def best_split(name: str, cost_of: dict[str, float], unknown: float) -> list[str]:
    """The words of highest unigram probability; a run that is no word costs unknown, and more with each letter."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        choices = []
        for start in range(max(0, end - LONGEST), end):
            cost = cost_of.get(name[start:end])
            choices.append((best[start] + (unknown + 1.5 * (end - start) if cost is None else cost), start))
        cost, start = min(choices)
        best.append(cost)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode("utf-8", "replace")) & (BUCKETS - 1)


def _plain(part: Column) -> Column:
    """Lower case, percent escapes decoded where they are well-formed."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part))


#: What isn't text in a page.
_MARKUP = r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z0-9#]+;"


def unigrams(pages: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """w, n: counts of all words of up to LONGEST letters in the paths, the parts of hyphenated host names and the text of html; columns host, path, html."""
    hyphened = F.flatten(F.filter(F.transform(F.split(_plain(F.col("host")), r"\."), lambda x: F.split(x, "-")), lambda x: F.size(x) > 1))
    letters = lambda c: F.regexp_extract_all(c, F.lit(_LETTERS), F.lit(0))
    text = letters(F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), _MARKUP, " ")))
    words = pages.select(F.explode(F.concat(letters(_plain(F.col("path"))), hyphened, text)).alias("w")).where((F.length("w") <= LONGEST) & F.col("w").rlike(f"^{_LETTERS}$"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    if dictionary is not None:
        counts = counts.unionByName(dictionary.select("w", F.col("n").cast("long").alias("n"))).groupBy("w").agg(F.sum("n").alias("n"))
    return counts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names (nth, name) to their distinct pieces (nth, w), a name at a time."""
    for batch in batches:
        for nth, name in zip(batch.column("nth").to_pylist(), batch.column("name").to_pylist(), strict=True):
            for lo in range(0, len(name), 10_000):  # of a long name some letters at a time; a piece met in two parts is one row more
                found = {name[i:j] for i in range(lo, min(lo + 10_000, len(name))) for j in range(i + 1, min(i + LONGEST, len(name)) + 1)}
                yield pa.RecordBatch.from_pydict({"nth": pa.array([nth] * len(found), pa.int64()), "w": pa.array(list(found), pa.string())})


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: the best split of each of the distinct names, by the costs of its own pieces in the whole unigram table."""
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 1
    unknown = float(np.log(total)) + 2.0
    names = cut(names.select("name", F.monotonically_increasing_id().alias("nth")), "names")
    pieces = cut(names.mapInArrow(_pieces, "nth long, w string"), "pieces")
    costs = salted_join(pieces, counts, "w").groupBy("nth").agg(F.collect_list("w").alias("known"), F.collect_list("n").alias("n"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series, n: pd.Series) -> pd.Series:
        def one(text, ws, ns):
            cost = {} if ws is None else {w: -float(np.log(k / total)) for w, k in zip(ws, ns, strict=True)}
            return best_split(text, cost, unknown)

        return pd.Series([one(*x) for x in zip(name, known, n, strict=True)], dtype=object)

    return names.join(costs, "nth", "left").select("name", split("name", "known", "n").alias("words"))


def tokenized(rows: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """rows with labels, the words of each label of the host from the left, and path_words. Runs of letters are split once each, hosts put
    together once each."""
    labels = F.split(_plain(F.col("host")), r"\.")
    hosts = rows.select("host").distinct().select("host", F.posexplode(labels).alias("label", "said"))
    runs = F.posexplode(F.regexp_extract_all("said", F.lit(_LETTERS), F.lit(0))).alias("at", "name")
    runs = cut(hosts.select("host", "label", runs), "runs")
    words = cut(split_names(runs.select("name").distinct(), cut(unigrams(rows, dictionary), "unigrams")), "words")
    found = salted_join(runs, words, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("label", "at", "words"))).alias("x"))
    each = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.flatten(F.transform(F.filter("x", lambda e: e["label"] == i), lambda e: e["words"])))
    hosts = cut(found.select("host", each.alias("labels")), "hosts")
    rows = salted_join(rows.drop("html"), hosts, "host", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<array<string>>")))
    return cut(rows.withColumn("path_words", _path_words(F.col("path"))), "pages")


def _path_words(path: Column) -> Column:
    return F.regexp_extract_all(_plain(path), F.lit(_LETTERS), F.lit(0))


def host_words(but: Column | int = 0) -> Column:
    """Words of a host without so many labels from the right."""
    return F.flatten(F.slice("labels", F.lit(1), F.greatest(F.lit(0), F.size("labels") - but)))


class Bayes:
    """Log-odds of block by hashed token; both classes start alike. counts: allow and block, by bucket."""

    def __init__(self, counts: np.ndarray):
        background = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
        p = (counts + SMOOTH * background) / (counts.sum(axis=1, keepdims=True) + SMOOTH)
        self.odds = np.log(p[1]) - np.log(p[0])

    def block(self, host: list[str], path: list[str]) -> float:
        x = sum(self.odds[_bucket("h", w)] for w in host) + sum(self.odds[_bucket("p", w)] for w in path)
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def fit(pages: DataFrame) -> Bayes:
    """Counts over all ``tokenized`` pages with a label (``block`` or ``allow``); tasks return sums, at most 2 * BUCKETS rows each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, hw, pw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, ws in (("h", hw), ("p", pw)):
                    for w in ws:
                        tokens[int(label == "block"), _bucket(k, w)] += 1
        kind, at = np.nonzero(tokens)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(at, pa.int32()), "n": pa.array(tokens[kind, at], pa.int64())})

    # a page doesn't teach what its rule says
    labelled = pages.where("label is not null").select("label", host_words(F.col("ruled.labels")).alias("host_words"), _path_words(F.expr("substring(path, ruled.prefix + 1)")).alias("path_words"))
    found = labelled.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS))
    if found.num_rows:
        counts[found["kind"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Bayes(counts)


def judge(
    pages: DataFrame, url: str = "url", page_id: str = "page_id", html: str | None = "html", rules: Sequence[tuple[str, str, str]] = RULES,
    learn: Column | None = None, dictionary: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of block) and words (the host's) of every page. html: column of the pages' text,
    None for none; learn: a condition on column page_id of the pages that may teach (all)."""
    host, path = parse(F.col(url))
    text = F.lit(None).cast("string") if html is None else F.col(html)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("html"))
    rows = rows.withColumn("ruled", match_rules(F.col("host"), F.col("path"), rules))
    rows = tokenized(rows.withColumn("label", F.when(F.lit(True) if learn is None else learn, F.col("ruled.verdict"))), dictionary)
    bayes = fit(rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([bayes.block(list(h), list(p)) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    rows = rows.withColumn("score", score(host_words(1), F.col("path_words")))
    return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score", host_words().alias("words"))
