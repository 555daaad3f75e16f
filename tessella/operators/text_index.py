"""A positional inverted index over texts, and searches that read the postings of the asked words only.

A posting is (term, doc, positions). The index is stored in folders by bucket of the term and files by shard of the document, sorted
by term: a frequent term is spread over the shards, and a search opens the asked terms' buckets, where the files' statistics lead to
their row groups. Terms are runs of letters, digits and underscores, lower-cased; documents are whole numbers.

Defined cases: null texts and null documents aren't indexed; rows that share a document share its postings; a phrase is words in
direct succession; of a phrase prefix the last word may go on; searches for no words find nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SHARD_DOCS = 64, 1_000_000
#: Characters of text whose postings a task sorts and writes, some 200 MB of rows.
TASK_CHARS = 12_000_000
#: Words of a lower-cased text, and postings that a task holds before it passes them on, one text's at least.
WORD, AT_ONCE = re.compile(r"\w+", re.ASCII), 200_000
POSTING = "term string, doc bigint, positions array<int>, bucket int"


def terms(c: str | Column) -> Column:
    """Words of a text in order."""
    return F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"\W+"), lambda w: w != "")


def asked(words: str) -> list[str]:
    return [w for w in re.split(r"\W+", words.lower(), flags=re.ASCII) if w]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _pieces(rows: DataFrame, doc: str, said: str) -> DataFrame:
    """Postings of each row by itself (term, doc, positions), of lower-cased texts: made where the row is read, so nothing moves by word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, list[int]]] = []

        def out() -> pa.RecordBatch:
            found.sort(key=lambda x: x[:2])  # neighbours alike, so they move in fewer bytes
            columns = list(zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_pydict({"term": pa.array(columns[0], pa.string()), "doc": pa.array(columns[1], pa.int64()), "positions": pa.array(columns[2], pa.list_(pa.int32()))})

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                at: dict[str, list[int]] = {}
                for n, w in enumerate(WORD.findall(text.as_py())):
                    at.setdefault(w, []).append(n)
                number = i.as_py()
                found += [(w, number, places) for w, places in at.items()]
                if len(found) >= AT_ONCE:
                    yield out()
        if found:
            yield out()

    return rows.select(doc, said).mapInArrow(of, "term string, doc bigint, positions array<int>")


def build(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS, shard_docs: int = SHARD_DOCS) -> None:
    """Writes the index of a table: one shuffle of its postings, by bucket and shard, each a task's, so that its sort stays in memory. Only
    rows that share a document are put together by word before."""
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.lower(text).alias("said"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("said")), F.lit(0))).first()
    shards = max(1, -(-n // shard_docs), -(-chars // (buckets * TASK_CHARS)))
    rows = rows.where(F.col("said").isNotNull())
    shared = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("__doc"))
    if shared.isEmpty():
        postings = _pieces(rows, "doc", "said")
    else:
        mine = F.col("doc") == F.col("__doc")
        parts = _pieces(rows.join(shared, mine, "left_semi"), "doc", "said")
        merged = parts.select("term", "doc", F.explode("positions").alias("at")).groupBy("term", "doc").agg(F.sort_array(F.collect_set("at")).alias("positions"))
        postings = _pieces(rows.join(shared, mine, "left_anti"), "doc", "said").unionByName(merged)
    bucket, shard = _bucket(F.col("term"), buckets), F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")
    dealt = postings.repartitionById(buckets * shards, bucket * shards + shard).withColumn("bucket", bucket)
    dealt.sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", 16 << 20).parquet(path)


class Index:
    """Searches over a stored index; each gives distinct documents (column ``doc``)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.rows, self.buckets = spark.read.schema(POSTING).parquet(path), buckets
        self.spark = spark

    def _of(self, words: list[str]) -> DataFrame:
        """Postings of some words: their buckets' folders, then their rows."""
        found = self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"), self.buckets)).distinct().collect()
        return self.rows.where(F.col("bucket").isin([r[0] for r in found]) & F.col("term").isin(words))

    def match(self, words: str) -> DataFrame:
        """Documents that hold any of the words."""
        return self._of(asked(words) or [""]).select("doc").distinct()

    def match_all(self, words: str) -> DataFrame:
        """Documents that hold all of the words."""
        every = sorted(set(asked(words)))
        return self._of(every or [""]).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(every)).select("doc")

    def _in_order(self, rows: DataFrame, at: list[Column]) -> DataFrame:
        """Documents in which, from some position on, each place holds one of its terms."""
        def moved(i: int) -> Column:
            return F.transform("positions", lambda p: p - i)

        starts = [F.flatten(F.collect_list(F.when(c, moved(i)))) for i, c in enumerate(at)]
        found = rows.groupBy("doc").agg(*[s.alias(f"s{i}") for i, s in enumerate(starts)])
        all_ = F.col("s0")
        for i in range(1, len(at)):
            all_ = F.array_intersect(all_, F.col(f"s{i}"))
        return found.where(F.size(all_) > 0).select("doc")

    def phrase(self, words: str) -> DataFrame:
        """Documents that hold the words one after the other."""
        every = asked(words)
        return self._in_order(self._of(every or [""]), [F.col("term") == w for w in every or [""]])

    def phrase_prefix(self, words: str) -> DataFrame:
        """The same, but the last word may be the beginning of one. Its terms lie in all buckets, whose files are sorted by term."""
        *first, last = asked(words) or ["\0"]
        rows = self.rows.where(F.col("term").startswith(last))
        if others := [w for w in first if not w.startswith(last)]:
            rows = rows.unionByName(self._of(others))
        return self._in_order(rows, [*[F.col("term") == w for w in first], F.col("term").startswith(last)])


def search(docs: DataFrame, *found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows whose document all searches found; the texts themselves aren't read unless asked for."""
    for f in found:
        docs = docs.join(f.select(F.col("doc").alias("__doc")), F.col(doc) == F.col("__doc"), "left_semi")
    return docs


def holds_phrase(c: str, words: str, prefix: bool = False) -> Column:
    """The same by scanning texts: for tables without an index."""
    said = " " + " ".join(asked(words)) + ("" if prefix else " ")
    return F.concat(F.lit(" "), F.array_join(terms(c), " "), F.lit(" ")).contains(said)
