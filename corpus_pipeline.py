"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, mixing, token table.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its
decisions take effect. All but the last return the columns of documents. ``run`` writes each stage as Parquet in the folder
that driver and executors share and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, quality, simhash, token_table
from tessella.llm.common import cut, discard, fresh, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~quality.held_out())
    return docs.where(quality.score(model) >= quality.ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = fresh(docs, "__hits")
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=hits)
    return found.where(~decontaminate.contaminated(hits)).drop(hits)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes of each document, in up to two copies; n_chars counts what they hold."""
    mixed = mixing.apply_mix(docs)
    counted = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return mixed if counted is None else mixed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), counted))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token table of the mix, one row a record as read back."""
    return token_table.tokenized(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token table", write_tokens),
]

#: No SQL can say the classifier, XXH64 fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself goes once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = set(written(spark))
        out = stage(spark, docs, sf_dir)
        own = set(written(spark)) - before
        docs = cut(out, name.replace(" ", "-"))
        discard(spark, *own)
    return docs
