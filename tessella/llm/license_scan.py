"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines dropped, everything but letters and digits read as one space,
equivalent spellings joined. Its SHA-256 is hash-joined to the digests of known licences, so entire texts are compared
whatever their layout. Known licences are any table (license_id, text); ``read_licenses`` makes one of a folder of texts,
``known_licenses`` one of the public texts in ``license_texts``.

Defined cases: null texts have a null digest and no licence; texts without letters or digits have the digest of the empty text,
which is no licence; two known texts with one digest give the smaller license_id; repeated documents are rows of their own;
other columns, of whatever name, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .license_texts import texts

#: Lines that name a holder and a year, not the terms. Java and RE2 read it alike.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)[^\n]*[0-9]{4}|©|all rights reserved)[^\n]*$"
#: Spellings that licence texts use for the same word, with what replaces them, in this order; plain text, words parted by one space.
EQUIVALENT = (
    (" licence", " license"), (" sub license", " sublicense"), (" sublicence", " sublicense"), (" organis", " organiz"), (" authoris", " authoriz"), (" acknowledgement", " acknowledgment"),
    (" merchantibility", " merchantability"), (" non infringement", " noninfringement"), (" noncommercial", " non commercial"), (" https ", " "), (" http ", " "),
)
#: Known digests up to which they are sent to every task, some 20 MB; a longer table is joined by a shuffle.
BROADCAST_ROWS = 200_000


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(texts(), "license_id string, text string")


def read_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """license_id, text: every file of a folder, named by its file name without .txt."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.txt$", "")
    return spark.read.text(folder, wholetext=True).select(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name).alias("license_id"), F.col("value").alias("text"))


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, digest, license_id (null if its text is no known licence)."""
    named = licenses.select(F.col("license_id"), digest(F.col("text")).alias("known")).where(F.col("known") != F.sha2(F.lit(""), 256))
    named = cut(named.groupBy("known").agg(F.min("license_id").alias("license_id")), "licenses")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    of = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"))
    return of.join(named, of["digest"] == named["known"], "left").select("doc_id", "digest", "license_id")
