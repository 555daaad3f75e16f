"""JSON documents as VARIANT: parsed once, then asked by path and type.

A text that isn't JSON has no document; a path that isn't there, and a value of another type, match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(df: DataFrame, c: str, out: str = "doc") -> DataFrame:
    """Adds the document of a text. What comes out of explode() isn't put together with later filters and fields, so a text is parsed
    once however many of them ask."""
    return df.select("*", F.explode(F.array(F.try_parse_json(c))).alias(out))


def _at(doc: str, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind(doc: str, path: str = "$") -> Column:
    """Type of the value at a path, in capitals; null if there is none."""
    return F.schema_of_variant(_at(doc, path))


def has_string(doc: str, path: str, value: str) -> Column:
    return F.coalesce((kind(doc, path) == "STRING") & (F.try_variant_get(doc, path, "string") == value), F.lit(False))


def is_true(doc: str, path: str) -> Column:
    return F.coalesce((kind(doc, path) == "BOOLEAN") & F.try_variant_get(doc, path, "boolean"), F.lit(False))


def number(doc: str, path: str) -> Column:
    """The number at a path; texts and booleans that look like one are none."""
    return F.when(kind(doc, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(doc, path, "double"))


def holds_string(doc: str, path: str, value: str) -> Column:
    """Whether the array at a path has this text among its elements."""
    return F.coalesce(F.exists(F.try_variant_get(doc, path, "array<variant>"), lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == value)), F.lit(False))


def schema(df: DataFrame, doc: str) -> DataFrame:
    """One row: the type that all documents of a column fit."""
    return df.agg(F.schema_of_variant_agg(doc).alias("schema"))
