"""Documents of records: one text, typed fields, and a hash of all that matters for the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schemas as S
from corvane.functions.text import joined_text

_EMPTY = {"degree_level": "string", "supervisor": "string", "department": "string", "url": "string", "year": "int", "authors": "array<string>", "uzh_authors": "array<string>", "author_authority_map": "map<string,string>", "keywords": "array<string>", "has_uzh_author": "boolean"}


def content_hash(*fields: Column) -> Column:
    """SHA-256 of text and fields as JSON, in their order; the id is no part. Map entries keep their order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def _documents(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in _EMPTY.items() if c not in rows.columns}
    rows = rows.withColumns(missing)
    return rows.withColumn("content_hash", content_hash(*[F.col(c) for c in S.DOCUMENT[1:-1]])).select(*S.DOCUMENT, *keep)


def from_publications(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents of publications, with the columns of `keep` as they are."""
    text = joined_text(F.col("title"), F.col("abstract"), F.array_join("keywords", ", "))
    return _documents(records.select("id", text.alias("text"), F.lit("publication").alias("source_type"), "department", "year", "url", "authors", "uzh_authors", "author_authority_map", "keywords", (F.size("uzh_authors") > 0).alias("has_uzh_author"), *keep), keep)


def from_postings(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents of open positions, with the columns of `keep` as they are."""
    text = joined_text(F.col("title"), F.col("description"), F.array_join("keywords", ", "))
    return _documents(records.select("id", text.alias("text"), F.lit("thesis_posting").alias("source_type"), "department", "degree_level", "supervisor", "url", *keep), keep)
