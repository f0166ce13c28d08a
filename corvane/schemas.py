"""Spark schemas of the records, documents and results."""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType(), containsNull=False)

PUBLICATION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("authors", _strings),
    T.StructField("uzh_authors", _strings), T.StructField("author_authority_map", T.MapType(T.StringType(), T.StringType())), T.StructField("year", T.IntegerType()),
    T.StructField("keywords", _strings), *[T.StructField(c, T.StringType()) for c in ("department", "language", "publication_type", "doi", "url")],
])

POSTING = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "title", "url", "description", "supervisor", "department", "degree_level")],
    T.StructField("keywords", _strings), T.StructField("language", T.StringType()), T.StructField("scraped_at", T.TimestampType()),
])

REQUIRED = {"publication": ("id", "title"), "thesis_posting": ("id", "title", "url")}
DEGREE_LEVELS = ("bachelor", "master", "phd")
PUBLICATIONS_FILE, POSTINGS_FILE = "publications.jsonl", "theses.jsonl"

#: Columns of a document; null means that the field is absent.
DOCUMENT = ["id", "text", "source_type", "department", "degree_level", "supervisor", "year", "url", "authors", "uzh_authors", "author_authority_map", "keywords", "has_uzh_author", "content_hash"]
