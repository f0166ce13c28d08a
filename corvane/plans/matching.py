"""From raw queries to ranked people and a written answer. Every step keeps query_id, so one job serves many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.embedding import Embedder
from corvane.operators.knn import top_k
from corvane.operators.ranking import authority_ids, rank_people
from corvane.operators.store import kept, pushed
from corvane.plans import chat

PARSED = "query_id long, raw_query string, topics array<string>, keywords array<string>, degree_level string, department string"
#: Query columns that rows must equal; the level counts for postings only.
FILTERS = {"department": "department", "degree_level:thesis_posting": "degree_level"}


def parse_queries(queries: DataFrame, raw_col: str = "raw_query") -> DataFrame:
    """`queries` with topics, keywords, degree_level and department by rules. Null queries are empty ones."""
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    return queries.withColumns({"topics": X.topics(raw), "keywords": F.array().cast("array<string>"), "degree_level": X.degree_level(raw), "department": F.lit(None).cast("string")})


def extract_queries(queries: DataFrame, client: chat.ChatClient, folder: str | None = None, at_once: int = chat.POOL) -> DataFrame:
    """As parse_queries, by a model; the rules hold for queries that it fails on. See `chat.ask_all` for how and when it is asked."""
    rows = parse_queries(chat.extract_all(queries, client, folder, at_once))
    pick = lambda c: F.when(F.col("found").isNull(), F.col(c)).otherwise(F.col(f"found.{c}"))
    return rows.withColumns({c: pick(c) for c in ("topics", "keywords", "degree_level", "department")}).drop("found")


def eligible(rows: DataFrame) -> DataFrame:
    """The rows of an index that can lead to people: postings, and publications with an internal author."""
    return rows.where((F.col("source_type") == "thesis_posting") | (F.size("uzh_authors") > 0))


def match(parsed: DataFrame, rows: DataFrame, embedder: Embedder, k: int = 5, by_authority: bool = False, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best people for each parsed query: the columns of rank_people, and matched_topics.

    `rows` is an index's content. Publications without an internal author never count, and filters apply before the k best
    hits of each kind are taken. With `by_authority` people are told apart by their ids where these are known, not by name.
    `lookup` gives the rows of some ids, for an index that need not read all of them; without it hits are joined with `rows`.
    """
    ids = authority_ids(rows) if by_authority else None
    rows = eligible(rows)
    if lookup:
        rows = pushed(rows, parsed, FILTERS)
    embedded = embedder.embed(parsed.withColumn("_text", X.query_text(F.col("topics"), F.col("keywords"), F.col("raw_query"))), "_text", "vector")
    hits = top_k(embedded, rows, k, equal=FILTERS)
    if lookup:
        hits = kept(hits)
    full = hits.join((lookup(hits) if lookup else rows.drop("vector")).drop("source_type"), "id")
    return rank_people(full, k, ids).join(parsed.select("query_id", F.col("topics").alias("matched_topics")), "query_id")


def canned(spark: SparkSession, k: int = 5) -> DataFrame:
    """Three invented matches, the same for any query: what results look like before an index is built."""
    work = lambda kind, n, title, year: (kind, n, title, None, year)
    people = [
        (1, 1, "Ada Beispiel", "Informatics", 0.9, 2, True, [work("thesis_posting", "t1", "Search over long documents", None), work("publication", "p1", "Sparse retrieval at scale", 2023), work("publication", "p2", "Ranking people by their work", 2021)], ["information retrieval"]),
        (1, 2, "Ben Muster", "Linguistics", 0.7, 1, False, [work("publication", "p3", "Parsing without treebanks", 2022)], ["parsing"]),
        (1, 3, "Cleo Exempel", None, 0.6, 0, True, [work("thesis_posting", "t2", "Maps of citations", None)], []),
    ]
    schema = "query_id long, rank int, supervisor string, department string, score double, publication_count long, has_open_position boolean, evidence array<struct<source_type:string,source_id:string,title:string,url:string,year:int>>, matched_topics array<string>"
    return spark.createDataFrame(people, schema).where(F.col("rank") <= k)


def render_answers(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and answer: the answer to each of `queries` (query_id, raw_query), as one expression. The sentences are fixed values."""
    c = F.col
    where = F.when(F.coalesce("department", F.lit("")) != "", F.concat(F.lit(" ("), c("department"), F.lit(")"))).otherwise("")
    topics = F.when(F.size("matched_topics") > 0, F.array_join("matched_topics", ", ")).otherwise("your topics")
    position = F.when(c("has_open_position"), "has an open thesis position").otherwise("no open position listed")
    works = F.transform("evidence", lambda e: F.concat(F.lit("   - "), e["title"], F.when(F.coalesce(e["url"], F.lit("")) != "", F.concat(F.lit(" ("), e["url"], F.lit(")"))).otherwise("")))
    head = F.concat(c("rank").cast("string"), F.lit(". "), c("supervisor"), where)
    about = F.concat(F.lit("   Works on "), topics, F.lit("; "), c("publication_count").cast("string"), F.lit(" related publications; "), position, F.lit("."))
    blocks = matches.select("query_id", "rank", F.array_join(F.concat(F.array(head, about), works), "\n").alias("block"))
    joined = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("body"))
    some = F.concat(F.lit('Based on your interest in "'), c("raw_query"), F.lit('", here are the top matches:\n\n'), c("body"))
    none = F.concat(F.lit('No suitable supervisors found for "'), c("raw_query"), F.lit('".'))
    return queries.select("query_id", F.coalesce("raw_query", F.lit("")).alias("raw_query")).join(joined, "query_id", "left").select("query_id", F.coalesce(some, none).alias("answer"))
