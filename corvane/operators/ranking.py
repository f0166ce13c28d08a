"""People behind hits, ranked for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import first_line


def ordered_hits(hits: DataFrame, k: int) -> DataFrame:
    """Hits of both kinds in one order, postings before publications: the column `ord`."""
    return hits.withColumn("ord", F.col("rk") + F.when(F.col("source_type") == "publication", k).otherwise(0))


def credit(hits: DataFrame) -> DataFrame:
    """A row for each person behind a hit: a posting's supervisor, or every internal author of a publication. Hits without people drop out."""
    people = F.when(F.col("source_type") == "publication", F.col("uzh_authors")).when(F.coalesce("supervisor", F.lit("")) != "", F.array("supervisor"))
    return hits.select("*", F.posexplode(people).alias("author_pos", "person"))


def authority_ids(rows: DataFrame) -> DataFrame:
    """name and authority of the names to which the `author_authority_map` of all `rows` gives one id, and no other. A name with several ids says nothing by itself."""
    named = rows.select(F.explode("author_authority_map").alias("name", "authority")).where("coalesce(authority, '') <> ''")
    return named.groupBy("name").agg(F.min("authority").alias("authority"), F.max("authority").alias("highest")).where("authority = highest").select("name", "authority")


def _by_authority(credits: DataFrame, ids: DataFrame) -> DataFrame:
    """`credits` with `key`: the id that a document gives a name, else the only one that any gives it, else the name; a document counts for a key once."""
    own = F.when(F.col("source_type") == "publication", F.nullif(F.try_element_at("author_authority_map", "person"), F.lit("")))
    known = credits.join(ids.withColumnRenamed("name", "person"), "person", "left")
    authority = F.coalesce(own, "authority")
    keyed = known.withColumn("key", F.struct(authority.isNull().alias("by_name"), F.coalesce(authority, "person").alias("value")))
    first = Window.partitionBy("query_id", "key", "id").orderBy("author_pos")
    return keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1")


def rank_people(hits: DataFrame, k: int, ids: DataFrame | None = None) -> DataFrame:
    """query_id, rank, supervisor, department, score, publication_count, has_open_position and evidence of the k best people of each query.

    `hits`: query_id, id, source_type, score, rk, text, department, supervisor, uzh_authors, url, year. A person's score is
    the best of the hits; ties go to the person named first. Department is the first that is not empty; evidence lists
    the hits in order, an equal one again where a publication names a person twice. People are told apart by name; with `ids` (see `authority_ids`, and author_authority_map among the columns)
    by authority id: spellings of one id are one person, under the one named first, names of different ids are not, and a publication counts once.
    """
    rows = credit(ordered_hits(hits, k))
    rows = rows.withColumn("key", F.col("person")) if ids is None else _by_authority(rows, ids)
    ref = F.struct(
        "ord", "author_pos", F.when(F.col("source_type") == "publication", "publication").otherwise("thesis_posting").alias("source_type"), F.col("id").alias("source_id"),
        first_line(F.col("text"), F.col("id").cast("string")).alias("title"), F.nullif("url", F.lit("")).alias("url"), F.nullif("year", F.lit(0)).alias("year"),
    )
    filled = F.col("department").isNotNull() & (F.col("department") != "")
    people = rows.groupBy("query_id", "key").agg(
        F.min_by("person", F.struct("ord", "author_pos")).alias("person"),
        F.max("score").alias("score"),
        F.count_if(F.col("source_type") == "publication").alias("publication_count"),
        F.bool_or(F.col("source_type") != "publication").alias("has_open_position"),
        F.min_by(F.when(filled, F.col("department")), F.when(filled, F.col("ord"))).alias("department"),
        F.min(F.struct("ord", "author_pos")).alias("first"),
        F.array_sort(F.collect_list(ref)).alias("refs"),
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    evidence = F.transform("refs", lambda r: F.struct(r["source_type"].alias("source_type"), r["source_id"].alias("source_id"), r["title"].alias("title"), r["url"].alias("url"), r["year"].alias("year")))
    ranked = people.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("person").alias("supervisor"), "department", "score", "publication_count", "has_open_position", evidence.alias("evidence"))
