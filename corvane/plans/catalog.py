"""The registered queries over the driver's tables, and their DuckDB equivalents.

The tables hold no publications or postings, so `documents` with `embeddings` stand in: every fourth document is a posting,
its source is its supervisor, and publications credit up to two people. Search queries are the vectors whose id is
divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.cells import Cells
from corvane.operators.documents import from_postings, from_publications
from corvane.operators.embedding import HashEmbedder
from corvane.operators.index import VectorIndex, count_actions, diff, remove, upsert
from corvane.operators.knn import top_k
from corvane.operators.ranking import authority_ids, credit, ordered_hits, rank_people
from corvane.plans import matching
from corvane.sources.jsonl import Staged, check_lines
from corvane.sources.storage import work_folder
from corvane.sources.tables import table

K = 10
TOPICS = ["ranking", "retrieval"]


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents in the form of an index's rows, with the columns of `keep` as they are."""
    posting, i = F.col("doc_id") % 4 == 0, F.col("doc_id")
    other = F.concat(F.lit("src"), (i % 7).cast("string"))
    people = F.when(posting, F.array().cast("array<string>")).when(i % 5 == 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array("source", other)))
    rows = table(spark, sf_dir, "documents").select(
        i.alias("id"), "text", F.when(posting, "thesis_posting").otherwise("publication").alias("source_type"), F.col("lang").alias("department"),
        F.when(posting, F.element_at(F.array(F.lit("bachelor"), F.lit("master"), F.lit("phd")), (i % 3 + 1).cast("int"))).alias("degree_level"),
        F.when(posting, F.col("source")).alias("supervisor"), (2000 + i % 25).cast("int").alias("year"), F.concat(F.lit("doc/"), i.cast("string")).alias("url"), people.alias("uzh_authors"), *keep,
    )
    if not vectors:
        return rows
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.join(own, "id")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").where(i % 50 == 0).select(
        i.alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.when(i % 3 == 1, "master").when(i % 3 == 2, "phd").alias("degree_level"), F.when(i % 100 == 50, "en").alias("department"),
    )


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.eligible(corpus(spark, sf_dir))
    found = top_k(search_queries(spark, sf_dir), rows, K, equal=matching.FILTERS)
    return found.join(rows.drop("vector", "source_type"), "id")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("any").alias("source_type"), F.col("embedding").alias("vector"))
    return top_k(search_queries(spark, sf_dir), rows, K).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def knn_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(search_queries(spark, sf_dir), matching.eligible(corpus(spark, sf_dir)), K, equal=matching.FILTERS)
    return found.select("query_id", "source_type", "id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def union_hits_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_hits(_hits(spark, sf_dir), K).select("query_id", "id", "source_type", F.col("ord").cast("long").alias("ord"))


def expert_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_join(F.transform("evidence", lambda e: F.concat_ws("~", e["source_type"], e["source_id"].cast("string"), e["title"], e["url"], e["year"].cast("string"))), "||")
    return rank_people(_hits(spark, sf_dir), K).select("query_id", F.col("rank").cast("long").alias("rank"), "supervisor", "department", F.round("score", 6).alias("score"), "publication_count", "has_open_position", refs.alias("evidence"))


def _authorities(rows: DataFrame) -> DataFrame:
    """`rows` with ids for their authors: some spellings share one, some names have two, some none."""
    last = lambda u: F.right(u, F.lit(1))
    id_ = lambda u: F.when(last(u) == "3", F.lit(None).cast("string")).when(last(u) == "2", F.concat(F.lit("a"), (F.col("id") % 2).cast("string"))).otherwise(F.concat(F.lit("a"), (F.ascii(last(u)) % 4).cast("string")))
    return rows.withColumn("author_authority_map", F.map_from_arrays("uzh_authors", F.transform("uzh_authors", id_)))


def expert_ranking_by_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _authorities(matching.eligible(corpus(spark, sf_dir)))
    hits = top_k(search_queries(spark, sf_dir), rows, K, equal=matching.FILTERS).join(rows.drop("vector", "source_type"), "id")
    found = rank_people(hits, K, authority_ids(_authorities(corpus(spark, sf_dir, vectors=False))))
    refs = F.array_join(F.transform("evidence", lambda e: F.concat_ws("~", e["source_type"], e["source_id"].cast("string"))), "||")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "supervisor", "department", F.round("score", 6).alias("score"), "publication_count", "has_open_position", refs.alias("evidence"))


def render_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search_queries(spark, sf_dir).select("query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("raw_query"))
    matches = rank_people(_hits(spark, sf_dir), K).withColumn("matched_topics", F.array(*map(F.lit, TOPICS)))
    return matching.render_answers(matches, asked)


def credit_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit(corpus(spark, sf_dir, vectors=False)).select("id", "person", F.col("author_pos").cast("long").alias("author_pos"))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as an earlier state, some with another text, and benchmark items that are gone."""
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), F.col("text")))
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("content_hash"))
    return labelled.unionByName(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.sha2("text", 256).alias("content_hash")))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(_current(spark, sf_dir), _known(spark, sf_dir))


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_actions(index_diff(spark, sf_dir))


def removed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_diff(spark, sf_dir).where("action = 'delete'").select("id")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.joined_text(F.col("source"), F.nullif(F.col("lang"), F.lit("de")), F.lit(""), F.col("text")).cast("binary")).alias("text_md5"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\n", "text", "lang", "source"), 256).alias("content_hash"))


def title_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_line(F.col("text"), F.col("doc_id").cast("string")).alias("title"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query"), "text")
    return items.unionByName(turns)


def query_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query", F.array_join(X.topics(F.coalesce("text", F.lit(""))), "|").alias("topics"))


def degree_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query", X.degree_level(F.col("text")).alias("degree_level"))


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = matching.parse_queries(_asked(spark, sf_dir), "text")
    return parsed.select("query", X.query_text(F.col("topics"), F.col("keywords"), F.col("text")).alias("query_text"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens_md5"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = HashEmbedder().embed(docs, "text").select("doc_id", F.posexplode("vector").alias("i", "value"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


def validate_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as publication lines: French ones with text after the object, German ones with a number as title, the rest fine."""
    title = F.when(F.col("lang") == "de", F.lit("5")).otherwise(F.to_json(F.array("source")).substr(F.lit(2), F.length(F.to_json(F.array("source"))) - 2))
    line = F.concat(F.lit('{"id": "'), F.col("doc_id").cast("string"), F.lit('", "title": '), title, F.lit(', "year": "2024.0", "extra": [1], "keywords": ["a"]}'), F.when(F.col("lang") == "fr", " x").otherwise(""))
    checked = check_lines(table(spark, sf_dir, "documents").select(line.alias("value")), "publication")
    return checked.groupBy("title").agg(F.count("*").alias("n_lines"), F.count_if("is_valid").alias("n_valid"), F.sum("year").cast("long").alias("years"))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as publication and posting records: the source is the title, the language a keyword."""
    i, id_ = F.col("doc_id"), F.col("doc_id").cast("string").alias("id")
    docs = corpus(spark, sf_dir, vectors=False, keep=("doc_id", "source")).withColumnRenamed("source", "title")
    common = [id_, "title", "department", "url", F.array_compact(F.array("department")).alias("keywords")]
    named = F.map_from_arrays("uzh_authors", F.transform("uzh_authors", lambda p: F.when(p == "src1", F.lit(None).cast("string")).otherwise(F.concat(F.lit("n/"), p))))
    pubs = docs.where(i % 4 != 0).select(*common, F.col("text").alias("abstract"), F.col("uzh_authors").alias("authors"), "uzh_authors", named.alias("author_authority_map"), "year")
    posts = docs.where(i % 4 == 0).select(*common, F.col("text").alias("description"), "supervisor", "degree_level")
    return pubs, posts


def documents_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs, posts = _records(spark, sf_dir)
    docs = from_publications(pubs).unionByName(from_postings(posts))
    return docs.select("id", "source_type", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.coalesce("has_uzh_author", F.lit(False)).alias("has_uzh_author"), "content_hash")


def index_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that gets an older state of the documents (every tenth missing, every seventh with another text), then the present one, and loses every eleventh: what it holds, and what each step did."""
    pubs, posts = _records(spark, sf_dir)
    now = from_publications(pubs).unionByName(from_postings(posts))
    i = F.col("id").cast("long")
    old = F.when(i % 7 == 0, F.concat(F.lit("old "), F.col("title"))).otherwise(F.col("title"))
    before = from_publications(pubs.withColumn("title", old)).unionByName(from_postings(posts.withColumn("title", old))).where(i % 10 != 0)
    index, embedder = VectorIndex(spark, work_folder(spark, "index"), "lifecycle"), HashEmbedder()
    first, second = upsert(index, before, embedder), upsert(index, now, embedder)
    removed = remove(index, now.where(i % 11 == 0).select("id"))
    index.compact()
    held = index.rows().select("id", "source_type", "content_hash", F.size("vector").cast("long").alias("dim"))
    return held.withColumns({"embedded_first": F.lit(first.embedded).cast("long"), "embedded_second": F.lit(second.embedded).cast("long"), "skipped": F.lit(second.skipped).cast("long"), "removed": F.lit(removed).cast("long")})


def match_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions, from text to ranked people, over every document."""
    rows = HashEmbedder().embed(corpus(spark, sf_dir, vectors=False), "text")
    asked = matching.parse_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query")))
    found = matching.match(asked, rows, HashEmbedder(), K)
    refs = F.array_join(F.transform("evidence", lambda e: F.concat_ws("~", e["source_type"], e["source_id"].cast("string"))), "||")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "supervisor", "department", F.round("score", 6).alias("score"), "publication_count", "has_open_position", F.array_join("matched_topics", "|").alias("topics"), refs.alias("evidence"))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to every fiftieth one by the vectors of their words, searched in cells: the hits of the full search, and with how many documents each was scored (all, if nothing could be left out)."""
    docs = HashEmbedder().embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "text").select("id", "vector")
    cells = Cells(spark, work_folder(spark, "cells")).build(docs)
    hits, _ = cells.search(docs.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector"), K)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of record lines, some blank: for each error of the bad lines how many there are, and how many places (file and line number) they have."""
    i = F.col("doc_id")
    good = F.to_json(F.struct(i.cast("string").alias("id"), F.col("source").alias("title"), F.lit("2024").alias("year")))
    line = F.when(i % 9 == 4, F.lit("  ")).when(F.col("lang") == "de", F.concat(good, F.lit(" x"))).when(F.col("lang") == "fr", F.lit("[1]")).otherwise(good)
    folder = work_folder(spark, "lines")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(f"{folder}/lines")
    bad = Staged(spark, f"{folder}/lines", "publication", f"{folder}/staged").bad_lines()
    return bad.groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n_lines"), F.count_distinct("file", "number").alias("n_places"))


QUERIES = [
    knn_topk, knn_topk_filtered, union_hits_ordered, expert_ranking, render_answer, credit_explode, index_diff, index_counts, removed_ids, document_text,
    content_hash, title_first_line, query_topics, degree_detect, query_text, tokenize, hash_embed, validate_jsonl,
    documents_of_records, index_lifecycle, match_people, expert_ranking_by_authority, knn_cells, quarantine,
]

_CORPUS = """
corpus AS (
  SELECT doc_id AS id, text, CASE WHEN doc_id % 4 = 0 THEN 'thesis_posting' ELSE 'publication' END AS source_type, lang AS department,
         CASE WHEN doc_id % 4 = 0 THEN ['bachelor', 'master', 'phd'][doc_id % 3 + 1] END AS degree_level, CASE WHEN doc_id % 4 = 0 THEN source END AS supervisor,
         2000 + doc_id % 25 AS year, 'doc/' || doc_id AS url,
         CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 1 THEN [] WHEN source = 'src' || (doc_id % 7) THEN [source] ELSE [source, 'src' || (doc_id % 7)] END AS people
  FROM documents
)"""
_HITS = f"""{_CORPUS}, asked AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, CASE vec_id % 3 WHEN 1 THEN 'master' WHEN 2 THEN 'phd' END AS want_level, CASE WHEN vec_id % 100 = 50 THEN 'en' END AS want_department
  FROM embeddings WHERE vec_id % 50 = 0
), scored AS (
  SELECT query_id, c.*, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score
  FROM corpus c JOIN embeddings ON vec_id = id JOIN asked ON (want_department IS NULL OR department = want_department)
    AND (source_type = 'publication' OR want_level IS NULL OR degree_level = want_level) AND (source_type = 'thesis_posting' OR len(people) > 0)
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, id) AS rk FROM scored QUALIFY rk <= {K}
), ordered AS (
  SELECT *, rk + CASE WHEN source_type = 'publication' THEN {K} ELSE 0 END AS ord FROM hits
)"""
_FIRST_LINE = "regexp_extract(text, '^([^\\n\\r\\x0B\\f]*)', 1)"
_RANKED = f"""{_HITS}, named AS (
  SELECT *, CASE WHEN source_type = 'publication' THEN people ELSE [supervisor] END AS p FROM ordered
), credits AS (
  SELECT * EXCLUDE (p), unnest(p) AS person, generate_subscripts(p, 1) - 1 AS pos FROM named
), grouped AS (
  SELECT query_id, person, max(score) AS score, count(*) FILTER (WHERE source_type = 'publication') AS publication_count, bool_or(source_type <> 'publication') AS has_open_position,
         arg_min(department, ord) FILTER (WHERE department <> '') AS department, min(ord * 1000 + pos) AS first,
         list({{'source_type': source_type, 'id': id, 'title': {_FIRST_LINE}, 'url': url, 'year': year}} ORDER BY ord, pos) AS refs
  FROM credits GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM grouped QUALIFY rank <= {K}
)"""
_ASKED = """
asked AS (
  SELECT 'b' || item_id AS query, text FROM benchmark UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
)"""


def _topics_sql() -> str:
    text = "lower(coalesce(text, ''))"
    for phrase in X.FILLERS:
        text = f"replace({text}, '{phrase.replace(chr(39), chr(39) * 2)}', ' ')"
    return f"""{_ASKED}, parts AS (
  SELECT query, text, list_filter(list_transform(regexp_split_to_array({text}, '\\s+and\\s+|,|;|/'), lambda p: trim(p, ' .')), lambda p: length(p) > 2) AS p FROM asked
), parsed AS (
  SELECT query, text, CASE WHEN len(p) > 0 THEN p ELSE [regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')] END AS topics FROM parts
)"""


def _levels_sql() -> str:
    tests = [f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{n}{chr(39)})' for n in names)} THEN '{level}'" for level, names in X.DEGREE_KEYWORDS]
    return f"CASE {' '.join(tests)} END"


_DIFF = """
known AS (
  SELECT doc_id AS id, sha256(CASE WHEN quality = 1 THEN text ELSE 'old ' || text END) AS old FROM labels JOIN documents USING (doc_id) UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark
), found AS (
  SELECT coalesce(d.doc_id, k.id) AS id, CASE WHEN old IS NULL THEN 'insert' WHEN d.doc_id IS NULL THEN 'delete' WHEN sha256(text) <> old THEN 'update' ELSE 'skip' END AS action
  FROM documents d FULL JOIN known k ON d.doc_id = k.id
)"""
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zäöüß0-9]+')"

ORACLE_SQL = {
    "knn_topk": f"""
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0
)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM scored QUALIFY rk <= {K}""",
    "knn_topk_filtered": f"WITH {_HITS} SELECT query_id, source_type, id, round(score, 6) AS score, rk FROM hits",
    "union_hits_ordered": f"WITH {_HITS} SELECT query_id, id, source_type, ord::BIGINT AS ord FROM ordered",
    "expert_ranking": f"""WITH {_RANKED}
SELECT query_id, rank, person AS supervisor, department, round(score, 6) AS score, publication_count, has_open_position,
       array_to_string(list_transform(refs, lambda r: concat_ws('~', r.source_type, r.id, r.title, r.url, r.year)), '||') AS evidence FROM ranked""",
    "render_answer": f"""WITH {_RANKED}, blocks AS (
  SELECT query_id, rank, rank || '. ' || person || CASE WHEN coalesce(department, '') <> '' THEN ' (' || department || ')' ELSE '' END || chr(10)
    || '   Works on {", ".join(TOPICS)}; ' || publication_count || ' related publications; ' || CASE WHEN has_open_position THEN 'has an open thesis position' ELSE 'no open position listed' END || '.' || chr(10)
    || array_to_string(list_transform(refs, lambda r: '   - ' || r.title || ' (' || r.url || ')'), chr(10)) AS block FROM ranked
), bodies AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM blocks GROUP BY query_id)
SELECT a.query_id, CASE WHEN body IS NULL THEN 'No suitable supervisors found for "query ' || a.query_id || '".'
  ELSE 'Based on your interest in "query ' || a.query_id || '", here are the top matches:' || chr(10) || chr(10) || body END AS answer
FROM asked a LEFT JOIN bodies USING (query_id)""",
    "credit_explode": f"WITH {_CORPUS}, named AS (SELECT id, CASE WHEN source_type = 'publication' THEN people WHEN coalesce(supervisor, '') <> '' THEN [supervisor] END AS p FROM corpus) SELECT id, unnest(p) AS person, generate_subscripts(p, 1) - 1 AS author_pos FROM named",
    "index_diff": f"WITH {_DIFF} SELECT id, action FROM found",
    "index_counts": f"WITH {_DIFF} SELECT count(*) FILTER (WHERE action IN ('insert', 'update')) AS embedded, count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'delete') AS deleted FROM found",
    "removed_ids": f"WITH {_DIFF} SELECT id FROM found WHERE action = 'delete'",
    "document_text": "SELECT doc_id, md5(array_to_string(list_filter([source, nullif(lang, 'de'), '', text], lambda p: p IS NOT NULL AND p <> ''), chr(10))) AS text_md5 FROM documents",
    "content_hash": "SELECT doc_id, sha256(concat_ws(chr(10), text, lang, source)) AS content_hash FROM documents",
    "title_first_line": f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN doc_id::VARCHAR ELSE {_FIRST_LINE} END AS title FROM documents",
    "query_topics": f"WITH {_topics_sql()} SELECT query, array_to_string(topics, '|') AS topics FROM parsed",
    "degree_detect": f"WITH {_ASKED} SELECT query, {_levels_sql()} AS degree_level FROM asked",
    "query_text": f"WITH {_topics_sql()} SELECT query, array_to_string(topics, '; ') AS query_text FROM parsed",
    "tokenize": f"SELECT doc_id, len({_TOKENS}) AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS tokens_md5 FROM documents",
    "hash_embed": f"""
WITH used AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
counted AS (SELECT doc_id, token, count(*) AS n FROM used GROUP BY ALL),
words AS (SELECT DISTINCT token FROM used),
digests AS (SELECT token, b, sha256(b || ':' || token) AS hex FROM words, range(8) r(b)),
parts AS (SELECT token, b * 8 + j AS i, ('0x' || substr(hex, 8 * j + 1, 8))::BIGINT AS u FROM digests, range(8) s(j)),
own AS (SELECT token, i, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) / 2147483648.0::DOUBLE AS x FROM parts),
sums AS (SELECT doc_id, i, sum(n * x) AS x FROM counted JOIN own USING (token) GROUP BY ALL),
sizes AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM sums GROUP BY doc_id)
SELECT doc_id, i::BIGINT AS i, round(coalesce(x / nullif(size, 0), 0), 6) + 0.0 AS value
FROM (SELECT doc_id, i FROM documents, range(64) t(i)) LEFT JOIN sums USING (doc_id, i) LEFT JOIN sizes USING (doc_id)""",
    "validate_jsonl": """
SELECT CASE WHEN lang IN ('de', 'fr') THEN NULL ELSE source END AS title, count(*) AS n_lines, count(*) FILTER (WHERE lang NOT IN ('de', 'fr')) AS n_valid,
       (sum(2024) FILTER (WHERE lang NOT IN ('de', 'fr')))::BIGINT AS years FROM documents GROUP BY 1""",
}

_PEOPLE = "CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 1 THEN [] WHEN source = 'src' || (doc_id % 7) THEN [source] ELSE [source, 'src' || (doc_id % 7)] END"
_AUTHORITY = "CASE right(u, 1) WHEN '3' THEN NULL WHEN '2' THEN 'a' || (id % 2) ELSE 'a' || (ascii(right(u, 1)) % 4) END"


def _units_sql(texts: str) -> str:
    """Unit vectors (side, id, i, x) of the words of `texts` (side, id, text); texts without words have none."""
    return f"""used AS (SELECT side, id, unnest({_TOKENS}) AS token FROM {texts}), counted AS (SELECT side, id, token, count(*) AS n FROM used GROUP BY ALL), words AS (SELECT DISTINCT token FROM used),
digests AS (SELECT token, b, sha256(b || ':' || token) AS hex FROM words, range(8) r(b)),
bits AS (SELECT token, b * 8 + j AS i, ('0x' || substr(hex, 8 * j + 1, 8))::BIGINT AS u FROM digests, range(8) s(j)),
own AS (SELECT token, i, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) / 2147483648.0::DOUBLE AS x FROM bits),
sums AS (SELECT side, id, i, sum(n * x) AS x FROM counted JOIN own USING (token) GROUP BY ALL),
sizes AS (SELECT side, id, sqrt(sum(x * x)) AS size FROM sums GROUP BY ALL),
units AS (SELECT side, id, i, x / size AS x FROM sums JOIN sizes USING (side, id))"""


def _hash_sql(title: str) -> str:
    """The content hash of a document whose title is `title`, with its text; fields in order, null ones left out."""
    text = f"array_to_string(list_filter([{title}, text, lang], lambda p: p IS NOT NULL AND p <> ''), chr(10))"
    said = lambda name, v: f"coalesce(',\"{name}\":' || to_json({v})::VARCHAR, '')"
    named = f"list_transform({_PEOPLE}, lambda u: to_json(u)::VARCHAR || ':' || CASE WHEN u = 'src1' THEN 'null' ELSE to_json('n/' || u)::VARCHAR END)"
    pub = f"said || '\"publication\"' || {said('department', 'lang')} || {said('year', '2000 + doc_id % 25')} || {said('url', chr(39) + 'doc/' + chr(39) + ' || doc_id')} || {said('authors', _PEOPLE)} || {said('uzh_authors', _PEOPLE)} || ',\"author_authority_map\":{{' || array_to_string({named}, ',') || '}}' || {said('keywords', 'list_filter([lang], lambda x: x IS NOT NULL)')} || ',\"has_uzh_author\":' || (len({_PEOPLE}) > 0)::VARCHAR"
    post = f"said || '\"thesis_posting\"' || {said('department', 'lang')} || {said('degree_level', '[' + chr(39) + 'bachelor' + chr(39) + ', ' + chr(39) + 'master' + chr(39) + ', ' + chr(39) + 'phd' + chr(39) + '][doc_id % 3 + 1]')} || {said('supervisor', 'source')} || {said('url', chr(39) + 'doc/' + chr(39) + ' || doc_id')}"
    return f"""SELECT doc_id::VARCHAR AS id, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'thesis_posting' ELSE 'publication' END AS source_type, md5({text}) AS text_md5, doc_id % 4 <> 0 AND len({_PEOPLE}) > 0 AS has_uzh_author,
    sha256(CASE WHEN doc_id % 4 = 0 THEN {post} ELSE {pub} END || '}}') AS content_hash FROM (SELECT *, '{{\"text\":' || to_json({text})::VARCHAR || ',\"source_type\":' AS said FROM documents)"""


ORACLE_SQL |= {
    "documents_of_records": f"SELECT id, source_type, text_md5, has_uzh_author, content_hash FROM ({_hash_sql('source')})",
    "index_lifecycle": f"""WITH now AS ({_hash_sql('source')})
SELECT id, source_type, content_hash, 64::BIGINT AS dim, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS embedded_first, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0) AS embedded_second,
       (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0) AS skipped, (SELECT count(*) FROM documents WHERE doc_id % 11 = 0) AS removed FROM now WHERE doc_id % 11 <> 0""",
    "match_people": f"""WITH {_CORPUS}, {_topics_sql().replace(_ASKED, "asked AS (SELECT item_id AS query, text FROM benchmark)")}, questions AS (
  SELECT query AS query_id, array_to_string(topics, '; ') AS qt, topics, {_levels_sql()} AS want_level FROM parsed
), texts AS (SELECT 'd' AS side, id, text FROM corpus UNION ALL SELECT 'q', query_id, qt FROM questions),
{_units_sql("texts")},
dots AS (SELECT q.id AS query_id, d.id, sum(q.x * d.x) AS score FROM units q JOIN units d USING (i) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL),
scored AS (
  SELECT query_id, c.*, round(coalesce(score, 0), 9) AS score FROM corpus c JOIN questions ON (source_type = 'publication' OR want_level IS NULL OR degree_level = want_level) AND (source_type = 'thesis_posting' OR len(people) > 0)
    LEFT JOIN dots USING (query_id, id)
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, id) AS rk FROM scored QUALIFY rk <= {K}
), ordered AS (
  SELECT *, rk + CASE WHEN source_type = 'publication' THEN {K} ELSE 0 END AS ord FROM hits
){_RANKED.removeprefix(_HITS)}
SELECT query_id, rank, person AS supervisor, department, round(score, 6) AS score, publication_count, has_open_position, array_to_string(topics, '|') AS topics,
       array_to_string(list_transform(refs, lambda r: concat_ws('~', r.source_type, r.id)), '||') AS evidence FROM ranked JOIN questions USING (query_id)""",
    "expert_ranking_by_authority": f"""WITH {_HITS}, named AS (
  SELECT *, CASE WHEN source_type = 'publication' THEN people ELSE [supervisor] END AS p FROM ordered
), ids AS (
  SELECT name, min(a) AS authority FROM (SELECT u AS name, {_AUTHORITY} AS a FROM (SELECT id, unnest(people) AS u FROM corpus)) WHERE a IS NOT NULL GROUP BY name HAVING count(DISTINCT a) = 1
), credits AS (
  SELECT * EXCLUDE (p), unnest(p) AS u, generate_subscripts(p, 1) - 1 AS pos FROM named
), keyed AS (
  SELECT c.*, u AS person, coalesce(CASE WHEN source_type = 'publication' THEN {_AUTHORITY} END, authority, 'name ' || u) AS key FROM credits c LEFT JOIN ids ON name = u
  QUALIFY row_number() OVER (PARTITION BY query_id, key, id ORDER BY pos) = 1
), grouped AS (
  SELECT query_id, key, arg_min(person, ord * 1000 + pos) AS person, max(score) AS score, count(*) FILTER (WHERE source_type = 'publication') AS publication_count, bool_or(source_type <> 'publication') AS has_open_position,
         arg_min(department, ord) FILTER (WHERE department <> '') AS department, min(ord * 1000 + pos) AS first, string_agg(source_type || '~' || id, '||' ORDER BY ord, pos) AS evidence
  FROM keyed GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, person AS supervisor, department, round(score, 6) AS score, publication_count, has_open_position, evidence FROM grouped QUALIFY rank <= {K}""",
    "knn_cells": f"""WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents), {_units_sql("texts")},
dots AS (SELECT q.id AS query_id, d.id, sum(q.x * d.x) AS score FROM units q JOIN units d USING (i) WHERE q.id % 50 = 0 GROUP BY ALL),
scored AS (SELECT a.doc_id AS query_id, b.doc_id AS id, round(coalesce(score, 0), 9) AS score FROM documents a JOIN documents b ON a.doc_id % 50 = 0 LEFT JOIN dots ON dots.query_id = a.doc_id AND dots.id = b.doc_id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM scored QUALIFY rk <= {K}""",
    "quarantine": """
SELECT error, count(*) AS n_lines, count(*) AS n_places FROM (
  SELECT CASE WHEN doc_id % 9 = 4 THEN '' WHEN lang = 'de' THEN 'Extra data' WHEN lang = 'fr' THEN 'not an object' END AS error FROM documents
) WHERE error <> '' GROUP BY error""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
