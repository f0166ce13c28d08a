"""The queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontaminate, fingerprint, hard_negatives, language_id, line_dedup, merkle, near_dedup, quality, sharding, suffix_dedup, token_files, url_filter
from corvane.llm.shared import scratch
from corvane.sources.tables import table

#: Host and path rules of op6.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
N_SHARDS = 40
#: Id that op1 puts after each document.
END_ID = 2


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; only these queries depend on that package, operators take paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, vocabulary("byte_bpe_50k.json"), scratch(spark, "tokens"), end_id=END_ID)
    return token_files.read_digests(manifest, docs.schema["doc_id"].dataType)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, ranks = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken")
    found = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs, with_text=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    return language_id.predict(docs.drop("lang").withColumn("held_out", language_id.held_out("doc_id")), model).drop("text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, N_SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    *plain, text = (F.col(c) for c in docs.columns)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    docs = docs.withColumn("tampered", F.when(hit, merkle.leaf_of(*plain, F.translate(text, UPPER, LOWER))))
    found = merkle.manifest(docs, merkle.leaf_of(*plain, text), keep=["tampered"])
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.hard_negatives(rows, i % 50 == 0)


OP5_SQL = f"""
WITH plain AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), worded AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\u0080-\U0010ffff]+') AS w FROM plain
), item_len AS (
  SELECT id, least(len(w), {decontaminate.SHINGLE}) AS n, w FROM worded WHERE side = 'i' AND len(w) > 0
), item_grams AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM item_len)
), doc_grams AS (
  SELECT DISTINCT id AS doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM worded, (SELECT DISTINCT n FROM item_len) WHERE side = 'd')
), pairs AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (n, gram) GROUP BY ALL
)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared / n_item AS containment
FROM pairs JOIN (SELECT item_id, count(*) AS n_item FROM item_grams GROUP BY ALL) USING (item_id)
WHERE n_shared >= {decontaminate.THRESHOLD} * n_item
"""

OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, trim(line, ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
), bad AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), numbered AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), judged AS (
  SELECT n.*, trim(raw, ' ') IN (SELECT line FROM bad) AS gone, trim(raw, ' ') = '' AS blank FROM numbered n
), per_doc AS (
  SELECT doc_id, any_value(text) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
         count(*) FILTER (WHERE NOT gone AND NOT blank) AS n_solid,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines,
       (CASE WHEN n_solid = 0 THEN 0 ELSE n_gone END)::BIGINT AS n_removed,
       md5(CASE WHEN n_solid = 0 THEN text ELSE coalesce(kept, '') END) AS kept_md5
FROM per_doc
UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
"""


#: Levels of the trees in SQL: enough for 8 ** 8 rows of a language.
SQL_LEVELS = 8


def _op11_sql() -> str:
    said = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    plain = " || ".join(map(said, ("doc_id", "source", "lang", "n_chars")))
    steps = [f"""
bits AS (
  SELECT list(list_reduce([n] || repeat([0], 8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)
), docs AS (
  SELECT doc_id, lang, sha256({plain} || {said('text')}) AS leaf, sha256({plain} || {said(f"translate(text, '{UPPER}', '{LOWER}')")}) AS low,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc
  FROM documents, bits
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS have, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM docs
), a0 AS (SELECT lang AS g, i, leaf AS h FROM leaves)"""]

    def levels(name: str) -> None:
        """Tables of nodes (g, i, h), and of each node's siblings to the left and right."""
        for n in range(SQL_LEVELS):
            steps.append(f"""{name}{n + 1} AS (
  SELECT g, i // 8 AS i, CASE WHEN any_value(size) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM {name}{n}) GROUP BY g, i // 8
), {name}s{n} AS (
  SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY g) AS size FROM {name}{n}
)""")

    levels("a")
    steps.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS lang FROM a{SQL_LEVELS})")
    levels("b")
    steps.append(f"p0 AS (SELECT d.*, b.i AS k, s.h AS subroot, '' AS proof, have AS f FROM leaves d JOIN a{SQL_LEVELS} s ON s.g IS NOT DISTINCT FROM d.lang JOIN b0 b ON b.lang IS NOT DISTINCT FROM d.lang)")
    for n in range(2 * SQL_LEVELS):
        name, at, k = ("a", "p.i", n) if n < SQL_LEVELS else ("b", "p.k", n - SQL_LEVELS)
        own = "s.g IS NOT DISTINCT FROM p.lang" if name == "a" else "s.g = 0"
        steps.append(f"""p{n + 1} AS (
  SELECT p.* EXCLUDE (proof, f), proof || l || r AS proof, CASE WHEN size = 1 THEN f ELSE sha256(l || f || r) END AS f FROM p{n} p JOIN {name}s{k} s ON {own} AND s.i = {at} // {8**k}
)""")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM p{2 * SQL_LEVELS}, b{SQL_LEVELS} b"


OP13_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_near_dedup": op4_near_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_url_filter": op6_url_filter,
        "op7_quality_rules": op7_quality_rules,
        "op8_language_id": op8_language_id,
        "op9_sharding": op9_sharding,
        "op10_line_dedup": op10_line_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_fingerprints": op12_fingerprints,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op10_line_dedup": OP10_SQL, "op11_merkle_manifest": _op11_sql(), "op13_hard_negatives": OP13_SQL}
