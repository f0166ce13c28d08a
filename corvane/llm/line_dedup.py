"""Removal of lines that many distinct sites share (navigation, notices, licence lines).

One HyperLogLog sketch of sites per line hash, merged by aggregation, decides every line whose estimate is far from
the limit. Lines near the limit get an exact distinct count, so the outcome equals exact counting.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, others, unused

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; its standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Standard errors on either side of the limit within which a line is counted exactly.
SIGMAS = 6


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def widespread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes `line` of the non-blank lines that at least `min_sites` distinct non-null sites hold."""
    rows = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("raw"))
    rows = rows.where(~_blank(F.col("raw")) & F.col("site").isNotNull()).select(_key(F.col("raw")).alias("line"), "site")
    sketched = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    width = F.ceil(F.lit(SIGMAS * 1.04 / 2 ** (LG_K / 2)) * F.greatest(F.col("sites"), F.lit(min_sites))) + 1
    judged = sketched.select(
        "line",
        F.when(F.col("sites") - width >= min_sites, "over").when(F.col("sites") + width >= min_sites, "near").otherwise("under").alias("side"),
    ).where("side <> 'under'")
    near = judged.where("side = 'near'").select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return judged.where("side = 'over'").select("line").unionByName(exact.select("line"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with the columns n_lines, n_removed (long) and kept_text added; columns of these names, in any case, are replaced.

    Lines are split at newlines and compared without outer spaces. Blank lines stay. A document made of widespread
    lines alone is a copy as a whole, and stays as it is for document-level deduplication. Null text: 0 lines and
    null kept_text; null sites count for nothing; null, equal or repeated ids are harmless, since a line's fate
    depends on its content only; an empty table gives an empty one.
    """
    rest = others(docs.columns, ("n_lines", "n_removed", "kept_text"), (id_col, text_col, site_col))
    bad = cut(widespread_lines(docs, text_col, site_col, min_sites))  # a table of its own: where it is small, Spark broadcasts it, else it can split a line that many documents hold
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: ~_blank(x)), _key))).alias("line"))
    own_id, own_bad = unused(docs.columns, "id"), unused(docs.columns, "bad")
    per_doc = found.join(bad, "line", "left_semi").groupBy(F.col("id").alias(own_id)).agg(F.collect_set("line").alias(own_bad))
    joined = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col(own_id)), "left")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(own_bad), _key(x)))
    whole = F.col(own_bad).isNull() | ~F.exists(kept, lambda x: ~_blank(x))
    is_null = F.col(text_col).isNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in rest],
        F.when(is_null, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(is_null | whole, 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_removed"),
        F.when(whole, F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
