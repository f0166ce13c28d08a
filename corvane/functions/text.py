"""Text expressions of documents and queries, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degree levels in the order in which they are looked for, with the strings that name them.
DEGREE_KEYWORDS = [
    ("phd", ["phd", "ph.d", "doctoral", "doctorate"]),
    ("master", ["master", "msc", "m.sc", "graduate"]),
    ("bachelor", ["bachelor", "bsc", "b.sc", "undergraduate"]),
]
# Phrases that carry no topic, in the order in which they are taken out.
FILLERS = [
    "i am interested in", "i'm interested in", "i am looking for", "i would like to", "i want to", "do a", "work on", "master's thesis", "masters thesis",
    "master thesis", "bachelor thesis", "phd thesis", "a thesis", "thesis", "in the area of", "related to", "research on", "a project on", "project on",
]
#: Lower-case letters and digits that make up tokens.
TOKEN = "([a-zäöüß0-9]+)"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def degree_level(query: Column) -> Column:
    """The first level that a query names; "undergraduate" holds "graduate" and so counts as master. Null if none."""
    low, found = F.lower(query), F.lit(None).cast("string")
    for level, names in reversed(DEGREE_KEYWORDS):
        some = F.lit(False)
        for name in names:
            some = some | F.contains(low, F.lit(name))
        found = F.when(some, level).otherwise(found)
    return found


def topics(query: Column) -> Column:
    """Topics of a free-text query: its parts between "and", commas, semicolons and slashes, of three characters or more; else the whole query."""
    text = F.lower(query)
    for phrase in FILLERS:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    parts = F.transform(F.split(text, r"(?U)\s+and\s+|,|;|/", -1), lambda p: F.btrim(p, F.lit(" .")))
    parts = F.filter(parts, lambda p: F.length(p) > 2)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(query)))


def query_text(topics: Column, keywords: Column, raw: Column) -> Column:
    """What is embedded for a query: topics and keywords, or the raw query if there are none."""
    all_ = F.concat(F.coalesce(topics, F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>")))
    return F.when(F.size(all_) > 0, F.array_join(all_, "; ")).otherwise(F.coalesce(raw, F.lit("")))


def joined_text(*parts: Column) -> Column:
    """Parts that are neither null nor empty, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n")


def first_line(text: Column, otherwise: Column) -> Column:
    """The first line of a text; `otherwise` if the text is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", otherwise).otherwise(F.split(text, r"\R", 2)[0])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
