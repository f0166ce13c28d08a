"""Queries from text to answer, with the parts that the settings choose or the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.index import VectorIndex
from corvane.plans import parts
from corvane.plans.settings import Settings


class Pipeline:
    """Without an index the results are canned ones. A chat endpoint, if set, extracts queries and writes answers; the rules and the template stand in where it fails. Each part can be given instead."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, index: VectorIndex | None = None, *, extractor: parts.Extractor | None = None, retriever: parts.Retriever | None = None, synthesizer: parts.Synthesizer | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.extractor = extractor or parts.build_extractor(self.settings)
        self.retriever = retriever or parts.build_retriever(self.settings, index)
        self.synthesizer = synthesizer or parts.build_synthesizer(self.settings)

    def _asked(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, raw_query string")

    def queries(self, texts: list[str]) -> DataFrame:
        return self.extractor.extract(self._asked(texts))

    def run(self, query: str, top_k: int = 5) -> DataFrame:
        return self.run_all(self._asked([query]), top_k)

    def run_all(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """The matches of any number of queries (query_id, raw_query) in one job."""
        return self.retriever.retrieve(self.extractor.extract(queries), top_k)

    def recommend(self, query: str, top_k: int = 5, matches: DataFrame | None = None) -> str:
        found = self.run(query, top_k) if matches is None else matches
        return self.synthesizer.answer(found, self._asked([query])).first()["answer"]


def show_matches(matches: DataFrame) -> str:
    """A line for each of the ranked people, and one for each work below it."""
    lines = []
    for m in matches.orderBy("rank").collect():  # at most k rows
        facts = [f"score {m['score']:.2f}", *([m["department"]] if m["department"] else []), f"{m['publication_count']} publication(s)", *(["open position"] if m["has_open_position"] else [])]
        lines.append(f"#{m['rank']} {m['supervisor']}: {'; '.join([*facts, *m['matched_topics']])}")
        lines += [f"  * {e['title']}" for e in m["evidence"]]
    return "\n".join(lines) or "nobody fits."
