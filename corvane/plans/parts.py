"""The exchangeable parts of a pipeline: what reads queries, what finds people, what writes answers. Each works on all queries of a job at once."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.embedding import Embedder, build_embedder
from corvane.operators.index import VectorIndex
from corvane.plans import chat, matching
from corvane.plans.settings import Settings


class Extractor(Protocol):
    def extract(self, queries: DataFrame) -> DataFrame:
        """`queries` (query_id, raw_query) with topics, keywords, degree_level and department."""
        ...


class Retriever(Protocol):
    def retrieve(self, parsed: DataFrame, k: int) -> DataFrame:
        """The k best people of each query: the columns of `rank_people`, and matched_topics."""
        ...


class Synthesizer(Protocol):
    def answer(self, matches: DataFrame, queries: DataFrame) -> DataFrame:
        """query_id and answer for each of `queries` (query_id, raw_query)."""
        ...


class RuleExtractor:
    def extract(self, queries: DataFrame) -> DataFrame:
        return matching.parse_queries(queries)


@dataclass(frozen=True)
class ModelExtractor:
    """By a chat model; the rules stand in where it fails. Replies are kept in `folder`, if one is named, for later runs too."""

    client: chat.ChatClient
    folder: str | None = None
    at_once: int = chat.POOL

    def extract(self, queries: DataFrame) -> DataFrame:
        return matching.extract_queries(queries, self.client, self.folder, self.at_once)


@dataclass(frozen=True)
class IndexRetriever:
    index: VectorIndex
    embedder: Embedder
    by_authority: bool = False

    def retrieve(self, parsed: DataFrame, k: int) -> DataFrame:
        self.index.check_model(self.embedder)
        return matching.match(parsed, self.index.rows(), self.embedder, k, self.by_authority, self.index.lookup)


class CannedRetriever:
    """Invented people, the same for each query."""

    def retrieve(self, parsed: DataFrame, k: int) -> DataFrame:
        found = matching.canned(parsed.sparkSession, k).drop("query_id")
        return F.broadcast(found).crossJoin(parsed.select("query_id"))  # three rows


class TemplateSynthesizer:
    def answer(self, matches: DataFrame, queries: DataFrame) -> DataFrame:
        return matching.render_answers(matches, queries)


@dataclass(frozen=True)
class ModelSynthesizer:
    """By a chat model; the template stands in where it fails or there is nothing to say."""

    client: chat.ChatClient
    folder: str | None = None
    at_once: int = chat.POOL

    def answer(self, matches: DataFrame, queries: DataFrame) -> DataFrame:
        written = chat.write_answers(matches, queries, self.client, self.folder, self.at_once).withColumnRenamed("answer", "written")
        plain = TemplateSynthesizer().answer(matches, queries)
        return plain.join(written, "query_id", "left").select("query_id", F.coalesce("written", "answer").alias("answer"))


def build_client(settings: Settings) -> chat.ChatClient | None:
    """A client if the settings name an endpoint."""
    return chat.ChatClient(settings.llm_base_url, settings.llm_model, settings.llm_api_key) if settings.llm_base_url else None


def build_extractor(settings: Settings) -> Extractor:
    client = build_client(settings)
    return ModelExtractor(client) if client else RuleExtractor()


def build_store(spark: SparkSession, settings: Settings) -> VectorIndex:
    return VectorIndex(spark, settings.vector_store_path, settings.collection_name)


def build_retriever(settings: Settings, index: VectorIndex | None) -> Retriever:
    """Over the index; without one, invented people."""
    return IndexRetriever(index, build_embedder(settings.embedding_model)) if index else CannedRetriever()


def build_synthesizer(settings: Settings) -> Synthesizer:
    client = build_client(settings)
    return ModelSynthesizer(client) if client else TemplateSynthesizer()
