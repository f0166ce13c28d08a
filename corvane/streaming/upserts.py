"""Records that arrive as files: a stream that upserts them into the index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.documents import from_postings, from_publications
from corvane.operators.embedding import Embedder
from corvane.operators.index import VectorIndex, upsert
from corvane.sources.jsonl import check_lines


def stream_records(spark: SparkSession, folder: str, source_type: str, index: VectorIndex, embedder: Embedder, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that upserts the valid records of files new in `folder`. A stream sees no absence, so it deletes nothing."""
    make = from_publications if source_type == "publication" else from_postings

    def take(batch, _: int) -> None:
        upsert(index, make(check_lines(batch, source_type).where("is_valid")), embedder)

    writer = spark.readStream.text(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
