"""The incremental vector index: documents of record files, embedded once, in a store that takes small changes.

A run compares the documents' hashes with those stored, embeds what is new or changed, and writes that and the tombstones of what is gone as one layer.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import schemas as S
from corvane.operators.documents import from_postings, from_publications
from corvane.operators.embedding import Embedder
from corvane.operators.store import DEALT, ConflictError, Store
from corvane.sources import jsonl, storage

__all__ = ["ConflictError", "IndexResult", "ModelMismatchError", "VectorIndex", "build", "count_actions", "diff", "remove", "upsert"]
log = logging.getLogger(__name__)
#: Bad lines that go to the log; all of them are in the quarantine table.
LOGGED = 20


class ModelMismatchError(RuntimeError):
    """The index was built with another embedding model."""


@dataclass(frozen=True)
class IndexResult:
    embedded: int
    skipped: int
    deleted: int
    invalid_lines: int = 0
    #: Valid lines whose id came again later; the last one holds.
    duplicates: int = 0


def diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """id and action (insert, update, skip or delete) of each id of `current` and `known` (id, content_hash)."""
    a, b = current.select("id", F.col("content_hash").alias("new")), known.select("id", F.col("content_hash").alias("old"))
    return a.join(b, "id", "full_outer").select("id", _action().alias("action"))


def _action():
    return F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("new") != F.col("old"), "update").otherwise("skip")


def count_actions(actions: DataFrame) -> DataFrame:
    """One row: embedded, skipped, deleted."""
    of = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(of("insert", "update").alias("embedded"), of("skip").alias("skipped"), of("delete").alias("deleted"))


class VectorIndex(Store):
    """The documents and vectors of a collection below `path`."""

    def check_model(self, embedder: Embedder, manifest: dict | None = None) -> None:
        manifest = manifest or self.manifest()
        if manifest and manifest["embedding_model"] != embedder.model_name:
            raise ModelMismatchError(f"the index holds vectors of {manifest['embedding_model']}, not {embedder.model_name}; rebuild it")

    def quarantine(self) -> DataFrame | None:
        """file, number, error and line of the bad lines of the last build; None before one."""
        manifest = self.manifest() or {}
        return self.spark.read.schema("file string, number long, error string, line string").parquet(f"{self.root}/{manifest['quarantine']}") if manifest.get("quarantine") else None


def _apply(index: VectorIndex, documents: DataFrame, embedder: Embedder, keep_others: bool, order: list[str] | None = None, **facts) -> tuple[dict, int]:
    """Bring the index in line with `documents`: (what was written, how many documents were as they are). Of documents with one id the last in the order of `order` counts; without one, that of
    the highest content hash, so that any run picks the same.

    Documents and the hashes of what is stored are dealt out once, by buckets, and meet by id; what that leaves is embedded and written where it is. The number of skipped documents is seen as rows pass, so a task that runs twice may count its own twice; all
    other numbers are counted in the files.
    """
    columns = [*S.DOCUMENT, "vector"]
    seen = {"skipped": 0}

    def change(base: dict | None) -> tuple[dict, dict]:
        index.check_model(embedder, base)
        if base:
            known = index.hashes(base).select("id", F.col("content_hash").alias("old"), F.col("source_type").alias("old_type"))
        else:
            known = index.spark.createDataFrame([], T.StructType([documents.schema["id"], T.StructField("old", T.StringType()), T.StructField("old_type", T.StringType())]))
        new = documents.select("id", F.struct(*S.DOCUMENT[1:]).alias("d"), F.struct(*(order or ["content_hash"])).alias("by"))
        both = index.dealt(new.unionByName(known, allowMissingColumns=True), base)
        met = both.groupBy(*DEALT, "id").agg(F.max_by("d", "by").alias("d"), F.max("old").alias("old"), F.max("old_type").alias("old_type"))
        met = (met.where("d is not null") if keep_others else met).select(*DEALT, "id", "d.*", "old", "old_type").withColumn("new", F.col("content_hash"))
        met = met.withColumn("change", _action()).withColumn("source_type", F.coalesce("source_type", "old_type"))
        watch = Observation()
        changed = met.observe(watch, F.count_if(F.col("change") == "skip").alias("skipped")).where("change <> 'skip'").drop("new", "old", "old_type")
        embedded = embedder.embed(changed, "text", "vector")  # a tombstone has no text, so its vector costs nothing
        layer = index.write_layer(embedded.select(*columns, "change", *DEALT), base)
        # Where nothing has changed, Spark leaves the watched step out, and all documents are as they were.
        seen["skipped"] = watch.get["skipped"] if layer["buckets"] else documents.select("id").distinct().count()
        if base and not layer["buckets"] and not facts:
            return layer, base
        own = {"embedding_model": embedder.model_name, "sources_dir": (base or {}).get("sources_dir", "")} | facts
        return layer, index.changed(base, layer, columns, embedded.select(*columns, "change").schema, **own)

    layer, _ = index.apply(change)
    return layer["counts"], seen["skipped"]


def build(index: VectorIndex, sources: str, embedder: Embedder, rebuild: bool = False, keep_missing: bool = False) -> IndexResult:
    """Bring the index in line with the record files in the folder `sources`.

    A missing file counts as empty, so its documents go, unless `keep_missing`; so do documents whose line has become
    invalid. Of lines with one id the last holds, postings being after publications and files in the order of their names. Bad lines are kept as a table, see `VectorIndex.quarantine`.
    """
    if rebuild:
        index.drop()
    index.check_model(embedder)
    spark, run, staged, parts = index.spark, uuid.uuid4().hex, [], []
    for rank, (name, source_type, make) in enumerate(((S.PUBLICATIONS_FILE, "publication", from_publications), (S.POSTINGS_FILE, "thesis_posting", from_postings))):
        path = f"{sources.rstrip('/')}/{name}"
        if not storage.exists(spark, path):
            log.warning("no file %s", path)
        lines = jsonl.Staged(spark, path, source_type, f"{index.root}/staged-{run}/{source_type}")
        staged.append(lines)
        parts.append(make(lines.records(), keep=["file", "block", "place"]).withColumn("rank", F.lit(rank)))
    n_valid, n_invalid = (sum(s.count(kind) for s in staged) for kind in ("valid", "invalid"))
    quarantine = f"quarantine-{run}"
    staged[0].bad_lines().unionByName(staged[1].bad_lines()).write.parquet(f"{index.root}/{quarantine}")
    for bad in index.spark.read.parquet(f"{index.root}/{quarantine}").limit(LOGGED).collect() if n_invalid else ():
        log.warning("bad line %s:%d: %s", bad["file"], bad["number"], bad["error"])
    counts, skipped = _apply(index, parts[0].unionByName(parts[1]), embedder, keep_missing, ["rank", "file", "block", "place"], sources_dir=sources, quarantine=quarantine)
    storage.delete(spark, f"{index.root}/staged-{run}")
    embedded = counts.get("insert", 0) + counts.get("update", 0)
    return IndexResult(embedded, skipped, counts.get("delete", 0), n_invalid, n_valid - embedded - skipped)


def upsert(index: VectorIndex, documents: DataFrame, embedder: Embedder) -> IndexResult:
    """Insert or replace documents by id; all others stay, and those that are stored as they are are not embedded again. Of documents with one id the one with the highest content hash counts."""
    counts, skipped = _apply(index, documents, embedder, keep_others=True)
    return IndexResult(counts.get("insert", 0) + counts.get("update", 0), skipped, 0)


def remove(index: VectorIndex, ids: DataFrame, embedder: Embedder | None = None) -> int:
    """Drop the documents with the ids in the column `id`, and say how many; unknown ids are harmless. Only tombstones are written."""

    def change(base: dict | None) -> tuple[dict, dict | None]:
        if base is None:
            return {"counts": {}, "buckets": []}, base
        gone = index.hashes(base).join(ids.select("id").distinct(), "id", "left_semi").withColumn("change", F.lit("delete"))
        schema = T.StructType.fromJson(base["schema"])
        missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in (*gone.columns, "bucket")}
        rows = gone.withColumns(missing).select(*base["columns"], "change")
        layer = index.write_layer(rows, base)
        return layer, index.changed(base, layer, base["columns"], rows.schema) if layer["buckets"] else base

    layer, _ = index.apply(change)
    return layer["counts"].get("delete", 0)
