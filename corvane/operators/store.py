"""A store of documents and vectors that takes small changes: buckets of layers, numbered manifests.

A document's bucket follows from its id. A change writes one layer: the new rows and tombstones, as files of the buckets that they fall into. The manifest
names, oldest first, the layers and the buckets each still counts in; the next change is the file of the next number, made only if no other writer has made it, so the loser of
a race starts again on what the winner left, and a writer that dies leaves nothing that counts. Reading merges a bucket's layers: of an id the newest row holds. A
bucket of many layers is written anew as one.
"""

from __future__ import annotations

import functools
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.knn import top_k
from corvane.sources import storage

log = logging.getLogger(__name__)
#: Buckets of a new store; its manifest keeps the number.
BUCKETS = 16
#: Columns by which rows are dealt to tasks that write them.
DEALT = ("bucket", "_part")
#: Layers of a bucket beyond which it is written anew.
MAX_LAYERS = 8
#: Manifests that stay readable after a change.
KEEP = 3
#: Attempts of a writer that finds others in its way.
TRIES = 20
#: Different values of a filter that go to the scan, at most; the exact filter of each query holds anyway.
MAX_VALUES = 1_000
#: Ids that are looked up by name, at most; more of them are joined with all rows.
MAX_IDS = 10_000


class ConflictError(RuntimeError):
    """Other writers were faster each time."""


class Store:
    """The rows of a collection below `path`: columns of documents with id and source_type, and a vector."""

    def __init__(self, spark: SparkSession, path: str, collection: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, f"{path.rstrip('/')}/{collection}", buckets

    # --- manifests

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in storage.names(self.spark, f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_path(self, number: int) -> str:
        return f"{self.root}/manifests/{number:010}.json"

    def manifest(self) -> dict | None:
        """The newest manifest; None before the first change."""
        numbers = self._numbers()
        return storage.read_json(self.spark, self._manifest_path(numbers[-1])) if numbers else None

    def exists(self) -> bool:
        return bool(self._numbers())

    def drop(self) -> None:
        storage.delete(self.spark, self.root)

    def commit(self, base: dict | None, changed: dict) -> bool:
        """Make `changed` the next manifest after `base`; False if another writer has."""
        number = (base or {}).get("number", 0) + 1
        if not storage.create_json(self.spark, self._manifest_path(number), changed | {"number": number}):
            return False
        self._forget()
        return True

    def _forget(self) -> None:
        """Remove manifests beyond the last KEEP, and the folders that only they name. What a writer has not committed yet no manifest names, so it stays."""
        numbers = self._numbers()
        old, kept = numbers[:-KEEP], numbers[-KEEP:]
        folders = lambda of: {x for n in of for m in [storage.read_json(self.spark, self._manifest_path(n)) or {}] for x in [*(y["folder"] for y in m.get("layers", [])), m.get("quarantine")] if x}
        if old:
            for folder in folders(old) - folders(kept):
                storage.delete(self.spark, f"{self.root}/{folder}")
            for n in old:
                storage.delete(self.spark, self._manifest_path(n))

    # --- layers

    def _bucket(self, base: dict | None) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit((base or {}).get("buckets", self.buckets))).cast("int")

    def dealt(self, rows: DataFrame, base: dict | None) -> DataFrame:
        """`rows` with the columns of DEALT, all of one pair in one task: grouped by these and the id, they need no other shuffle, nor does writing them as a layer."""
        buckets = (base or {}).get("buckets", self.buckets)
        parts = max(1, -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
        return rows.withColumns({"bucket": self._bucket(base), "_part": F.pmod(F.hash("id"), F.lit(parts))}).repartition(*DEALT)

    def write_layer(self, rows: DataFrame, base: dict | None) -> dict:
        """Write rows with the column `change` (insert, update or delete), and say what was written: folder, buckets, and the number of each change, counted in the files. Rows with
        the columns of `dealt` are written where they are."""
        folder = f"layer-{uuid.uuid4().hex}"
        at = f"{self.root}/{folder}"
        placed = rows.drop("_part") if "_part" in rows.columns else rows.withColumn("bucket", self._bucket(base)).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", "source_type", "id").write.partitionBy("bucket", "source_type").parquet(at)
        buckets = [int(n[7:]) for n in storage.names(self.spark, at) if n.startswith("bucket=")]
        schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("source_type", *DEALT)], T.StructField("bucket", T.IntegerType()), T.StructField("source_type", T.StringType())])
        counts = {r["change"]: r["count"] for r in self.spark.read.schema(schema).parquet(at).groupBy("change").count().collect()} if buckets else {}
        return {"folder": folder, "buckets": sorted(buckets), "counts": counts}

    def discard(self, layer: dict) -> None:
        storage.delete(self.spark, f"{self.root}/{layer['folder']}")

    def _layer(self, manifest: dict, layer: dict, buckets: set[int]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{layer['folder']}").where(F.col("bucket").isin(sorted(buckets)))

    def _read(self, manifest: dict, columns: list[str], only: set[int] | None = None) -> DataFrame:
        """`columns` (id among them) of all live rows, of the buckets in `only` if given."""
        first: dict[int, int] = {}
        for i, layer in enumerate(manifest["layers"]):
            for b in layer["buckets"]:
                first.setdefault(b, i)
        parts, newer = [], []
        changed = {b for i, layer in enumerate(manifest["layers"]) for b in layer["buckets"] if first[b] != i}
        for i, layer in enumerate(manifest["layers"]):
            own = {b for b in layer["buckets"] if only is None or b in only}
            still = {b for b in own if first[b] == i}
            rows = functools.partial(self._layer, manifest, layer)
            # Buckets of one layer are read as they are.
            if still - changed:
                parts.append((rows(still - changed), False))
            if still & changed:
                parts.append((rows(still & changed), True))
            if own - still:
                newer.append(rows(own - still).withColumn("seq", F.lit(i)))
        if not parts:
            return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"])).select(columns)
        out = None
        deltas = functools.reduce(DataFrame.unionByName, newer) if newer else None
        for rows, merged in parts:
            own = rows.where("change <> 'delete'")
            if merged:
                own = own.join(deltas.select("id").distinct(), "id", "left_anti")
            own = own.select(columns)
            out = own if out is None else out.unionByName(own)
        if deltas is not None:
            latest = deltas.groupBy("id").agg(F.max_by(F.struct("change", *[c for c in columns if c != "id"]), "seq").alias("d"))
            out = out.unionByName(latest.where("d.change <> 'delete'").select("id", "d.*").select(columns))
        return out

    def columns(self, manifest: dict) -> list[str]:
        return list(manifest["columns"])

    def rows(self, manifest: dict | None = None) -> DataFrame | None:
        """All live rows; filters on source_type and on other columns reach the files. None before the first change."""
        manifest = manifest or self.manifest()
        return self._read(manifest, self.columns(manifest)) if manifest else None

    def hashes(self, manifest: dict | None = None) -> DataFrame | None:
        """id, source_type and content_hash of all live rows; no other column is read."""
        manifest = manifest or self.manifest()
        return self._read(manifest, ["id", "source_type", "content_hash"]) if manifest else None

    def changed(self, base: dict | None, layer: dict, columns: list[str], schema: T.StructType, **facts) -> dict:
        """The manifest that follows `base` by one layer."""
        base, counts = base or {}, layer["counts"]
        layers = [*base.get("layers", []), *([{"folder": layer["folder"], "buckets": layer["buckets"]}] if layer["buckets"] else [])]
        count = base.get("document_count", 0) + counts.get("insert", 0) - counts.get("delete", 0)
        fields = [*[f for f in schema.fields if f.name != "source_type"], T.StructField("bucket", T.IntegerType()), T.StructField("source_type", T.StringType())]
        return base | {"buckets": base.get("buckets", self.buckets), "layers": layers, "document_count": count, "columns": columns, "schema": T.StructType(fields).jsonValue()} | facts

    def chains(self, manifest: dict) -> dict[int, int]:
        """How many layers each bucket has."""
        out: dict[int, int] = {}
        for layer in manifest["layers"]:
            for b in layer["buckets"]:
                out[b] = out.get(b, 0) + 1
        return out

    def compact(self, longer: int = 1) -> bool:
        """Write buckets of more than `longer` layers anew as one; whether there were any. If another writer comes between, it is tried again."""
        for _ in range(TRIES):
            base = self.manifest()
            wide = {b for b, n in self.chains(base).items() if n > longer} if base else set()
            if not wide:
                return False
            columns = self.columns(base)
            layers = [self._layer(base, x, wide & set(x["buckets"])).withColumn("seq", F.lit(i)) for i, x in enumerate(base["layers"]) if wide & set(x["buckets"])]
            rows = self.dealt(functools.reduce(DataFrame.unionByName, layers), base)
            latest = rows.groupBy(*DEALT, "id").agg(F.max_by(F.struct("change", *[c for c in columns if c != "id"]), "seq").alias("d"))
            live = latest.where("d.change <> 'delete'").select(*DEALT, "id", "d.*").select(*columns, *DEALT).withColumn("change", F.lit("insert"))
            layer = self.write_layer(live, base)
            layers = [{"folder": x["folder"], "buckets": [b for b in x["buckets"] if b not in wide]} for x in base["layers"]]
            layers = [x for x in [*layers, {"folder": layer["folder"], "buckets": layer["buckets"]}] if x["buckets"]]
            if self.commit(base, base | {"layers": layers}):
                return True
            self.discard(layer)
        raise ConflictError("no chance to compact between other writers")

    def apply(self, change: Callable[[dict | None], tuple[dict, dict]]) -> tuple[dict, dict]:
        """Commit what `change` makes of the current manifest: (a layer that is written, the next manifest). It is asked again if another writer was faster."""
        for _ in range(TRIES):
            base = self.manifest()
            layer, following = change(base)
            if following is base or self.commit(base, following):
                if following is not base and max(self.chains(following).values(), default=0) > MAX_LAYERS:
                    self.compact(MAX_LAYERS)
                return layer, following
            log.info("another writer has changed %s; starting again", self.root)
            self.discard(layer)
        raise ConflictError(f"{TRIES} attempts to change {self.root} came too late")

    # --- search

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows with the ids in the column `id`, without their vectors. Of few ids (a checked number) only the files of their buckets are read, and of those only what may hold them."""
        manifest = self.manifest()
        columns = [c for c in self.columns(manifest) if c != "vector"]
        wanted = ids.select("id").distinct()
        few = wanted.limit(MAX_IDS + 1).select("id", self._bucket(manifest).alias("bucket")).collect()
        if len(few) > MAX_IDS:
            return self._read(manifest, columns).join(wanted, "id", "left_semi")
        return self._read(manifest, columns, {r["bucket"] for r in few}).where(F.col("id").isin([r["id"] for r in few]))

    def query(self, vector: list[float], k: int = 5, filters: dict[str, object] | None = None) -> DataFrame:
        """The nearest rows to one vector, of those that equal each of `filters` (any column): the columns of rows but vector and content_hash, score and rk."""
        asked = self.spark.createDataFrame([(1, [float(x) for x in vector])], "query_id long, vector array<double>")
        return self.search(asked.withColumns({f"_f{i}": F.lit(v) for i, v in enumerate((filters or {}).values())}), k, {c: f"_f{i}" for i, c in enumerate(filters or {})}).drop("query_id")

    def search(self, queries: DataFrame, k: int = 5, equal: dict[str, str] | None = None) -> DataFrame:
        """The k nearest rows for each of `queries` (query_id, vector): query_id, the columns of rows but vector and content_hash, score and rk.

        `equal` names, for any column of rows, the column of `queries` it must equal where that is neither null nor empty. The values that a batch asks for go to the scan as one predicate.
        """
        rows = self.rows()
        if rows is None:
            raise RuntimeError("the store is empty")
        rows = pushed(rows, queries, equal or {})
        hits = kept(top_k(queries, rows.withColumn("_all", F.lit(True)), k, "_all", equal).drop("_all"))
        return hits.join(self.lookup(hits).drop("content_hash"), "id")


def kept(hits: DataFrame) -> DataFrame:
    """`hits` written to the shared folder: a few rows for each query, that more than one step needs."""
    spark, folder = hits.sparkSession, storage.work_folder(hits.sparkSession, "hits")
    hits.write.parquet(folder)
    return spark.read.schema(hits.schema).parquet(folder)


def pushed(rows: DataFrame, queries: DataFrame, equal: dict[str, str]) -> DataFrame:
    """`rows` without those that no query's filters let in, as one predicate that the scan sees. Filters of one group only, and those that some query leaves open, give none."""
    whole = {c: v for c, v in equal.items() if ":" not in c}
    if not whole:
        return rows
    wants = [F.collect_set(v).alias(f"v{i}") for i, v in enumerate(whole.values())]
    free = [F.count_if(F.col(v).isNull() | (F.col(v).cast("string") == "")).alias(f"n{i}") for i, v in enumerate(whole.values())]
    many = [F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(whole.values())]
    counted = queries.agg(*free, *many).first()
    use = [(i, c) for i, c in enumerate(whole) if counted[f"n{i}"] == 0 and 0 < counted[f"d{i}"] <= MAX_VALUES]
    if not use:
        return rows
    values = queries.agg(*[wants[i] for i, _ in use]).first()
    for i, c in use:
        rows = rows.where(F.col(c).isin(values[f"v{i}"]))
    return rows
