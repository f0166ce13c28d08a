"""An exact nearest-neighbour search that leaves out what cannot count: an inverted file of cells.

Vectors lie in the cell of their nearest centroid, stored by cell and, within it, by their angle to the centroid. A search first looks into the cells nearest to each query, which gives
a score that its k-th hit has at least. By the triangle inequality a vector's angle to the query is at least the difference of their angles to any centroid, so after that only
those cells, and of a cell only that ring of angles, are read that can hold as good a row. The result is that of the full search; how much was scored is part of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.operators import knn, sweep
from corvane.sources import storage

CELLS = 256
#: Vectors that the centroids are made from, at most: those of the lowest id hash.
SAMPLE = 50_000
#: Cells that the first look takes at least.
PROBES = 2
#: Rows that go to one task, about.
PART = 250_000
#: Places that cells are dealt to, at least: each is a task, or one for each share of the queries.
PLACES = 64
#: The cell of zero vectors, whose score is 0 with any query.
NOWHERE = -1
#: The floor of a query that has no k-th hit yet: less than any score.
NO_FLOOR = -2.0
#: Angles and scores are compared with this much room, more than rounding takes.
ROOM = 1e-6


def centroids(vectors: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most `n` unit vectors near which unit vectors lie."""
    found = np.unique(vectors, axis=0)
    found = found[np.random.default_rng(1).permutation(len(found))[:n]]
    for _ in range(rounds):
        near = np.argmax(vectors @ found.T, axis=1)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(vectors[order], first, axis=0)
        size = np.linalg.norm(total, axis=1)
        found[used[size > 0]] = total[size > 0] / size[size > 0, None]
    return found


class _InRings(knn._Nearest):
    """The k nearest of the rows of some cells, for queries that each look at a ring of angles (low to high) of some of them. Rows worse than a query's `floor` are left out."""

    def __init__(self, queries: pa.Table, k: int, schema: pa.Schema):
        super().__init__(queries, k, "cell", {}, schema)
        looks = queries.column("looks").combine_chunks()
        cell, low, high = (looks.flatten().field(f).to_numpy() for f in ("cell", "low", "high"))
        who = np.repeat(np.arange(len(self.ids)), pc.list_value_length(looks).to_numpy())
        # For each cell: its queries, and the rings that they look at.
        self.looks = {int(c): (who[cell == c], low[cell == c], high[cell == c]) for c in np.unique(cell)}
        # One group of all cells, so that a query keeps k rows, not k of each cell.
        self.floor[None] = np.rint(queries.column("floor").to_numpy() * 10**knn.DECIMALS).astype(np.int64)
        self.scored = np.zeros(len(self.ids), np.int64)

    def take(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
        cell, angle, vectors = rows.column("cell").to_numpy(), rows.column("angle").to_numpy(), knn.unit(rows.column("vector"), self.dim)
        for c in np.unique(cell).tolist():
            asking, low, high = self.looks.get(c, (np.zeros(0, int),) * 3)
            if not len(asking):
                continue
            at = np.flatnonzero((cell == c) & (angle >= low.min()) & (angle <= high.max()))
            if not len(at):
                continue
            own = np.sort(angle[at])
            self.scored[asking] += np.searchsorted(own, high, "right") - np.searchsorted(own, low, "left")
            step = max(1, knn.CELLS // len(at))
            for a in range(0, len(asking), step):
                self._score(None, asking[a : a + step], at, vectors[at], rows)
        if self.pending > max(knn.PENDING, 2 * self.k * len(self.ids)):
            self._cut()

    def result(self) -> Iterator[pa.RecordBatch]:
        have = self._cut()
        n = have.num_rows if have is not None else 0
        score = have.column("s").to_numpy() / 10.0**knn.DECIMALS if n else np.zeros(0)
        ids = have.column("id").combine_chunks() if n else pa.nulls(0, self.schema.field("id").type)
        q = self.ids.take(have.column("q").combine_chunks()) if n else self.ids.slice(0, 0)
        everyone = len(self.ids)  # a row for each query says how many rows it was scored with
        yield from pa.table([pa.concat_arrays([q, self.ids]), pa.concat_arrays([ids, pa.nulls(everyone, ids.type)]), pa.array(np.concatenate([score, np.zeros(everyone)]), mask=np.arange(n + everyone) >= n), pa.array(np.concatenate([np.zeros(n, np.int64), self.scored]))], schema=self.schema).to_batches(max_chunksize=100_000)


class Cells:
    """Vectors of a table in cells below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
        """Store `rows` (id, vector). The centroids come from `sample` rows at most; every row is stored, whatever its vector; one of another length than the longest of the sample, or a null, is a zero vector."""
        drawn = rows.where("vector is not null and size(vector) > 0").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector")
        dim = max((len(v) for v in drawn), default=1)
        vectors = knn.unit(drawn, dim)
        vectors = vectors[np.abs(vectors).any(axis=1)]
        centers = centroids(vectors, cells) if len(vectors) else np.eye(1, dim)
        schema = T.StructType([rows.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        sent = self.spark.sparkContext.broadcast(centers)  # cells x dim numbers

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = knn.unit(batch.column("vector"), dim)
                near = own @ sent.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), cell], -1, 1))
                cell[~np.abs(own).any(axis=1)] = NOWHERE
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, dim), pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), flat, pa.array(cell, pa.int32()), pa.array(angle)], names=schema.names)

        placed = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, schema).hint("rebalance", "cell")
        placed.sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        known = self.spark.read.schema(schema).parquet(f"{self.path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        storage.write_json(self.spark, f"{self.path}/cells.json", {"schema": schema.jsonValue(), "centers": centers.tolist(), "cells": [r.asDict() for r in known]})
        return self

    def _places(self, meta: dict) -> dict[int, tuple[int, int]]:
        """Where each cell's rows go: the first place, and how many follow each other. Small cells share a place; those of over PART rows, or of more than a place's share, are dealt over several."""
        cells = sorted(meta["cells"], key=lambda c: (-c["n"], c["cell"]))
        total = sum(c["n"] for c in cells)
        full = max(1, min(PART, -(-total // PLACES)))  # rows of a place
        found, at, load = {}, 0, 0
        for c in cells:
            if load and load + c["n"] > full:
                at, load = at + 1, 0
            width = -(-c["n"] // full)
            found[c["cell"]] = (at, width)
            if width > 1:
                at += width
            else:
                load += c["n"]
        return found

    def _looks(self, queries: DataFrame, k: int, meta: dict, first: bool) -> DataFrame:
        """(query_id, vector, floor, looks): the cells and rings (cell, low, high) that each query looks into, in its first look or, with its `floor` (and the cells it has been to, as before), in its second."""
        kind = queries.schema["query_id"]
        look = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
        schema = T.StructType([kind, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("floor", T.DoubleType()), T.StructField("looks", T.ArrayType(look))])
        cells = sorted(meta["cells"], key=lambda c: c["cell"])
        number, n, low, high = (np.array([c[f] for c in cells], kind) for f, kind in (("cell", int), ("n", int), ("low", float), ("high", float)))
        sent = self.spark.sparkContext.broadcast((np.array(meta["centers"]), number, n, low, high))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, number, n, low, high = sent.value
            for batch in batches:
                own = knn.unit(batch.column("vector"), centers.shape[1])
                to = np.arccos(np.clip(own @ centers[np.maximum(number, 0)].T, -1, 1))  # queries x cells
                bound = np.cos(np.maximum(0, np.maximum(low - to, to - high)))
                flat = ~np.abs(own).any(axis=1)
                bound[flat] = 0.0
                bound[:, number == NOWHERE] = 0.0
                order = np.argsort(-bound + to * 1e-6, axis=1, kind="stable")
                rows = n[order].cumsum(axis=1)
                been = np.zeros(bound.shape, bool)
                np.put_along_axis(been, order, (rows - n[order] < k) | (np.arange(len(n)) < PROBES)[None, :], axis=1)
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                if first:
                    take, reach = been, np.full(len(own), 4.0)
                else:
                    take = ~been & (bound >= floor[:, None] - ROOM)
                    reach = np.where(flat, 4.0, np.arccos(np.clip(floor - ROOM, -1, 1)) + ROOM)
                q, c = np.nonzero(take)
                ring = np.where(number[c] == NOWHERE, 4.0, reach[q])
                looks = pa.StructArray.from_arrays([pa.array(number[c], pa.int32()), pa.array(to[q, c] - ring), pa.array(to[q, c] + ring)], names=look.names)
                ends = np.searchsorted(q, np.arange(len(own) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(floor), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), looks)], names=schema.names)

        return queries.mapInArrow(choose, schema)

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rk of the k nearest of each of `queries` (query_id, vector); query_id, scored, share: with how many rows each query was scored, and what part of all that is).

        Hits are those of `knn.top_k`, ties and zero vectors included. What each look finds is written to a shared folder.
        """
        meta = storage.read_json(self.spark, f"{self.path}/cells.json")
        schema = T.StructType.fromJson(meta["schema"])
        total, places = sum(c["n"] for c in meta["cells"]), self._places(meta)
        firsts, widths = (F.create_map(*[F.lit(x) for c, p in places.items() for x in (c, p[i])]) if places else F.create_map().cast("map<int,int>") for i in (0, 1))
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(NO_FLOOR).alias("floor"))
        out = T.StructType([queries.schema["query_id"], schema["id"], T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType())])
        kernel = partial(_InRings, k=k, schema=to_arrow_schema(out))

        def look(wanted: DataFrame) -> DataFrame:
            folder = storage.work_folder(self.spark, "look")
            wanted.write.parquet(f"{folder}/wanted")
            wanted = self.spark.read.schema(wanted.schema).parquet(f"{folder}/wanted")
            span = wanted.select(F.explode("looks").alias("l")).groupBy("l.cell").agg(F.min("l.low").alias("low"), F.max("l.high").alias("high")).collect()  # as many as there are cells
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("cell").isin([r["cell"] for r in span]))
            if span:
                rows = rows.where(F.col("angle").between(min(r["low"] for r in span), max(r["high"] for r in span)))
            # A query goes once to each place that holds cells it looks into, with these looks.
            at = F.explode(F.array_distinct(F.flatten(F.transform("looks", lambda x: F.sequence(firsts[x["cell"]], firsts[x["cell"]] + widths[x["cell"]] - 1)))))
            here = lambda x: (firsts[x["cell"]] <= F.col("place")) & (F.col("place") < firsts[x["cell"]] + widths[x["cell"]])
            sent = wanted.select("*", at.alias("place")).withColumn("looks", F.filter("looks", here))
            rows = rows.withColumn("place", firsts[F.col("cell")] + F.pmod(F.xxhash64("id"), widths[F.col("cell")]).cast("int"))
            found = sweep.sweep(sent, rows, kernel, out, on="place", parts=1)
            found.write.parquet(f"{folder}/found")
            return self.spark.read.schema(out).parquet(f"{folder}/found")

        best = lambda found: found.where("score is not null").withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rk") <= k)
        once = look(self._looks(asked, k, meta, True))
        floors = best(once).where(F.col("rk") == k).select("query_id", F.col("score").alias("floor"))
        again = asked.drop("floor").join(floors, "query_id", "left").fillna({"floor": NO_FLOOR}).select(asked.columns)
        found = once.unionByName(look(self._looks(again, k, meta, False)))
        hits = best(found).select("query_id", "id", "score", "rk")
        return hits, found.groupBy("query_id").agg(F.sum("scored").alias("scored")).withColumn("share", F.col("scored") / F.lit(max(total, 1)))
