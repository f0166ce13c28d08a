"""Hard negatives: for each anchor and positive, the best rows of other labels that score clearly below the positive.

Scores are integers, so limits and ties are exact. A task has a share of the anchors and takes the rows in batches: it scores them, sorts each
anchor's whole batch by score and id, finds each positive's upper limit by binary search and reads on from there down to the lower limit. An anchor's full
order is the merge of these sorted runs, so the first of each run, merged, are the first of all. The positives, which set the limits, come from a
first sweep of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import stored
from corvane.operators.sweep import sweep

#: What a component is multiplied with before it is rounded down.
SCALE = 256
#: Scores that a task holds at once, about.
CELLS = 1 << 20
#: Stands for an id that is null: it comes after all others.
NO_ID = (1 << 63) - 1
#: Stands for a row that does not count.
OUT = -(1 << 63)


def usable(vector: Column, label: Column) -> Column:
    """Whether a row takes part: it has a label, and a vector without null and non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False))


class _Anchors:
    """A share of anchors and what they have found so far, best first: `width` rows for each of `slots` searches."""

    def __init__(self, anchors: pa.Table, slots: int, width: int):
        self.table, self.width = anchors, width
        self.uid, self.labels = anchors.column("uid").to_numpy(), anchors.column("label").combine_chunks()
        self.vectors = _numbers(anchors.column("vector"))
        n = len(self.uid)
        self.score, self.id, self.row = np.full((n, slots, width), OUT), np.full((n, slots, width), NO_ID), np.full((n, slots, width), -1)

    def runs(self, rows: pa.Table) -> Iterator[tuple]:
        """(anchors, their scores of all rows, same label?, self?, ids, uids) in blocks of bounded size; rows come in the order of their ids."""
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("uid", "ascending")], null_placement="at_end"))
        ids, uid = pc.fill_null(rows.column("id"), NO_ID).to_numpy(), rows.column("uid").to_numpy()
        codes = pa.chunked_array([self.labels, *rows.column("label").chunks]).dictionary_encode().combine_chunks().indices.to_numpy()
        own, others = codes[: len(self.uid)], codes[len(self.uid) :]
        theirs = _numbers(rows.column("vector"))
        dim = max(self.vectors.shape[1], theirs.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (self.vectors, theirs))
        largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
        if largest >= 2.0**63:
            raise ValueError("vectors this large have scores beyond 64 bits")
        exact = (lambda m: m) if largest < 2.0**53 else (lambda m: m.astype(np.int64))  # floats are exact up to there
        a, b = exact(a), exact(b)
        step = max(1, CELLS // max(len(ids), 1))
        for i in range(0, len(own), step):
            some = slice(i, i + step)
            yield some, (a[some] @ b.T).astype(np.int64), own[some, None] == others[None, :], self.uid[some, None] == uid[None, :], ids, uid

    def merge(self, some: slice, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Put a run's best (anchors x slots x any number) together with those so far."""
        score, ids, rows = (np.concatenate([have[some], fresh], axis=2) for have, fresh in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -np.maximum(score, OUT + 1)), axis=2)[:, :, : self.width]
        self.score[some], self.id[some], self.row[some] = (np.take_along_axis(m, order, axis=2) for m in (score, ids, rows))

    def found(self) -> tuple[np.ndarray, ...]:
        """(anchor, slot, score, id, uid) of all that was found."""
        q, s, w = np.nonzero(self.row >= 0)
        return q, s, self.score[q, s, w], self.id[q, s, w], self.row[q, s, w]


def _numbers(vectors: pa.ChunkedArray) -> np.ndarray:
    """The rows' components times SCALE, rounded down; shorter rows end in zeros."""
    sizes = pc.list_value_length(vectors).to_numpy()
    flat = np.floor(pc.list_flatten(vectors).to_numpy().astype(np.float64) * SCALE)
    m = np.zeros((len(sizes), sizes.max(initial=0)))
    m[np.arange(m.shape[1])[None, :] < sizes[:, None]] = flat
    return m


class _Positives(_Anchors):
    """The first `count` other rows of an anchor's label."""

    def __init__(self, anchors: pa.Table, count: int, schema: pa.Schema):
        super().__init__(anchors, 1, count)
        self.schema = schema

    def take(self, rows: pa.Table) -> None:
        for some, score, same, self_, ids, uid in self.runs(rows):
            score = np.where(same & ~self_, score, OUT)
            order = np.argsort(-np.maximum(score, OUT + 1), axis=1, kind="stable")[:, : self.width]
            best = np.take_along_axis(score, order, axis=1)
            self.merge(some, best[:, None], np.where(best > OUT, ids[order], NO_ID)[:, None], np.where(best > OUT, uid[order], -1)[:, None])

    def result(self) -> Iterator[pa.RecordBatch]:
        q, _, score, ids, row = self.found()
        yield from pa.table([self.uid[q], row, pa.array(ids, mask=ids == NO_ID), score], schema=self.schema).to_batches(max_chunksize=100_000)


class _Negatives(_Anchors):
    """The first `count` rows of other labels between the limits of each positive."""

    def __init__(self, anchors: pa.Table, n_positives: int, count: int, low: int, high: int, schema: pa.Schema):
        super().__init__(anchors, n_positives, count)
        self.schema, self.low, self.high = schema, low, high
        limits = np.full((len(self.uid), n_positives), OUT)
        for q, scores in enumerate(anchors.column("limits").to_pylist()):
            limits[q, : len(scores)] = scores
        self.limits = limits

    def take(self, rows: pa.Table) -> None:
        for some, score, same, _, ids, uid in self.runs(rows):
            score = np.where(same, OUT, score)
            order = np.argsort(-np.maximum(score, OUT + 1), axis=1, kind="stable")  # equal scores stay in the order of ids
            score = np.take_along_axis(score, order, axis=1)
            limits, shape = self.limits[some], (score.shape[0], self.limits.shape[1], self.width)
            best, best_id, best_row = np.full(shape, OUT), np.full(shape, NO_ID), np.full(shape, -1)
            for q in range(shape[0]):
                known = limits[q] > OUT
                p = limits[q][known].astype(object) if np.abs(limits[q][known]).max(initial=0) > 1 << 55 else limits[q][known]
                upper = p * self.high // 100  # the highest score a negative may have
                lower = -(-p * self.low // 100)
                start = np.searchsorted(-np.maximum(score[q], OUT + 1), -upper.astype(np.int64), "left")
                at = start[:, None] + np.arange(self.width)[None, :]
                inside = at < score.shape[1]
                at = np.where(inside, at, 0)
                s = score[q][at]
                fits = inside & (s > OUT) & (s >= lower.astype(np.int64)[:, None]) & (s <= upper.astype(np.int64)[:, None])
                own = order[q][at]
                best[q, known], best_id[q, known], best_row[q, known] = np.where(fits, s, OUT), np.where(fits, ids[own], NO_ID), np.where(fits, uid[own], -1)
            self.merge(some, best, best_id, best_row)

    def result(self) -> Iterator[pa.RecordBatch]:
        q, slot, score, ids, row = self.found()
        yield from pa.table([self.uid[q], slot.astype(np.int32), row, pa.array(ids, mask=ids == NO_ID), score], schema=self.schema).to_batches(max_chunksize=100_000)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that `anchors` (a condition) holds for, and each of its positives, the best negatives.

    A score is the inner product of two rows' vectors, each component times SCALE and rounded down; higher scores come first, ties by the smaller id (null last). Positives are the first
    `n_positives` other rows of the anchor's label, or all. Of a positive with score p the negatives are the first `n_negatives` rows of other labels, or all, whose score is at least `low` and
    at most `high` hundredths of p; rank counts them from 1. A positive without negatives gives no row. Rows with a null label, or a vector that is null or has a null or non-finite component,
    take no part; a shorter vector ends in zeros, one without components scores 0. Ids are integers. A repeated row is a row of its own: an anchor again, and another row to its twin. An empty table gives an empty one.
    Vectors whose scores could exceed 64 bits are an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    clean = rows.where(usable(F.col(vector_col), F.col(label_col)))
    clean = stored(clean.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks")))
    asking, others = clean.where("asks").select("uid", "id", "vector", "label"), clean.select("uid", "id", "vector", "label")
    near = T.StructType.fromDDL("anchor long, row long, positive_id long, score long")
    found = sweep(asking, others, lambda own: _Positives(own, n_positives, to_arrow_schema(near)), near, few=0)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "row")
    positives = found.withColumn("slot", F.row_number().over(first) - 1).where(F.col("slot") < n_positives)
    # An anchor has at most n_positives positives, so its list is short.
    by_anchor = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_id", "score"))).alias("p"))
    by_anchor = stored(asking.join(by_anchor.withColumnRenamed("anchor", "uid"), "uid").withColumn("limits", F.transform("p", lambda x: x["score"])))
    far = T.StructType.fromDDL("anchor long, slot int, row long, negative_id long, score long")
    found = sweep(by_anchor.drop("p"), others, lambda own: _Negatives(own, n_positives, n_negatives, low, high, to_arrow_schema(far)), far, few=0)
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"), "row")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    named = by_anchor.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("p").alias("q")).select("anchor", "anchor_id", "q.slot", "q.positive_id", F.col("q.score").alias("positive_score"))
    joined = best.withColumnRenamed("score", "negative_score").join(named, ["anchor", "slot"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
