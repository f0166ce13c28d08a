"""Exact nearest neighbours by cosine, for any number of queries in one pass over the vectors.

A task keeps its own best rows of each query and group, so what is shuffled afterwards grows with queries and tasks, not with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import sweep as S

#: Scores that a task holds at once, about.
CELLS = 1 << 21
#: Decimals of scores, so that equal vectors tie whatever the order of summation.
DECIMALS = 9
#: Rows kept for later that make a task cut them down to the best.
PENDING = 4_000_000


def unit(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a column of lists as vectors of length 1; a null row, or one of another length, is a zero vector."""
    good = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    m = np.zeros((len(vectors), dim))
    m[good.to_numpy(zero_copy_only=False) if isinstance(good, pa.Array) else good.to_numpy()] = pc.list_flatten(vectors.filter(good)).to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = np.sqrt((m * m).sum(axis=1))
    return m / np.where(size > 0, size, 1)[:, None]


class _Nearest:
    """The k best rows of each query and group so far."""

    def __init__(self, queries: pa.Table, k: int, group: str, equal: dict[str, str], schema: pa.Schema):
        self.k, self.group, self.equal, self.schema = k, group, equal, schema
        self.ids = queries.column("query_id").combine_chunks()
        vectors = queries.column("vector")
        self.dim = pc.max(pc.list_value_length(vectors)).as_py() or 1
        self.vectors = unit(vectors, self.dim)
        self.wanted = [[v or None for v in queries.column(c).to_pylist()] for c in equal.values()]
        self.asking: dict = {}  # for each group: the queries by what they want of its rows
        self.floor: dict = {}  # for each group: the score of each query's k-th best so far
        self.found: list[pa.Table] = []
        self.pending = 0

    def _asking(self, g) -> dict[tuple, np.ndarray]:
        """The queries by what they want of rows of group `g`: a value for each of `equal`, or None."""
        if g not in self.asking:
            found: dict[tuple, list] = {}
            for i, values in enumerate(zip(*self.wanted, strict=True) if self.wanted else [()] * len(self.ids)):
                found.setdefault(tuple(v if c.partition(":")[2] in ("", g) else None for c, v in zip(self.equal, values, strict=True)), []).append(i)
            self.asking[g] = {values: np.array(own) for values, own in found.items()}
            self.floor[g] = np.full(len(self.ids), -2_000_000_000)
        return self.asking[g]

    def take(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))  # ties go to the first
        groups = rows.column(self.group).combine_chunks().dictionary_encode()
        codes = pc.fill_null(groups.indices, -1).to_numpy(zero_copy_only=False)
        vectors = unit(rows.column("vector"), self.dim)
        fields = [np.array(rows.column(c.partition(":")[0]).to_pylist(), object) for c in self.equal]
        for code in np.unique(codes):
            g = groups.dictionary[code].as_py() if code >= 0 else None
            for values, asking in self._asking(g).items():
                fits = codes == code
                for field, value in zip(fields, values, strict=True):
                    if value is not None:
                        fits &= field == value
                at = np.flatnonzero(fits)
                step = max(1, CELLS // max(len(at), 1))
                for a in range(0, len(asking) if len(at) else 0, step):
                    self._score(g, asking[a : a + step], at, vectors[at], rows)
        if self.pending > max(PENDING, 2 * self.k * len(self.ids)):
            self._cut()

    def _score(self, g, asking: np.ndarray, at: np.ndarray, vectors: np.ndarray, rows: pa.Table) -> None:
        score = np.rint(self.vectors[asking] @ vectors.T * 10**DECIMALS).astype(np.int64)
        fresh = score >= self.floor[g][asking][:, None]
        some = fresh.any(axis=1)
        if not some.all():
            asking, score, fresh = asking[some], score[some], fresh[some]
        if len(at) > self.k:
            # One number for score and place, so that of those that tie the first stay.
            both = score * len(at) + np.arange(len(at) - 1, -1, -1)
            best = np.argpartition(both, len(at) - self.k, axis=1)[:, len(at) - self.k :]
            q, r = np.nonzero(np.take_along_axis(fresh, best, axis=1))
            r = best[q, r]
        else:
            q, r = np.nonzero(fresh)
        if len(q):
            kind = pa.array([g], rows.column(self.group).type)
            self.found.append(pa.table([pa.array(asking[q]), pa.chunked_array([rows.column("id").combine_chunks().take(pa.array(at[r]))]), pa.chunked_array([kind.take(pa.array(np.zeros(len(q), np.int64)))]), pa.array(score[q, r])], names=["q", "id", "g", "s"]))
            self.pending += len(q)

    def _cut(self) -> pa.Table | None:
        """Leave the k best of each query and group."""
        if not self.found:
            return None
        have = pa.concat_tables(self.found)
        order = pc.sort_indices(have, [("g", "ascending"), ("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start")
        have = have.take(order)
        q, g = have.column("q").to_numpy(), have.column("g").combine_chunks().dictionary_encode()
        codes = pc.fill_null(g.indices, -1).to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (codes[1:] != codes[:-1])])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        place = np.arange(len(q)) - begin
        last = np.flatnonzero(place == self.k - 1)
        s = have.column("s").to_numpy()
        for code in np.unique(codes[last]):
            own = last[codes[last] == code]
            self.floor[g.dictionary[code].as_py() if code >= 0 else None][q[own]] = s[own]
        have = have.filter(pa.array(place < self.k))
        self.found, self.pending = [have], have.num_rows
        return have

    def result(self) -> Iterator[pa.RecordBatch]:
        have = self._cut()
        if have is not None:
            score = pc.divide(pc.cast(have.column("s"), pa.float64()), float(10**DECIMALS))
            yield from pa.table([self.ids.take(have.column("q").combine_chunks()), have.column("id"), have.column("g"), score], schema=self.schema).to_batches(max_chunksize=100_000)


def top_k(queries: DataFrame, rows: DataFrame, k: int, group: str = "source_type", equal: dict[str, str] | None = None) -> DataFrame:
    """The k nearest of `rows` (id, `group`, vector, and columns named in `equal`) for each of `queries` (query_id, vector) and group: query_id, id, group, score, rk.

    score is the cosine, 0 for a zero or null vector or one of another length than the queries' longest; ties go to the lower id, null first. `equal` names, for a column of `rows`, the
    column of `queries` it must equal where that is neither null nor empty; a key `column:group` holds in that group only.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    equal = equal or {}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    needed = sorted({c.partition(":")[0] for c in equal} - {group})
    out = T.StructType([T.StructField("q", queries.schema["query_id"].dataType), T.StructField("id", kinds["id"]), T.StructField("g", kinds[group]), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    asked = queries.select("query_id", "vector", *sorted(set(equal.values()) - {"query_id", "vector"}))
    found = S.sweep(asked, rows.select("id", group, "vector", *needed), lambda own: _Nearest(own, k, group, equal, to_arrow_schema(out)), out)
    order = Window.partitionBy("q", "g").orderBy(F.desc("score"), "id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select(F.col("q").alias("query_id"), "id", F.col("g").alias(group), "score", "rk")
