"""Exact search over cells against the full search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from corvane.operators import cells, knn, sweep


@pytest.mark.parametrize("kind", ["clustered", "scattered", "ties"])
def test_cells_give_the_rows_of_the_full_search(spark, tmp_path, monkeypatch, kind):
    """Tight clusters, no clusters at all, and whole numbers with many ties, zero and null vectors and vectors of another length."""
    monkeypatch.setattr(cells, "PART", 700)
    monkeypatch.setattr(sweep, "SHARE", 15)
    rng = np.random.default_rng(3)
    if kind == "clustered":
        middle = rng.normal(size=(20, 8))
        rows = [(i, (middle[i % 20] + rng.normal(size=8) * 0.05).tolist()) for i in range(2000)]
        rows += [(2000 + i, rows[0][1]) for i in range(30)]
    elif kind == "scattered":
        rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    else:
        rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(900)] + [(1000, None), (1001, [1.0]), (1002, [])]
    dim = len(rows[0][1])
    asked = [(q, rows[q * 7][1]) for q in range(40)] + [(100, rng.normal(size=dim).tolist()), (101, [0.0] * dim), (102, None)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    store = cells.Cells(spark, str(tmp_path / "cells")).build(table, cells=30, sample=600)
    hits, read = store.search(queries, 5)
    full = knn.top_k(queries, table.selectExpr("*", "'a' as source_type"), 5)
    state = lambda found: {(r.query_id, r.rk): (r.id, r.score) for r in found.collect()}
    assert state(hits) == state(full)
    share = {r.query_id: r.share for r in read.collect()}
    assert set(share) == {q for q, _ in asked} and all(0 < s <= 1 for s in share.values()) and share[101] == share[102] == 1.0
    if kind == "clustered":
        assert np.mean([share[q] for q in range(40)]) < 0.15
    assert store.search(queries.limit(0), 5)[0].count() == 0


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<float>")
    store = cells.Cells(spark, str(tmp_path / "none")).build(none)
    hits, read = store.search(spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 3)
    assert hits.count() == 0 == read.count()


def test_files_of_other_cells_are_not_read(spark, tmp_path):
    """A query near one of two far clusters reads the files of its own."""
    rows = spark.createDataFrame([(i, [1.0, i / 1e4, 0.0] if i % 2 else [0.0, i / 1e4, 1.0]) for i in range(400)], "id long, vector array<double>")
    store = cells.Cells(spark, str(tmp_path / "two")).build(rows, cells=2)
    hits, read = store.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<double>"), 3)
    assert [r.id for r in hits.orderBy("rk").collect()] == [1, 3, 5] and (tmp_path / "two/rows/cell=0").exists()
    monkey = cells.PROBES
    try:
        cells.PROBES = 1
        assert store.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<double>"), 3)[1].first().share == 0.5
    finally:
        cells.PROBES = monkey


def test_rows_go_out_once_for_each_share_of_their_own_queries(spark):
    """30 values of 10 queries each make one share a value, not one for each 15 of all 300."""

    class Count:
        def __init__(self, queries):
            self.queries, self.rows = queries.num_rows, 0

        def take(self, rows):
            self.rows += rows.num_rows

        def result(self):
            yield pa.RecordBatch.from_pydict({"queries": [self.queries], "rows": [self.rows]})

    share, sweep.SHARE = sweep.SHARE, 15
    try:
        both = spark.range(300).selectExpr("id", "cast(id % 30 as int) as at")
        found = sweep.sweep(both, spark.range(900).selectExpr("id", "cast(id % 30 as int) as at"), Count, T.StructType().add("queries", "long").add("rows", "long"), on="at", parts=1).collect()
    finally:
        sweep.SHARE = share
    assert [tuple(r) for r in found] == [(10, 30)] * 30


def test_a_query_goes_once_to_each_place(spark, tmp_path, monkeypatch):
    """Of 30 cells in 4 or 5 places; and hits worse than those of the first look are left out by the second."""
    monkeypatch.setattr(cells, "PLACES", 4)
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1200)], "id long, vector array<double>")
    queries = table.where("id < 20").withColumnRenamed("id", "query_id")
    store, looks, plain = cells.Cells(spark, str(tmp_path / "cells")).build(table, cells=30), [], sweep.sweep

    def watched(asked, rows, *args, **kwargs):
        found = plain(asked, rows, *args, **kwargs)
        looks.append((asked.count(), found.where("score is not null").count()))
        return found

    monkeypatch.setattr(sweep, "sweep", watched)
    hits, _ = store.search(queries, 5)
    monkeypatch.undo()
    full = knn.top_k(queries, table.selectExpr("*", "'a' as source_type"), 5)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in full.select("query_id", "id", "score", "rk").collect()}
    assert len(looks) == 2 and all(n <= 20 * 8 for n, _ in looks) and looks[1][1] <= 20 * 5 * 4
