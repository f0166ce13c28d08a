"""Every query against every row, in one pass: the frame of exact searches.

Few queries (a checked number) go to where the rows are. More of them are dealt out in shares: a task gets one share of the queries and one part of the rows,
first the queries, then the rows as a stream. So a task holds a share of the queries and a batch of rows, whatever the sizes of both, and
nothing of either passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are sent to the rows, at most.
FEW = 4_096
#: Queries that a task holds, about.
SHARE = 32_768
#: Rows that are searched at once.
ROWS = 4_096


class Kernel(Protocol):
    """What a task does with its queries."""

    def take(self, rows: pa.Table) -> None: ...

    def result(self) -> Iterator[pa.RecordBatch]: ...


def sweep(queries: DataFrame, rows: DataFrame, kernel: Callable[[pa.Table], Kernel], schema: T.StructType, few: int = FEW, on: str | None = None, parts: int | None = None) -> DataFrame:
    """The results of `kernel` (made of a task's queries) once it has taken a part of `rows`; each query meets each row in exactly one task.

    With `on`, a column of both, queries meet only rows of their value; `parts` is the number of tasks that share the rows of one value, and rows are sent once for each share of the queries
    of the value that has the most of them.
    """
    spark = rows.sparkSession
    head = queries.limit(few + 1).toArrow() if few and on is None else None
    if head is not None and head.num_rows <= few:
        sent = spark.sparkContext.broadcast(head)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = kernel(sent.value)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    own.take(pa.Table.from_batches([batch.slice(i, ROWS)]))
            yield from own.result()

        return rows.mapInArrow(scan, schema)
    asking = queries.count() if on is None else queries.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    parts, shares = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-asking // SHARE))
    any_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    key = F.lit(0).alias("key") if on is None else F.col(on).alias("key")
    asked = queries.select(key, F.struct(*queries.columns).alias("query"), one_of(shares).alias("share")).select("key", "share", any_of(parts).alias("part"), F.lit(0).alias("kind"), "query")
    held = rows.select(key, F.struct(*rows.columns).alias("row"), one_of(parts).alias("part")).select("key", any_of(shares).alias("share"), "part", F.lit(1).alias("kind"), "row")
    place = ["key", "share", "part"]
    both = asked.unionByName(held, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, questions, own = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                *there, kind = marks[a].tolist()
                if there != now:
                    if own is not None:
                        yield from own.result()
                    now, questions, own = there, [], None
                if kind == 0:
                    questions.append(_struct(batch.column("query").slice(a, b - a)))
                    continue
                if own is None and questions:
                    own, questions = kernel(pa.concat_tables(questions).combine_chunks()), []
                for i in range(a, b, ROWS) if own is not None else ():
                    own.take(_struct(batch.column("row").slice(i, min(ROWS, b - i))))
        if own is not None:
            yield from own.result()

    return both.mapInArrow(run, schema)


def _struct(column: pa.StructArray) -> pa.Table:
    return pa.Table.from_arrays(column.flatten(), names=[column.type.field(i).name for i in range(column.type.num_fields)])
