"""Helpers that several operators of this subpackage use: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-corvane-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corvane-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, below: str | None = None) -> DataFrame:
    """Write `df` to the shared folder (or to `below`, a folder in it that is removed when its work is done) and read it back, for tables that later rounds are made of.

    A checkpoint hands on the size that Spark expected of its plan, which for a join is the product of both sides. Over rounds of joins
    that number's digits double each time, until it alone fills the driver; a file has its own size.
    """
    spark = df.sparkSession
    folder = f"{below}/{uuid.uuid4().hex}" if below else scratch(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def counted(df: DataFrame, which: Column | None = None, below: str | None = None) -> tuple[DataFrame, int]:
    """`df` stored, and how many of its rows there are (or make `which` true), counted as they are written instead of by further jobs.

    A task that runs again may count its rows twice, so the number tells reliably only whether it is zero.
    """
    seen = Observation()
    written = stored(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")), below)
    return written, seen.get.get("n", 0)


#: Whether Spark removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this, each job's shuffle files go when what it has made is written, so that disk holds those of one job at a time whatever the driver's memory. What a caller is to run belongs outside."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow, giving Arrow's unused memory back at its end: a Python worker that waits for its next task keeps it otherwise."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def merged(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never sends a side through the driver, for tables whose size Spark can't foresee; it can still split hot keys."""
    return one.hint("merge").join(other.hint("merge"), on, how)


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], results: tuple[str, ...], needed: tuple[str, ...] = ()) -> list[str]:
    """`columns` without those that a result takes the place of, whatever their case. None of `needed` may be such a one."""
    taken = {c.lower() for c in results}
    for c in needed:
        if c.lower() in taken:
            raise ValueError(f"the column {c} has the name of a result; rename it")
    return [c for c in columns if c.lower() not in taken]


def utf8_size(c: Column) -> Column:
    """Bytes of a string in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
