"""Newline-delimited JSON records, each line checked against a strict schema.

Bad lines are set apart with the reason and never fail a job. Spark's own JSON readers accept numbers as strings, nulls in
lists and trailing text, and reject numbers in strings, so lines are checked in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane import schemas as S
from corvane.sources import storage

_INTEGER = re.compile(r"\s*([+-]?\d+(?:_\d+)*)(?:\.0*)?\s*")


def _string(value):
    if not isinstance(value, str):
        raise ValueError("not a string")
    return value


def _list(value):
    if not isinstance(value, list):
        raise ValueError("not a list")
    return [_string(v) for v in value]


def _map(value):
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return [(k, None if v is None else _string(v)) for k, v in value.items()]


def _integer(value):
    """Whole numbers, also as floats, booleans and strings; those beyond 32 bits are errors."""
    if isinstance(value, str):
        if not (m := _INTEGER.fullmatch(value)):
            raise ValueError("not an integer")
        value = int(m[1])
    elif not isinstance(value, int | float) or value != int(value):
        raise ValueError("not an integer")
    if not -(1 << 31) <= value < 1 << 31:
        raise ValueError("integer out of range")
    return int(value)


def _time(value):
    """ISO dates and times, and seconds or milliseconds since 1970; UTC where no zone is given."""
    if isinstance(value, str) and not re.fullmatch(r"[+-]?\d+(\.\d+)?", value):
        at = datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise ValueError("not a time")
    seconds = float(value)
    return datetime.fromtimestamp(seconds / 1000 if abs(seconds) > 2e10 else seconds, UTC)


def _level(value):
    if value not in S.DEGREE_LEVELS:
        raise ValueError("not a degree level")
    return value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def check_line(line: str, schema: T.StructType, required: tuple[str, ...]) -> dict:
    """The record of a line; ValueError says what is wrong. Other keys are ignored; of a key given twice the last counts."""
    record = json.loads(line, parse_constant=_no_constant)
    if not isinstance(record, dict):
        raise ValueError("not an object")
    out = {}
    for f in schema.fields:
        value, plural = record.get(f.name), isinstance(f.dataType, T.ArrayType | T.MapType)
        if f.name not in record and (plural or f.name not in required):
            out[f.name] = [] if plural else None
        elif value is None and not plural and f.name not in required:
            out[f.name] = None
        else:
            kind = _list if isinstance(f.dataType, T.ArrayType) else _map if isinstance(f.dataType, T.MapType) else _integer if isinstance(f.dataType, T.IntegerType) else _time if isinstance(f.dataType, T.TimestampType) else _level if f.name == "degree_level" else _string
            try:
                out[f.name] = kind(value)
            except (ValueError, OverflowError) as e:
                raise ValueError(f"{f.name}: {e}") from None
    return out


def _fields(source_type: str) -> tuple[T.StructType, tuple[str, ...]]:
    return (S.PUBLICATION if source_type == "publication" else S.POSTING), S.REQUIRED[source_type]


def _checked(line: str, valid_text: bool, schema: T.StructType, required: tuple[str, ...]) -> dict:
    """The columns of a line that is not blank: its record, is_valid and error."""
    row = dict.fromkeys(schema.names) | {"line": line, "is_valid": True, "error": None}
    if not valid_text:
        return row | {"is_valid": False, "error": "not UTF-8"}
    try:
        return row | check_line(line, schema, required)
    except (ValueError, RecursionError) as e:
        return row | {"is_valid": False, "error": str(e)[:200]}


_JUDGED = [T.StructField("line", T.StringType()), T.StructField("is_valid", T.BooleanType()), T.StructField("error", T.StringType())]


def check_lines(lines: DataFrame, source_type: str) -> DataFrame:
    """The fields of the record in each line of the column `value`, with the columns line, is_valid and error. Blank lines are left out; fields of a bad line are null.

    A line whose bytes are not UTF-8 is a bad line, with replacement characters in `line`.
    """
    schema, required = _fields(source_type)
    out = T.StructType([*schema.fields, *_JUDGED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            rows = [_checked(line, fine, schema, required) for line, fine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if line and line.strip()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return lines.select(F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("fine")).mapInArrow(run, out)


def read_records(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """`check_lines` of a file or folder; a path that is not there counts as empty."""
    lines = spark.read.text(path) if storage.exists(spark, path) else spark.createDataFrame([], "value string")
    return check_lines(lines, source_type)


#: Where a line stands: its file, where the block that Spark reads begins in it, and the line's place in that block.
PLACE = [T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("place", T.LongType())]


class Staged:
    """The checked lines of a file or folder, written to the folder `at` once: parsing is the dear part, and later steps read it again."""

    def __init__(self, spark: SparkSession, path: str, source_type: str, at: str):
        self.spark, self.at = spark, at
        schema, required = _fields(source_type)
        self.schema = T.StructType([*schema.fields, *_JUDGED[::2], *PLACE, T.StructField("kind", T.StringType())])
        out = self.schema
        if not storage.exists(spark, path):
            spark.createDataFrame([], out).write.partitionBy("kind").parquet(at)
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Lines of a block come in their order and one block after another, so their places can be counted."""
            arrow, block, place = to_arrow_schema(out), None, 0
            end = lambda: dict.fromkeys(out.names) | {"file": block[0], "block": block[1], "place": place, "kind": "end"}
            for batch in batches:
                rows = []
                for line, fine, file, begins in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if (file, begins) != block:
                        if block is not None:
                            rows.append(end())
                        block, place = (file, begins), 0
                    if line.strip():
                        row = _checked(line, fine, schema, required)
                        kind = "valid" if row.pop("is_valid") else "invalid"
                        rows.append(row | {"file": file, "block": begins, "place": place, "kind": kind, "line": None if kind == "valid" else line})
                    place += 1
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            if block is not None:
                yield pa.RecordBatch.from_pylist([end()], schema=arrow)

        lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("fine"), "_metadata.file_path", "_metadata.file_block_start")
        lines.mapInArrow(run, out).write.partitionBy("kind").parquet(at)

    def _kind(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.at).where(F.col("kind") == kind)

    def records(self) -> DataFrame:
        """The records of valid lines, with the columns of PLACE, in whose order lines stand in a file."""
        return self._kind("valid").drop("line", "error", "kind")

    def bad_lines(self) -> DataFrame:
        """file, number (from 1, as in the whole file, blank lines counted), error and line of each bad line."""
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = self._kind("end").select("file", "block", F.coalesce(F.sum("place").over(before), F.lit(0)).alias("offset"))
        return self._kind("invalid").join(blocks, ["file", "block"]).select("file", (F.col("offset") + F.col("place") + 1).alias("number"), "error", "line")

    def count(self, kind: str) -> int:
        return self._kind(kind).count()
