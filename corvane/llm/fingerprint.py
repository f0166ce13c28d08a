"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes decides where pieces end: at block size b = LEAST * 2**k where its low bits are all ones, so the ends at 2 b
are among those at b. A piece's bytes are hashed to SYMBOL characters, and the signature at b is the pieces' symbols in order. An edit changes the pieces it touches
and leaves the others. A fingerprint has the smallest block size at which there are at most PIECES pieces, with the signatures at that size and
at the next SCALES - 1, so that texts of somewhat different length still have a size in common. Likeness is one less the edit
distance (a replacement counts as a deletion and an insertion) over the symbols of both, at the smallest common size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import scratch, tidy

#: Bytes that the rolling hash sees.
WINDOW = 7
#: The smallest block size.
LEAST = 4
#: Pieces of the finest signature, at most.
PIECES = 128
#: Signatures of a fingerprint, each at twice the block size of the one before.
SCALES = 3
#: Characters for a piece.
SYMBOL = 2
#: Bytes that are hashed at once.
SLICE = 1 << 20
#: Rows that are judged at once.
ROWS = 500

_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_FULL = (1 << 64) - 1
_VALUES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
#: The rank of an end that holds at any block size.
_LAST = 64
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 14), base, np.uint64)
        have[0] = 1
        _tables[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _ends(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of the bytes after which a piece may end, of byte values that follow WINDOW - 1 others. At block size LEAST * 2**k those of rank k and more count."""
    two = v[:-1] * np.uint64(_BASE) + v[1:]
    four = two[:-2] * np.uint64(_BASE**2 & _FULL) + two[2:]
    seen = (four[:-3] * np.uint64(_BASE) + v[4:-2]) * np.uint64(_BASE**2 & _FULL) + two[5:]
    seen = (seen ^ (seen >> np.uint64(32))) >> np.uint64(3)
    at = np.flatnonzero((seen & np.uint64(LEAST - 1)) == LEAST - 1)
    more = seen[at] // np.uint64(LEAST)
    return at, np.log2((~more & (more + np.uint64(1))).astype(np.float64)).astype(np.int64)  # how many ones stand at the end


def _symbols(h: np.ndarray) -> np.ndarray:
    """The letters of each piece's hash, a row each."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(31))
    return np.stack([_LETTERS[(h >> np.uint64(6 * s)) & np.uint64(63)] for s in range(SYMBOL)], axis=1)


def _of_many(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts that are hashed together; none is empty."""
    sizes = np.array([len(t) for t in texts])
    gap = WINDOW - 1  # values of nothing before each text
    start = np.cumsum(sizes + gap) - sizes
    v = np.zeros(start[-1] + sizes[-1], np.uint64)
    v[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = _VALUES[np.frombuffer(b"".join(texts), np.uint8)]
    at, rank = _ends(v)
    at += gap
    doc = np.searchsorted(start, at, "right") - 1
    inside = at < (start + sizes)[doc] - 1  # the last byte ends a piece anyway, and the gaps are no text
    at, rank, doc = np.concatenate([at[inside], start + sizes - 1]), np.concatenate([rank[inside], np.full(len(texts), _LAST)]), np.concatenate([doc[inside], np.arange(len(texts))])
    order = np.argsort(at, kind="stable")
    at, rank, doc = at[order], np.minimum(rank[order], _LAST), doc[order]
    total = np.concatenate([[np.uint64(0)], np.cumsum(v * _powers(_BASE, len(v)))])
    left = np.bincount(doc * (_LAST + 1) + rank, minlength=len(texts) * (_LAST + 1)).reshape(len(texts), -1)[:, ::-1].cumsum(axis=1)[:, ::-1]
    k = np.argmax(left <= PIECES, axis=1)
    parts = [[str(LEAST << int(x)) for x in k]]
    for j in range(SCALES):
        used = rank >= (k + j)[doc]
        end, whose = at[used] + 1, doc[used]
        begin = np.concatenate([[0], end[:-1]])
        fresh = np.concatenate([[True], whose[1:] != whose[:-1]])
        begin[fresh] = start[whose[fresh]]
        letters = _symbols((total[end] - total[begin]) * _powers(_BACK, len(v) + 1)[begin] + (end - begin).astype(np.uint64)).tobytes().decode()
        cut = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(texts)))]) * SYMBOL
        parts.append([letters[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
    return [":".join(p) for p in zip(*parts, strict=True)]


def _of_long(text: bytes) -> str:
    """The fingerprint of a text of any length, hashed SLICE bytes at a time."""
    data, ends, ranks, sums, total, power = np.frombuffer(text, np.uint8), [], [], [], 0, 1
    for a in range(0, len(data), SLICE):
        v, n = np.zeros(WINDOW - 1 + min(SLICE, len(data) - a), np.uint64), min(SLICE, len(data) - a)
        own = data[max(a - WINDOW + 1, 0) : a + n]
        v[len(v) - len(own) :] = _VALUES[own]
        at, rank = _ends(v)
        sofar = np.cumsum(v[WINDOW - 1 :] * _powers(_BASE, n)) * np.uint64(power) + np.uint64(total)
        ends.append(at + a + 1)
        ranks.append(rank)
        sums.append(sofar[at])
        total, power = int(sofar[-1]), power * pow(_BASE, n, 1 << 64) & _FULL
    inside = np.concatenate(ends) < len(data)
    end, rank, total = np.append(np.concatenate(ends)[inside], len(data)), np.append(np.minimum(np.concatenate(ranks)[inside], _LAST), _LAST), np.append(np.concatenate(sums)[inside], np.uint64(total))
    k = int(np.argmax(np.bincount(rank, minlength=_LAST + 1)[::-1].cumsum()[::-1] <= PIECES))
    parts = [str(LEAST << k)]
    for j in range(SCALES):
        e, s = end[rank >= k + j], total[rank >= k + j]
        begin = np.concatenate([[0], e[:-1]])
        back = np.array([pow(_BACK, int(b), 1 << 64) for b in begin], np.uint64)
        parts.append(_symbols((s - np.concatenate([[np.uint64(0)], s[:-1]])) * back + (e - begin).astype(np.uint64)).tobytes().decode())
    return ":".join(parts)


def fingerprint_all(texts: list[bytes]) -> list[str]:
    """The fingerprints of texts' bytes: block size and signatures, with colons between. Equal bytes have equal fingerprints; no bytes have empty signatures."""
    out, some, size = [f"{LEAST}" + ":" * SCALES] * len(texts), [], 0

    def flush() -> None:
        for i, found in zip(some, _of_many([texts[i] for i in some]) if some else [], strict=True):
            out[i] = found
        some.clear()

    for i, t in enumerate(texts):
        if len(t) > SLICE:
            out[i] = _of_long(t)
        elif t:
            if size + len(t) > SLICE:
                flush()
                size = 0
            some.append(i)
            size += len(t)
    flush()
    return out


def _common(a: str, b: str) -> int:
    """The symbols of a longest common subsequence, by bits of whole rows."""
    a, b = ([s[i : i + SYMBOL] for i in range(0, len(s), SYMBOL)] for s in (a, b))
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = where.get(y, 0)
        if hit:
            both = row & hit
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def likeness(one: str | None, other: str | None) -> float | None:
    """How alike two texts are by their fingerprints, 0 to 1: 1 for equal ones, 0 where they share no block size; null for a null."""
    if one is None or other is None:
        return None
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    if int(a[0]) > int(b[0]):
        a, b = b, a
    apart = (int(b[0]) // int(a[0])).bit_length() - 1
    if apart >= SCALES:
        return 0.0
    x, y = a[1 + apart], b[1]
    return 2 * SYMBOL * _common(x, y) / (len(x) + len(y)) if x and y else 0.0


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each text; a null text counts as empty. All other columns and all rows stay; `out_col` must be a new name."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out_col} already")

    @F.arrow_udf("string")
    def own(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(fingerprint_all([(t or "").encode() for t in column.to_pylist()]), pa.string())

    return docs.withColumn(out_col, own(F.col(text_col)))


def alike(one: Column, other: Column) -> Column:
    """`likeness` of two columns of fingerprints."""

    @F.arrow_udf("double")
    def compare(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in columns:
            yield pa.array([likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return compare(one, other)


def edited(text: str, following: str) -> str:
    """`text` with its last half (in code points, rounded down) replaced by as many of the first of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How far fingerprints see an edit: for each row of `docs`, in the order of its id, against the row that follows (after the last the first).

    Columns: id, n_chars (code points), edited_text's UTF-8 SHA-256 as edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness of the
    text and its edited form), near_next (of the text and the following one). The edited form has the last half replaced by the beginning of the following text. Null texts
    count as empty. Ids ascend with null first; rows of one id follow by a hash of their texts, equal rows in any order. A lone row follows itself. An empty table gives an empty one.

    Rows are range-sorted by id, so a row and the next stand in one partition; only a partition's last row and the first of the next partition
    are written out with their texts, to meet by a join.
    """
    spark = docs.sparkSession
    fields = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    if id_col.lower() in {n for n, _ in fields}:
        raise ValueError(f"the id column must not be named {id_col}")
    order = ["id", "h", "tie"]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id may be many, so their texts and a random number deal them out.
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.rand(12).alias("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields], T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])
    names = [n for n, _ in fields]

    def judged(texts: list[str], marks: list[str], following: list[str], next_marks: list[str]) -> list[tuple]:
        changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
        return [
            (len(t), hashlib.sha256(c).hexdigest(), m, other, likeness(m, other), likeness(m, n))
            for t, c, m, other, n in zip(texts, changed, marks, fingerprint_all(changed), next_marks, strict=True)
        ]

    def table(ids: pa.Array, facts: list[tuple], kind: str | None, part: int, texts: list) -> pa.RecordBatch:
        columns = zip(*facts, strict=True)
        facts = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *facts, pa.array([kind] * len(ids), pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            marks = fingerprint_all([t.encode() for t in texts])
            ids = batch.column(0)
            if held is None:
                yield table(ids.slice(0, 1), [(None,) * len(names)], "first", part, texts[:1])
            else:
                ids, texts, marks = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *marks]
            if len(texts) > 1:
                yield table(ids.slice(0, len(texts) - 1), judged(texts[:-1], marks[:-1], texts[1:], marks[1:]), None, part, [None] * (len(texts) - 1))
            held = (ids.slice(len(texts) - 1), texts[-1], marks[-1])
        if held is not None:
            yield table(held[0], [(len(held[1]), None, held[2], None, None, None)], "last", part, [held[1]])

    folder = scratch(spark, "fingerprints")
    rows.select("id", "text").mapInArrow(tidy(run), schema).write.option("compression", "zstd").parquet(folder)  # signatures are letters of six bits each
    found = spark.read.schema(schema).parquet(folder)
    own = [id_col, *names]
    # The partitions that have rows, in order, and round to the first again; their number is all that the driver sees.
    full = sorted(r["part"] for r in found.where(F.col("kind") == "first").select("part").collect())
    follows = spark.createDataFrame(list(zip(full, full[1:] + full[:1], strict=True)), "part int, next int")
    ends = found.where(F.col("kind") == "last").select("id", "part", "n_chars", "fingerprint", "text").join(follows, "part")
    starts = found.where(F.col("kind") == "first").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            ids, _, mark, text, following = batch.columns
            after = following.to_pylist()
            facts = judged(text.to_pylist(), mark.to_pylist(), after, fingerprint_all([f.encode() for f in after]))
            yield pa.RecordBatch.from_arrays(table(ids, facts, None, 0, [None]).columns[: len(own)], names=schema.names[: len(own)])

    closed = ends.join(starts, "next").select("id", "n_chars", "fingerprint", "text", "following").mapInArrow(tidy(close), T.StructType(schema.fields[: len(own)]))
    return found.where(F.col("kind").isNull()).select("id", *names).unionByName(closed).withColumnRenamed("id", id_col)
