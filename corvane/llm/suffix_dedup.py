"""Removal of byte strings of a given length that occur more than once, by merged Burrows-Wheeler transforms.

Every window of LENGTH bytes belongs to the lowest hash among its K-byte strings, so equal windows belong to the same
hash wherever they stand. A maximal run of windows with their lowest hash in one place is a piece; equal pieces are counted before
anything is shuffled by content, and pieces of one hash that differ go to the same bucket. A hash with too many bytes of
them would outgrow its bucket, so its pieces are strings to be cut up anew, by the lowest hashes of longer strings, until whole windows are hashed. A bucket splits its
pieces into shards, sorts each shard's rotations, and merges the shards' Burrows-Wheeler transforms by iterative interleave
refinement: every round orders the interleave by Q more symbols, and marks where common prefixes end. After LENGTH symbols,
the intervals between marks are the distinct windows; those with more than one occurrence are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.shared import cut

LENGTH = 200
#: Bytes whose hash chooses a window's bucket.
K = 32
#: Bytes of pieces in a bucket, on average, and shards in each. Of few enough symbols, numpy sorts a round in one pass.
BUCKET_BYTES = 1 << 16
SHARDS = 4
#: Bytes of the different pieces of one hash from which they are cut up anew.
HOT_BYTES = 1 << 18

_HIGH = np.uint64((1 << 64) - (1 << 22))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowest hash, document, first window, last window + 1) of the pieces of a slice's documents, of less than 4 MB together."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    starts = np.arange(len(data) - k + 1)
    hashes = W.span_hashes(data, starts, starts + k)
    # High bits of the hash and the place: of equal strings in a window, the first counts.
    low = (hashes & _HIGH) | starts.astype(np.uint64)
    width, have = length - k + 1, 1
    while have < width:  # minima of windows that double in width
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    doc = np.searchsorted(offsets, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= offsets[doc + 1]
    fresh = np.ones(n, bool)
    fresh[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh & inside)
    ends = np.flatnonzero(np.r_[fresh[1:] | ~inside[1:], True] & inside) + 1
    return hashes[(low[first] & ~_HIGH).astype(np.int64)], doc[first], first, ends


def _packed(text: np.ndarray, bits: int, q: int, jump) -> np.ndarray:
    """The q symbols from each place on as one number."""
    out = text.astype(np.int64)
    for j in range(1, q):
        out = (out << bits) | text[jump(j)]
    return out


def _sorted_rotations(rank: np.ndarray, have: int, depth: int, jump) -> np.ndarray:
    """Places ordered by their first `depth` symbols, given ranks by the first `have`; jump(d): the place d symbols on. Ties in any order."""
    while True:
        order = np.argsort(rank)
        if have >= depth:
            return order
        own = rank[order]
        dense = np.empty(len(rank), np.int64)
        dense[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        rank = dense * (dense[order[-1]] + 1) + dense[jump(have)]
        have *= 2


def _stable_order(symbol: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit symbols, by two passes over 16 bits, which numpy sorts by radix."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    high = (symbol >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def repeated_windows(strings: list[bytes], weights: np.ndarray, length: int, shards: int = SHARDS) -> np.ndarray:
    """For each place of the joined strings, whether `length` bytes of its string start there that occur more than once; a string counts `weights` times.

    Strings are circular, each with an end symbol: that only orders the transforms, as a window with an end symbol never counts.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = int(begin[-1])
    body = np.ones(n, bool)
    body[begin[1:] - 1] = False
    raw = np.frombuffer(b"".join(strings), np.uint8)
    dense = np.cumsum(np.bincount(raw, minlength=256) > 0)
    text = np.zeros(n, np.int64)
    text[body] = dense[raw]
    bits = int(dense[-1]).bit_length()
    q = next(q for q in range(62 // bits, 0, -1) if length % q == 0)
    of = np.repeat(np.arange(len(strings)), sizes)
    own_begin, own_size = begin[of], sizes[of]
    inside = np.arange(n) - own_begin
    jump = lambda d, a=0, b=n: own_begin[a:b] - a + (inside[a:b] + d) % own_size[a:b]
    following = _packed(text, bits, q, jump)
    # Each shard's rotations in order.
    edges = np.unique(begin[np.searchsorted(begin, np.linspace(0, n, shards + 1))])
    orders = [a + _sorted_rotations(following[a:b], q, length, lambda d, a=a, b=b: jump(d, a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # Its transform: for each rotation the q symbols before it, as their rank in the bucket.
    _, symbol = np.unique(following[jump(-q)], return_inverse=True)
    symbol = symbol.astype(np.uint32)
    joined = np.concatenate([symbol[o] for o in orders])
    shard = np.repeat(np.arange(len(orders), dtype=np.uint8), np.diff(edges))
    block = np.zeros(n, np.int32)  # number of the interval of equal prefixes
    column = np.empty(n, np.uint32)
    for _ in range(length // q):
        # A row of the interleave takes its shard's next symbol; the symbols' stable order is the interleave q symbols deeper.
        column[np.argsort(shard, kind="stable")] = joined
        step = _stable_order(column)
        shard, block, own = shard[step], block[step], column[step]
        block = np.concatenate([[0], np.cumsum((own[1:] != own[:-1]) | (block[1:] != block[:-1]), dtype=np.int32)])
    merged = np.empty(n, np.int64)
    merged[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    whole = (inside + length < own_size)[merged]
    count = np.bincount(block, weights[of[merged]] * whole)
    repeated = np.zeros(n, bool)
    repeated[merged] = whole & (count[block] > 1)
    return repeated[body]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _cut_up(strings: DataFrame, length: int, k: int, whole: bool = True) -> DataFrame:
    """(h, n, s, t, a, b) of every piece of `strings` (t, n, data): its lowest hash, its string's n, a hash of its bytes, its string, first window, last window + 1. Only h and n unless `whole`."""
    step = 1 << 21
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
    if whole:
        schema = T.StructType([*schema, T.StructField("s", T.LongType()), T.StructField("t", strings.schema["t"].dataType), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for row, _, data, offsets in W.slices(batch.column(2)):
                for base in range(0, max(1, len(data) - length + 1), step):  # a long text in parts; no window is lost
                    part = data[base : base + step + length - 1]
                    low, doc, first, ends = pieces(part, offsets if len(part) == len(data) else np.array([0, len(part)]), length, k)
                    of = pa.array(doc + row, pa.int64())
                    columns = [pa.array(low.view(np.int64)), batch.column(1).take(of)]
                    if whole:
                        raw = part.tobytes()
                        s = np.array([xxhash.xxh3_64_intdigest(raw[i : j + length - 1]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)], np.uint64)
                        at = base - offsets[doc]
                        columns += [pa.array(s.view(np.int64)), batch.column(0).take(of), pa.array((first + at).astype(np.int32)), pa.array((ends + at).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return strings.select("t", "n", "data").mapInArrow(run, schema)


def _strings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, s, n, data) of the `wanted` pieces (h, s, n, t, a, b)."""

    def run(batches):
        last = None
        for batch in batches:
            for t, data, own in zip(*(batch.column(c) for c in ("t", "data", "own")), strict=True):
                if t == last:  # copies of a text stand together after the join; one has all its strings
                    continue
                last, raw, own = t, data.as_py(), own.as_py()
                columns = [[x[c] for x in own] for c in ("h", "s", "n")]
                found = [pa.array(c, pa.int64()) for c in columns] + [pa.array([raw[x["a"] : x["b"] - 1 + length] for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(found, names=["h", "s", "n", "data"])

    own = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "s", "n", "a", "b")).alias("own"))  # at most a text's own pieces
    return texts.join(own, "t").select("t", "data", "own").mapInArrow(run, "h long, s long, n long, data binary")


def _merge_transforms(strings: DataFrame, buckets: int, length: int) -> DataFrame:
    """(h, s, runs) of each distinct piece; runs: the ranges of its windows that are repeated."""

    def run(table: pa.Table) -> pa.Table:
        first = {}
        for i, key in enumerate(zip(table["h"].to_pylist(), table["s"].to_pylist(), strict=True)):
            first.setdefault(key, i)
        table = table.take(pa.array(list(first.values()), pa.int64()))
        data = table["data"].to_pylist()
        repeated = repeated_windows(data, np.asarray(table["n"], np.float64), length)
        runs, at = [], 0
        for d in data:
            runs.append([{"x": int(x), "y": int(y)} for x, y in zip(*_runs(repeated[at : at + len(d)]), strict=True)])
            at += len(d)
        return pa.table({"h": table["h"], "s": table["s"], "runs": pa.array(runs, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))})

    return strings.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).applyInArrow(run, "h long, s long, runs array<struct<x:int,y:int>>")


def repeated_windows_of(strings: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(t, runs) of the strings (t, n, data) with repeated windows; runs: sorted ranges of places where such windows start. Strings of equal t are copies; each counts n times."""
    shared = cut(_cut_up(strings, length, k, whole=False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))  # a table of its own, so Spark can split a hash that many pieces have
    found = cut(_cut_up(strings, length, k).join(shared, "h"))
    distinct = found.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("t", "a", "b")).alias("rep"))
    size = (F.col("rep.b") - F.col("rep.a") + length - 1).cast("long")
    kinds = distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(size).alias("bytes"))
    distinct = cut(distinct.join(kinds, "h").select("h", "s", "n", "rep.*", "kinds", "bytes"))
    is_hot = (F.col("bytes") > HOT_BYTES) & F.lit(k < length)
    mixed = distinct.where("kinds > 1")
    own = F.col("b") - F.col("a") + length - 1
    size, hot_size = mixed.agg(F.sum(F.when(~is_hot, own)), F.sum(F.when(is_hot, own))).first()
    judged = _merge_transforms(_strings(strings, mixed.where(~is_hot).drop("kinds", "bytes"), length), -(-(size or 0) // BUCKET_BYTES) + 1, length)
    if hot_size:
        hot = _strings(strings, mixed.where(is_hot).drop("kinds", "bytes"), length)
        deeper = repeated_windows_of(cut(hot.select(F.struct("h", "s").alias("t"), "n", "data").dropDuplicates(["t"])), length, length - (length - k) // 4)
        judged = judged.unionByName(deeper.select("t.h", "t.s", "runs"))
    # A hash of one piece alone has all its occurrences equal; it is here because it has several, or one that counts several times.
    alone = distinct.where("kinds = 1").select("h", "s", F.array(F.struct(F.lit(0).alias("x"), (F.col("b") - F.col("a")).alias("y"))).alias("runs"))
    runs = judged.where(F.size("runs") > 0).unionByName(alone)
    placed = found.join(runs, ["h", "s"]).select("t", F.explode("runs").alias("r"), "a").select("t", F.struct((F.col("a") + F.col("r.x")).alias("x"), (F.col("a") + F.col("r.y")).alias("y")).alias("r"))
    return placed.groupBy("t").agg(F.array_sort(F.collect_set("r")).alias("runs"))  # copies give the same runs


def repeated_spans(texts: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(t, spans) of the texts (t, data) with repeated bytes: sorted ranges of bytes, which may overlap. Equal t must mean equal data; copies are rows of their own."""
    runs = repeated_windows_of(texts.select("t", F.lit(1).cast("long").alias("n"), "data"), length, min(k, length))
    return runs.select("t", F.transform("runs", lambda r: F.struct(r["x"].alias("from"), (r["y"] + (length - 1)).alias("to"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """The id column, n_bytes, n_removed, n_spans (long), spans (array of from, to) and kept (binary), one row for each row of `docs`.

    A byte of a text's UTF-8 form goes if a string of `length` bytes that covers it also starts elsewhere in any
    document, the same included. Matches never cross documents. Null text is empty. Repeated and null ids are
    documents of their own, other columns are not read, an empty table gives an empty one.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.unhex(F.md5(data)).alias("t"), F.col(id_col).alias("id"), data.alias("data"))
    joined = rows.join(repeated_spans(rows.select("t", "data"), length, k), "t", "left").select("id", "data", "spans")
    span = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            out = {c: [] for c in schema.names[1:]}
            for data, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans, merged = data.as_py(), spans.as_py() or [], []
                for s in spans:
                    if merged and s["from"] <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], s["to"])
                    else:
                        merged.append(dict(s))
                gone = sum(s["to"] - s["from"] for s in merged)
                edges = [0, *[x for s in merged for x in (s["from"], s["to"])], len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                for c, v in zip(out, (len(raw), gone, len(merged), merged, kept), strict=True):
                    out[c].append(v)
            columns = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
            columns += [pa.array(out["spans"], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(out["kept"], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
