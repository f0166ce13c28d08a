"""A Merkle manifest: one digest for a whole data set, and for each row the proof that it is part of it.

Rows are range-sorted by group and order, so a partition holds a stretch of each of its groups; counts for each partition and group
give the place of its first row in the group. A partition builds every subtree that is complete within its stretch. What is left are the ragged
nodes at a stretch's ends, at most twice FAN_OUT - 1 a level: they go by their coordinate (group, level, run) to meet the others of their run,
level by level. The groups' roots are the leaves of one more tree of the same make. At last each partition gets the runs above
its own nodes and writes out the proofs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import cut, merged, stored

FAN_OUT = 8
#: Leaves that a partition of the sorted table holds, about.
ROWS = 500_000
#: Rows of proofs that go out at once.
BATCH = 2_000

PROOF = "array<struct<place:int,siblings:string>>"


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: each field as `-` if null, else its UTF-8 byte count, a colon and its value as text."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and a proof."""
    step = lambda have, p: F.sha2(F.concat(F.substring(p["siblings"], F.lit(1), p["place"] * 64), have, F.substring(p["siblings"], p["place"] * 64 + 1, F.length(p["siblings"]))), 256)
    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["siblings"]), ""), 256)


def _stretch(nodes: list[str], first: int, total: int) -> Iterator[tuple[int, int, int, list[str], int, int]]:
    """(level, nodes of the group there, place of the first own node, own nodes, from which and to which place runs are complete here), level by level."""
    level = 0
    while nodes:
        end = first + len(nodes)
        low = -(-first // FAN_OUT) * FAN_OUT
        high = end if end == total else end // FAN_OUT * FAN_OUT
        if low >= high:
            low = high = end
        yield level, total, first, nodes, low, high
        if total == 1:
            return
        nodes = [hashlib.sha256("".join(nodes[k - first : min(k + FAN_OUT, high) - first]).encode()).hexdigest() for k in range(low, high, FAN_OUT)]
        level, first, total = level + 1, low // FAN_OUT, -(-total // FAN_OUT)


def _groups(keys: list) -> list[tuple[int, int]]:
    """(first, end) of each stretch of equal neighbours."""
    if not keys:
        return []
    at = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return list(zip(at[:-1], at[1:], strict=True))


def _ranged(leaves: DataFrame, rows: int) -> DataFrame:
    """`leaves` (g, o, k, leaf) in order over partitions of bounded size, with `at`: the partition's number times 2**33, plus the place in it."""
    n = -(-rows // ROWS)
    if n > 1 or rows > BATCH:
        n = max(n, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["g", F.asc_nulls_first("o"), "leaf", "tie"]
    # Equal rows may be many and are interchangeable, so a random number deals them out.
    ranged = leaves.withColumn("tie", F.rand(11)).repartitionByRange(max(n, 1), *order).sortWithinPartitions(*order)
    return cut(ranged.select("g", "o", "k", F.unhex("leaf").alias("leaf"), F.monotonically_increasing_id().alias("at")))


def _counts(ranged: DataFrame) -> DataFrame:
    """part, g, n, offset, total: a partition's rows of each group, those in partitions before it, and those of all."""
    counts = ranged.groupBy(F.shiftright("at", 33).alias("part"), "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("g")).alias("total")))


def _up(ranged: DataFrame, wide: dict) -> DataFrame:
    """g, total, level, at, digest of the nodes that no partition could take further: those that lack others of their run, and finished roots (total 1)."""
    sent = ranged.sparkSession.sparkContext.broadcast(wide)  # at most two groups of each partition
    schema = T.StructType.fromDDL("g string, total long, level int, at long, digest string")

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, key = None, [], None

        def finish() -> list[tuple]:
            offset, total = sent.value.get((part, key), (0, len(held)))
            out = []
            for level, n, first, nodes, low, high in _stretch(held, offset, total):
                loose = range(first, first + len(nodes)) if n == 1 else [*range(first, low), *range(high, first + len(nodes))]
                out += [(key, n, level, i, nodes[i - first]) for i in loose]
            return out

        out = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, digests = batch.column(0).to_pylist(), [d.hex() for d in batch.column(1).to_pylist()]
            part = batch.column(2)[0].as_py() >> 33
            for a, b in _groups(keys):
                if key is not None and keys[a] != key:
                    out += finish()
                    held = []
                key = keys[a]
                held += digests[a:b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=schema.names).cast(to_arrow_schema(schema))
                out = []
        if key is not None:
            out = finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=schema.names).cast(to_arrow_schema(schema))

    from pyspark.sql.pandas.types import to_arrow_schema

    return stored(ranged.select("g", "leaf", "at").mapInArrow(rise, schema))


def _finish(nodes: DataFrame, widest: int) -> tuple[DataFrame, DataFrame | None]:
    """(g, root of each group; g, level, run, children of the runs that were ragged). `widest`: rows of the largest group that lies in several partitions."""
    roots, runs, made, level = nodes.where("total = 1").select("g", "digest"), None, None, 0
    while widest > 1:
        here = nodes.where((F.col("level") == level) & (F.col("total") > 1)).select("g", "total", "at", "digest")
        if made is not None:
            here = here.unionByName(made.where("total > 1"))
        met = here.groupBy("g", "total", F.expr(f"at div {FAN_OUT}").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda c: c["digest"]).alias("children"))
        met = stored(met.select("g", "total", "run", "children", F.sha2(F.array_join("children", ""), 256).alias("digest")))
        made = met.select("g", F.expr(f"(total + {FAN_OUT - 1}) div {FAN_OUT}").alias("total"), F.col("run").alias("at"), "digest")
        roots = roots.unionByName(made.where("total = 1").select("g", "digest"))
        own = met.select("g", F.lit(level).alias("level"), "run", "children")
        runs = own if runs is None else runs.unionByName(own)
        level, widest = level + 1, -(-widest // FAN_OUT)
    return roots, runs


def _down(ranged: DataFrame, counts: DataFrame, runs: DataFrame | None, above: DataFrame | None, levels: int) -> DataFrame:
    """g, o, k, leaf, root, top and proof of each leaf. `above` (g, top, path): the whole's root and each group's proof."""
    context = counts if above is None else merged(counts, above, "g")
    if above is None:
        context = context.select("*", F.lit(None).cast("string").alias("top"), F.lit(None).cast(PROOF).alias("path"))
    leaf_part = F.shiftright("at", 33)
    rows = ranged.select(leaf_part.alias("part"), F.lit(2).alias("kind"), "g", "at", "leaf", F.struct("o", "k").alias("own"))
    both = rows.unionByName(context.select("part", F.lit(0).alias("kind"), "g", F.col("offset").alias("at"), "total", "top", "path"), allowMissingColumns=True)
    if runs is not None:
        steps = F.array(*[F.struct(F.lit(i).alias("level"), F.expr(f"offset div {FAN_OUT ** (i + 1)}").alias("low"), F.expr(f"(offset + n - 1) div {FAN_OUT ** (i + 1)}").alias("high")) for i in range(levels)])
        wanted = counts.where("n < total").select("part", "g", F.explode(steps).alias("s"))
        wanted = wanted.select("part", "g", "s.level", F.explode(F.array_distinct(F.array("s.low", "s.high"))).alias("run"))
        both = both.unionByName(merged(wanted, runs, ["g", "level", "run"]).select("part", F.lit(1).alias("kind"), "g", F.col("run").alias("at"), "level", "children"), allowMissingColumns=True)
    both = both.select("part", "kind", "g", "at", "leaf", "own", "total", "top", "path", "level", "children") if runs is not None else both.select("part", "kind", "g", "at", "leaf", "own", "total", "top", "path")
    both = both.repartition("part").sortWithinPartitions("part", "kind", "at")
    own = T.StructType([T.StructField("o", ranged.schema["o"].dataType), T.StructField("k", ranged.schema["k"].dataType)])
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("own", own), T.StructField("leaf", T.StringType()), T.StructField("root", T.StringType()), T.StructField("top", T.StringType()), T.StructField("proof", T._parse_datatype_string(PROOF))])

    def proofs(group: dict, met: dict, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The proofs of one group's stretch."""
        levels = [(first, nodes) for _, _, first, nodes, _, _ in _stretch([d.hex() for d in rows.column("leaf").to_pylist()], group["at"], group["total"])]
        total, n_levels = group["total"], 0
        totals = [total]
        while totals[-1] > 1:
            totals.append(-(-totals[-1] // FAN_OUT))
            n_levels += 1
        known: dict[tuple[int, int], list] = {}

        def children(level: int, run: int) -> list[str]:
            if (level, run) in met:
                return met[level, run]
            first, nodes = levels[level]
            return nodes[run * FAN_OUT - first : (run + 1) * FAN_OUT - first]

        tail = [(p["place"], p["siblings"]) for p in group["path"] or []]

        def path(level: int, at: int) -> list:
            """The proof of a node, from itself up; those of inner nodes are shared by all below."""
            if level == n_levels:
                return tail
            if (level, at) in known:
                return known[level, at]
            run, place = divmod(at, FAN_OUT)
            others = children(level, run)
            found = [(place, "".join(others[:place] + others[place + 1 :])), *path(level + 1, run)]
            if level:
                known[level, at] = found
            return found

        root = levels[-1][1][0] if n_levels == 0 else None
        if n_levels:
            last = children(n_levels - 1, 0)
            root = hashlib.sha256("".join(last).encode()).hexdigest()
        top = group["top"] or root
        for a in range(0, rows.num_rows, BATCH):
            some = rows.slice(a, BATCH).combine_chunks()
            found = [path(0, group["at"] + i) for i in range(a, a + some.num_rows)]
            flat = [p for f in found for p in f]
            steps = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.string())], ["place", "siblings"])
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            column = lambda name, some=some: some.column(name).combine_chunks()
            leaf = pa.array([d.hex() for d in some.column("leaf").to_pylist()], pa.string())
            same = lambda v, some=some: pa.array([v] * some.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([column("g"), column("own"), leaf, same(root), same(top), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)], names=schema.names)

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups, met, held = None, {}, {}, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                yield from proofs(groups[key], met.get(key, {}), rows)
                held.clear()

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, kinds, keys = (batch.column(i).to_pylist() for i in range(3))
            for a, b in _groups(list(zip(parts, kinds, keys, strict=True))):
                if parts[a] != part:
                    yield from flush()
                    part, groups, met, key = parts[a], {}, {}, None
                some = batch.slice(a, b - a)
                if kinds[a] == 2:
                    if keys[a] != key:
                        yield from flush()
                        key = keys[a]
                    held.append(some.select(["g", "own", "leaf"]))
                    continue
                for r in some.select([c for c in batch.schema.names if c not in ("own", "leaf")]).to_pylist():
                    if r["kind"] == 0:
                        groups[r["g"]] = r
                    else:
                        met.setdefault(r["g"], {})[r["level"], r["at"]] = r["children"]
        yield from flush()

    return both.mapInArrow(fall, schema)


def _tree(leaves: DataFrame, rows: int):
    """(roots: g, digest; a function that gives the proofs once what lies above the groups is known)."""
    ranged = _ranged(leaves, rows)
    counts = _counts(ranged)
    wide = {(r["part"], r["g"]): (r["offset"], r["total"]) for r in counts.where("n < total").collect()}  # at most two for each partition
    widest = max((total for _, total in wide.values()), default=1)
    roots, runs = _finish(_up(ranged, wide), widest)
    levels = math.ceil(math.log(widest, FAN_OUT)) + 1
    return roots, lambda above: _down(ranged, counts, runs, above, levels)


def manifest(docs: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """The leaf, subroot, root and proof of each row of `docs`: `order`, `group`, the columns of `keep`, leaf, subroot, root, proof.

    `leaf` is the hex digest of a row (see `leaf_of`). Within a group (its value as text) leaves ascend by `order`, null first, then by digest; while a level has several
    nodes, each FAN_OUT consecutive ones (the last run may be shorter) become the SHA-256 of their hex digests. What remains is the group's
    subroot, a lone leaf itself; subroots, ordered by the group's UTF-8 bytes with null first, make the root likewise. A proof lists, from the
    leaf up, the place in the run and the other nodes of the run, concatenated. Rows that are equal in order and digest are leaves of their own, next to each other; their proofs differ.
    Nulls, empty and very long texts are values like others. An empty table gives an empty one. A result column must not be named like another.
    """
    names = [order, group, *keep, "leaf", "subroot", "root", "proof"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns of one name in {names}")
    # The group as a text that is never null and has null first in its order.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = F.struct(F.col(group).alias("group"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    leaves = docs.select(key.alias("g"), F.col(order).alias("o"), kept.alias("k"), leaf.alias("leaf"))
    roots, proofs = _tree(leaves, docs.count())
    roots = stored(roots)
    tops = roots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.struct(F.lit(1).alias("group")).alias("k"), F.col("digest").alias("leaf"))
    _, top_proofs = _tree(tops, roots.count())
    above = stored(top_proofs(None).select(F.col("own.o").alias("g"), "top", F.col("proof").alias("path")))
    found = proofs(above)
    own = [F.col(f"own.k.k{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(F.col("own.o").alias(order), F.col("own.k.group").alias(group), *own, "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), "proof")
