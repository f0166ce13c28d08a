"""Even shards by histogram sort: count exact bytes below candidate boundaries, refine, exchange once.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours. Splitters are found by rounds:
each round counts exact bytes per bin of the key in one aggregation and narrows every splitter to one bin, 2**BITS
times finer, until a bin boundary is close enough to the splitter's target. Groups of equal texts larger than the
tolerance are cut inside, by the hash of the id; smaller ones stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import cut, others, utf8_size

#: Bytes counted for a row besides its text.
ROW_OVERHEAD = 16
#: Allowed distance of a boundary from its target, as a part of a shard's even size.
TOLERANCE = 0.01
#: Columns of the result besides the id.
RESULTS = ("size", "text_crc32", "law", "shard", "slot")
#: Key bits that a round adds.
BITS = 12


def _prefix(key: str, bits: int) -> Column:
    """The `bits` high bits of a signed 64-bit key, in key order."""
    return F.shiftright(F.col(key), 64 - bits) if bits < 64 else F.col(key)


def _refine(rows: DataFrame, group: Column, key: str, targets: dict[int, tuple[int, float, int]], slack: float) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]:
    """Place splitters inside groups of rows, by a 64-bit key. `targets`: {splitter: (group, bytes that belong below, bytes below the group)}.

    Returns the placed ones as {splitter: (group, lowest key above it)}, and those whose target lies inside the rows
    of a single key as {splitter: (that key, bytes below the key)}.
    """
    placed: dict[int, tuple[int, int]] = {}
    inside: dict[int, tuple[int, int]] = {}
    open_ = {i: (g, None, at) for i, (g, _, at) in targets.items()}
    bits = 0
    while open_:
        step = min(BITS, 64 - bits)
        if bits:
            wanted = [(group == g) & _prefix(key, bits).isin(sorted({p for h, p, _ in open_.values() if h == g})) for g in sorted({g for g, _, _ in open_.values()})]
        else:
            wanted = [group.isin(sorted({g for g, _, _ in open_.values()}))]
        any_of = wanted[0]
        for w in wanted[1:]:
            any_of = any_of | w
        counted = rows.where(any_of).groupBy(group.alias("g"), _prefix(key, bits + step).alias("bin"))
        counted = counted.agg(F.sum("size").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows")).collect()  # at most 2**BITS bins for a splitter
        bins: dict[tuple, list] = {}
        for r in sorted(counted, key=lambda r: r["bin"]):
            bins.setdefault((r["g"], r["bin"] >> step if bits else None), []).append(r)
        bits += step
        left = {}
        for i, (g, prefix, at) in open_.items():
            target = targets[i][1]
            for r in bins[g, prefix]:
                if at + r["n"] >= target or r is bins[g, prefix][-1]:
                    break
                at += r["n"]
            before, after = target - at, at + r["n"] - target
            alone = r["low"] == r["high"]
            if before <= min(slack, after) or alone and r["rows"] == 1 and before <= after:
                placed[i] = (g, r["low"])
            elif after <= slack or alone and r["rows"] == 1:
                placed[i] = (g, min(r["high"] + 1, (1 << 63) - 1))
            elif alone:
                inside[i] = (r["low"], at)
            else:
                left[i] = (g, r["bin"], at)
        open_ = left
    return placed, inside


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Give each row of `docs` a shard of near equal bytes: id, size, text_crc32, law, shard, slot.

    size is the text's UTF-8 bytes plus 16. Null text: size 16, crc of nothing (0). Rows of equal id and text are
    interchangeable and are never cut apart. Slots number the rows of a shard from 0 without gaps, in the order of the hashes. Null ids sort
    with a hash of their own. Other columns are not read. An empty table gives an empty one; more shards than rows leave some shards empty.
    """
    others([], RESULTS, (id_col,))
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), (utf8_size(text) + ROW_OVERHEAD).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    even = total / n_shards
    placed, inside = _refine(rows, F.lit(0), "k1", {i: (0, even * i, 0) for i in range(1, n_shards)}, tolerance * even) if total else ({}, {})
    splitters = [(k, -(1 << 63)) for _, k in placed.values()]
    if inside:
        cuts, tied = _refine(rows, F.col("k1"), "k2", {i: (v, even * i, at) for i, (v, at) in inside.items()}, tolerance * even)
        splitters += list(cuts.values()) + [(inside[i][0], k) for i, (k, _) in tied.items()]
    shard = F.lit(0)
    for a, b in sorted(splitters):
        shard = shard + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
    # One exchange: shards in the order of their rows, each over as many partitions as it fills; equal rows may be many, so a random number deals them out.
    order = ["shard", "k1", "k2", "tie"]
    dealt = rows.select("id", "size", "text_crc32", "k1", "k2", shard.alias("shard"), F.rand(9).alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = cut(dealt.select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")))
    # A run is a shard's rows in one partition; the rows before it are those of the shard's runs in earlier partitions.
    part = F.shiftright("at", 33).alias("part")
    counts = runs.groupBy(part, "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    found = runs.withColumn("part", part).join(offsets, ["part", "shard"])
    return found.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("offset")).alias("slot"))
