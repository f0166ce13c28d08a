"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import counted, merged, scratch, stored
from corvane.sources import storage


def _links(found: DataFrame, below: str) -> tuple[DataFrame, int]:
    """Distinct links (a, b) with a < b, and whether there are any."""
    return counted(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), below=below)


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the lowest node of the component. `links` has the columns a and b; loops and repeats are harmless, and nodes without links to others are left out.

    Each round hangs every node on its lowest neighbour, follows those to their roots by doubling, and replaces the
    ends of the links by their roots. Links within a tree are gone then, so each round joins far fewer links, and
    there are at most as many rounds as doublings of the largest component. What a round finds goes to the shared folder, and is removed once the
    roots are written; all joins are by a
    single key with nothing above that needs their order, so Spark can split a node that holds many links.
    """
    spark = links.sparkSession
    below = scratch(spark, "rounds")
    links, left = _links(links, below)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    while left:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), below)
        moved = 1
        while moved:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hopped = merged(tree, above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            hopped, moved = counted(hopped, F.col("moved"), below)
            tree = hopped.select("node", "root")
        of_a, of_b = (tree.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        links, left = _links(merged(merged(links, of_a, "a"), of_b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), below)
        higher = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        known = merged(roots, higher, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = stored(known.unionByName(merged(tree, roots.select("node"), "node", "left_anti")), below)
    roots = stored(roots)
    storage.delete(spark, below)
    return roots
