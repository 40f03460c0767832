"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recollect.sources.tables import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: LONG); root is the smallest node connected to it.

    Each round points every node and its neighbours at the smallest node near by and is written
    out. The number of rounds grows with the logarithm of the longest path. Smallest
    neighbours are found by aggregates, which combine before the shuffle, and brought back by
    joins, which can be split at nodes of many edges. No edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage(pairs.filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.filter("u <> v"), "large-star")
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stage(small, "small-star")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums over them: equal when the edges are."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first()
    return tuple(row)
