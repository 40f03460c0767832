"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**RING_BITS places. A shard owns ``vnodes`` points on it, found by hashing its
name. A key lies at the hash of its id and belongs to the first point at or after its place.
No shard takes more than its bound: keys beyond it continue clockwise to the next shard that
has room. With ``slack`` 0 the bounds add up to the number of rows, so that counts differ by
at most one; with a larger slack fewer keys leave their shard.

Rows are counted by place first. The counts by arc (the places of one point) are at most
``shards * vnodes`` rows, whatever the data, and on those the overflow is worked out. Every
other step is a DataFrame operation.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.llm.common import literal_table
from recollect.sources.tables import stage

RING_BITS = 16
VNODES = 128
PLACE_ROWS = 1_000_000  # rows numbered by one window group; fuller places are split by content


def ring_points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) in ring order. Points of a shard do not depend on how many others there are."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}-{v}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") >> (64 - RING_BITS), shard))
    return sorted(points)


def place(doc_id: Column) -> Column:
    """Place of a key on the ring; NULL is a key of its own."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.shiftrightunsigned(F.xxhash64(key), 64 - RING_BITS).cast("int")


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: exact shares for slack 0, else (1 + slack) of the mean."""
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def spread(arc_counts: list[int], owners: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, rows, shard, first slot) that place every row of every arc.

    A shard serves its own arcs first, each in proportion to its rows. The other rows of an
    arc go on clockwise, arcs in ring order.
    """
    home = [0] * len(caps)
    for n, s in zip(arc_counts, owners):
        home[s] += n
    free, filled = list(caps), [0] * len(caps)
    seen, kept_so_far = [0] * len(caps), [0] * len(caps)
    pieces, left = [], []
    for arc, (n, s) in enumerate(zip(arc_counts, owners)):
        seen[s] += n
        share = seen[s] if home[s] <= caps[s] else seen[s] * caps[s] // home[s]
        keep, kept_so_far[s] = share - kept_so_far[s], share
        if keep:
            pieces.append((arc, 0, keep, s, filled[s]))
            filled[s] += keep
            free[s] -= keep
        if n > keep:
            left.append((arc, keep, n - keep))
    for arc, first, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            s = owners[at]
            take = min(n, free[s])
            if take:
                pieces.append((arc, first, take, s, filled[s]))
                filled[s] += take
                free[s] -= take
                first, n = first + take, n - take
    return pieces


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: float = 0.0,
    vnodes: int = VNODES,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): one row for each row of ``docs``.

    size is UTF-8 bytes plus 1; a NULL text counts as empty. Rows that are equal in id, size
    and CRC are interchangeable: they are counted before any shuffle (up to PLACE_ROWS to a
    counted row) and numbered one after the other. NULL ids share one place on the ring. No
    rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = (
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.floor(F.monotonically_increasing_id() / PLACE_ROWS).alias("_salt"),
        )
        .groupBy("_id", "_size", "_crc", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .drop("_salt")
    )
    rows = stage(rows.withColumn("_place", place(F.col("_id"))), "ring-rows")

    points = ring_points(shards, vnodes)
    places = [p for p, _ in points]
    by_place = rows.groupBy("_place").agg(F.sum("_n").alias("_rows"))
    counts = [0] * len(points)
    for r in by_place.collect():  # at most 2**RING_BITS rows
        counts[bisect.bisect_left(places, r["_place"]) % len(points)] += r["_rows"]
    total = sum(counts)
    pieces = spread(counts, [s for _, s in points], bounds(total, shards, slack))

    # The arc of each place, as a literal of fixed size.
    arcs = [bisect.bisect_left(places, p) % len(points) for p in range(2**RING_BITS)]
    arc_of = literal_table(spark, json.dumps([{"a": arcs}]), "a: array<int>").select(
        F.posexplode("a").alias("_place", "_arc")
    )
    # Places are split where they hold many rows; the split depends on the content alone.
    target = max(PLACE_ROWS, total >> RING_BITS)
    parts = by_place.select("_place", F.ceil(F.col("_rows") / target).alias("_parts"))
    placed = (
        rows.join(F.broadcast(arc_of), "_place")
        .join(F.broadcast(parts), "_place")
        .withColumn("_sub", F.pmod(F.xxhash64("_id", "_size", "_crc"), F.col("_parts")))
        .drop("_parts")
    )
    before = Window.partitionBy("_arc").orderBy("_place", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("_arc", "_place", "_sub")
        .agg(F.sum("_n").alias("_rows"))
        .select("_place", "_sub", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    within = (
        Window.partitionBy("_place", "_sub")
        .orderBy(F.col("_id").asc_nulls_last(), "_size", "_crc")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = (
        placed.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(F.broadcast(bases), ["_place", "_sub"])  # at most two rows for each place
        .withColumn("_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("_rank", F.col("_rank") + F.col("_base") + F.col("_before"))
    )
    plan = literal_table(
        spark,
        json.dumps([dict(zip(("a", "f", "n", "s", "b"), p)) for p in pieces]),
        "a: int, f: bigint, n: bigint, s: int, b: bigint",
    )
    by_arc = plan.groupBy(F.col("a").alias("_arc")).agg(F.collect_list(F.struct("f", "n", "s", "b")).alias("_pieces"))
    mine = F.filter("_pieces", lambda p: (p.f <= F.col("_rank")) & (F.col("_rank") < p.f + p.n))[0]
    return (
        ranked.join(F.broadcast(by_arc), "_arc")
        .withColumn("_piece", mine)
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_piece.s").alias("shard"),
            (F.col("_piece.b") + F.col("_rank") - F.col("_piece.f")).alias("slot"),
        )
    )
