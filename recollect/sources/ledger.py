"""Ids that batches of a stream have taken, kept so that a batch reads only the slots of its own ids (IN5).

Batch ``number`` writes one run of ids. Runs are joined as digits carry in base FAN: the run that batch n writes covers as many
batches as the highest power of FAN that divides n + 1, and takes up the shorter runs of these batches. So there are
at most FAN - 1 runs of each length, an id is written again once for each length, and the number of a
batch says which runs there are: no list of them is kept that could be half written, and a batch that runs
again writes the same run again. A run lies in folders by a hash of the id, more of them the more batches it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recollect.functions.bounds import broadcast_if_small
from recollect.sources.tables import stage, unless_missing

FAN = 4
SLOTS = 16  # folders of the run of one batch
MOST = 4096  # folders of a run at most; both are powers of FAN, so that a slot of many is a slot of few by its remainder


def runs_before(number: int) -> list[tuple[int, int]]:
    """(first, end) of the runs that hold the ids of the batches before ``number``, longest first."""
    size = 1
    while size * FAN <= number:
        size *= FAN
    runs, first = [], 0
    while first < number:
        while first + size > number:
            size //= FAN
        runs.append((first, first + size))
        first += size
    return runs


def run_of(number: int) -> tuple[int, int]:
    """(first, end) of the run that batch ``number`` writes."""
    size = 1
    while (number + 1) % (size * FAN) == 0:
        size *= FAN
    return number + 1 - size, number + 1


def _slots(first: int, end: int) -> int:
    return min(SLOTS * (end - first), MOST)


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("image_id"), F.lit(slots)).cast("int")


def _read(spark: SparkSession, path: str, first: int, end: int, taken: DataFrame | None) -> DataFrame:
    """One run (image_id, slot). A target older than its ledger has no such run: its own rows then say what was taken."""
    run = unless_missing(lambda: spark.read.schema("image_id long, slot int").parquet(f"{path}/{first}-{end}"))
    if run is not None:
        return run
    if taken is None:
        return spark.createDataFrame([], "image_id long, slot int")
    rows = taken.filter((F.col("arrival") >= first) & (F.col("arrival") < end))
    return rows.select("image_id", _slot(_slots(first, end)).alias("slot"))


def held(ids: DataFrame, path: str, number: int, taken: DataFrame | None = None) -> DataFrame | None:
    """Those of ``ids`` (image_id) that batches before ``number`` took; None before the first.

    Of each run only the folders of slots that ``ids`` fall into are read. Their numbers pass through the driver, MOST at
    most. ``taken``: the rows (image_id, arrival) of the target, for runs that are missing.
    """
    runs = runs_before(number)
    if not runs:
        return None
    spark = ids.sparkSession
    wanted = stage(ids.select("image_id"), "arrived-ids")
    finest = [r["slot"] for r in wanted.select(_slot(MOST).alias("slot")).distinct().collect()]
    asked = [
        _read(spark, path, a, b, taken).filter(F.col("slot").isin(sorted({s % _slots(a, b) for s in finest})))
        for a, b in runs
    ]
    return reduce(DataFrame.unionByName, asked).join(broadcast_if_small(wanted), "image_id", "left_semi").select("image_id")


def enter(ids: DataFrame, path: str, number: int, taken: DataFrame | None = None) -> None:
    """Write the run of batch ``number``: its ``ids`` (image_id), and those of the runs it takes up."""
    spark = ids.sparkSession
    first, end = run_of(number)
    older = [_read(spark, path, a, b, taken).select("image_id") for a, b in runs_before(number) if a >= first]
    slotted = reduce(DataFrame.unionByName, older, ids.select("image_id")).withColumn("slot", _slot(_slots(first, end)))
    slotted.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/{first}-{end}")
