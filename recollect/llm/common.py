"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recollect.sources.tables import stage

# Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for NULL."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def about(key: Column, wanted: int, rows: int) -> Column:
    """Holds for about twice ``wanted`` of ``rows`` rows, by a hash (LONG) of each.

    Ordering what is left and taking ``wanted`` costs little, however many partitions there are.
    """
    share = min(1.0, 2.0 * wanted / max(rows, 1))
    return F.shiftrightunsigned(key, 33) < int(share * 2**31) + 1


def literal_table(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small table of rows known to the driver, as a literal in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")))


def running_totals(
    df: DataFrame, order: Sequence[Column], value: str, total: str, parts: int, name: str
) -> DataFrame:
    """Adds ``total``: the sum of ``value`` (LONG) over all rows before this one in ``order``.

    The rows are dealt out by ranges of ``order`` and summed range by range; only one sum for
    each range meets the others. Rows that are equal in ``order`` may come in any order. The
    result is a written table, so that a repeated task cannot number rows anew.
    """
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    written = stage(ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0))), name)
    sums = written.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return (
        written.join(F.broadcast(starts), "_part")
        .withColumn(total, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )
