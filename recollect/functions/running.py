"""Running values over an ordered group of any size.

A plain window puts a whole group into one task. Here a group is cut into blocks
along its order; a window works inside each block, a second one over the few rows
that sum up the blocks, and an equi-join on (group, block) brings both together.
A group of n rows puts no more than max(block size, n / block size) rows in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK = 4096


def blocks_of(order: str, size: int = BLOCK) -> Column:
    """Block number of a whole-numbered order column, such as a turn."""
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def time_blocks(order: str, seconds: int = 86_400) -> Column:
    """Block number of a timestamp."""
    return F.floor(F.unix_seconds(F.col(order)) / F.lit(seconds)).cast("long")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, block: Column
) -> DataFrame:
    """Sum of ``value`` from the start of the group up to and including the row."""
    rows = df.withColumn("_value", value).withColumn("_block", block)
    per_block = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    carry = per_block.select(*keys, "_block", F.sum("_sum").over(_earlier(keys)).alias("_before"))
    local = rows.withColumn("_local", F.sum("_value").over(_inside(keys, order, 0)))
    return (
        local.join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.coalesce("_local", F.lit(0)))
        .drop("_value", "_block", "_local", "_before")
    )


def running_last_of(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    block: Column,
    include_row: bool = True,
) -> DataFrame:
    """Last non-null of each value at or (``include_row=False``) strictly before the row."""
    names = list(values)
    rows = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    rows = rows.withColumn("_block", block)
    at = F.struct(*order)
    per_block = rows.groupBy(*keys, "_block").agg(
        *[
            F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), at)).alias(f"_s{i}")
            for i in range(len(names))
        ]
    )
    carry = per_block.select(
        *keys,
        "_block",
        *[
            F.last(f"_s{i}", ignorenulls=True).over(_earlier(keys)).alias(f"_b{i}")
            for i in range(len(names))
        ],
    )
    inside = _inside(keys, order, 0 if include_row else -1)
    local = rows.withColumns(
        {f"_l{i}": F.last(f"_v{i}", ignorenulls=True).over(inside) for i in range(len(names))}
    )
    joined = local.join(carry, [*keys, "_block"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_l{i}", f"_b{i}").alias(n) for i, n in enumerate(names)],
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column,
    include_row: bool = True,
) -> DataFrame:
    """``running_last_of`` for a single value."""
    return running_last_of(df, keys, order, {out: value}, block, include_row)


def _inside(keys: Sequence[str], order: Sequence[str], last: int) -> WindowSpec:
    return (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )


def _earlier(keys: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
