"""Size checks before a broadcast, and the ways around one.

A side is broadcast only after it was measured. Beyond the limit the caller
either works through the side in blocks, each below the limit, or joins by
shuffle with the frequent keys taken out of the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

LIMIT_SETTING = "recollect.broadcast.bytes"
DEFAULT_LIMIT = 64 * 1024 * 1024
# Frequent keys: those holding more than 1/MAX_HOT_KEYS of the rows. There can be
# no more than MAX_HOT_KEYS of them, whatever the data.
MAX_HOT_KEYS = 20_000


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(field.dataType, T.ArrayType):
        inner = field.dataType.elementType
        if isinstance(inner, T.StringType):
            joined = F.octet_length(F.array_join(col, ""))
            return F.coalesce(joined + 16 * F.size(col), F.lit(0)).cast("long") + 16
        return F.coalesce(F.size(col) * 16, F.lit(0)).cast("long") + 16
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)).cast("long") * 2 + 32
    return F.lit(16).cast("long")


def measure(df: DataFrame) -> Size:
    """Rows and in-memory bytes of ``df``, by one aggregate without a shuffle of its rows."""
    width = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return Size(int(row["n"]), int(row["b"] or 0))


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave the join to AQE."""
    cap = broadcast_limit(df) if limit is None else limit
    return F.broadcast(df) if measure(df).bytes <= cap else df


def in_blocks(
    side: DataFrame,
    key: str,
    step: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
) -> DataFrame:
    """Union of ``step(block)`` over blocks of ``side``, each small enough to broadcast.

    The blocks split ``side`` by a hash of ``key`` and cover it completely. One
    block, the usual case, leaves ``side`` as it is.
    """
    cap = broadcast_limit(side) if limit is None else limit
    size = measure(side)
    blocks = 1 if size.bytes <= cap else math.ceil(2 * size.bytes / max(cap, 1))
    if blocks == 1:
        return step(F.broadcast(side))
    slot = F.pmod(F.xxhash64(key), F.lit(blocks))
    parts = [step(F.broadcast(side.filter(slot == b))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per ``key``; safe when a key is frequent.

    A small table is broadcast. A large one is split: entries of frequent keys
    (at most MAX_HOT_KEYS) are broadcast, the others are joined by shuffle, where no
    key can hold more than 1/MAX_HOT_KEYS of the rows.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup joins are inner or left, not {how!r}")
    cap = broadcast_limit(rows) if limit is None else limit
    if measure(table).bytes <= cap:
        return rows.join(F.broadcast(table), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    floor = max(rows.count() / MAX_HOT_KEYS, 1.0)
    hot = F.broadcast(counts.filter(F.col("_n") > floor).select(key))
    hot_rows = rows.join(hot, key, "left_semi")
    cold_rows = rows.join(hot, key, "left_anti")
    hot_table = F.broadcast(table.join(hot, key, "left_semi"))
    return hot_rows.join(hot_table, key, how).unionByName(cold_rows.join(table, key, how))
