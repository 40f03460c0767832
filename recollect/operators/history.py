"""Timeline and interaction history, on tables the user supplies (HI1-HI3).

No history is ever derived from items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recollect.functions import running


def timeline(records: DataFrame, unit: str = "month") -> DataFrame:
    """(bucket, items): items per time bucket. Items of unknown time are the NULL bucket."""
    return records.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(
        F.count(F.lit(1)).alias("items")
    )


def history_summary(history: DataFrame) -> DataFrame:
    """(user_id, kind, events, last_ts)."""
    return history.groupBy("user_id", "kind").agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts")
    )


def viewed_before(history: DataFrame, anchors: DataFrame, kind: str = "view") -> DataFrame:
    """(anchor_id, user_id, ts, event_id, seen_ts): the latest such event before each anchor.

    An as-of join: history and anchors are put in one order per user, and each anchor
    takes the last event before it. A user's days are worked on apart, so that one very
    active user does not end up in one task. Anchors without an earlier event are left out.
    """
    seen = history.filter(F.col("kind") == kind).select(
        "user_id",
        "ts",
        F.lit(1).alias("_side"),
        F.lit(None).cast("long").alias("anchor_id"),
        F.struct("ts", "event_id").alias("_event"),
        F.col("event_id").alias("_tie"),
    )
    asked = anchors.select(
        "user_id",
        "ts",
        F.lit(0).alias("_side"),
        "anchor_id",
        F.lit(None).cast(seen.schema["_event"].dataType).alias("_event"),
        F.col("anchor_id").alias("_tie"),
    )
    found = running.running_last(
        seen.unionByName(asked),
        ["user_id"],
        ["ts", "_side", "_tie"],
        F.col("_event"),
        "_seen",
        running.time_blocks("ts"),
        include_row=False,
    )
    return found.filter((F.col("_side") == 0) & F.col("_seen").isNotNull()).select(
        "anchor_id",
        "user_id",
        "ts",
        F.col("_seen.event_id").alias("event_id"),
        F.col("_seen.ts").alias("seen_ts"),
    )
