"""Validation, the audit of preserved metadata, and processing status (IN3, IN4, IN7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions import text as tx
from recollect.functions.bounds import broadcast_if_small, lookup
from recollect.sources.tables import stage

NULL_ID = "null id"
REPEATED_ID = "repeated id"
NO_CONTENT = "no text and no vector"
WRONG_LENGTH = "vector of wrong length"


def validate(items: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted items, and quarantined items with a reason.

    Of items that share an id, the one with the least content hash is accepted.
    Quarantined rows that are copies of each other are one row with a ``copies``
    count: rows in = accepted rows + sum of ``copies``. Only ids are counted over all rows; whole rows
    are brought together where they have no id or share it, and there copies are counted before the shuffle.
    """
    columns = items.columns
    checked = items.withColumn("reason", _own_fault(dim))
    counts = items.filter("image_id IS NOT NULL").groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    shared = broadcast_if_small(stage(counts.filter("_n > 1").select("image_id"), "repeated_ids"))
    single = checked.filter("image_id IS NOT NULL").join(shared, "image_id", "left_anti")
    several = checked.join(shared, "image_id", "left_semi").unionByName(checked.filter("image_id IS NULL"))
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    copies = (
        several.withColumn("_hash", content)
        .groupBy("image_id", "_hash")
        .agg(
            F.any_value(F.struct(*[c for c in columns if c != "image_id"], "reason")).alias("_row"),
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    flat = stage(copies.select("image_id", "_hash", "_copies", "_row.*"), "repeated_items")
    first = flat.filter("reason IS NULL").groupBy("image_id").agg(F.min("_hash").alias("_first"))
    judged = lookup(flat, first, "image_id", how="left").withColumn(
        "_taken", F.col("reason").isNull() & (F.col("_hash") == F.col("_first"))
    )
    accepted = single.filter("reason IS NULL").select(*columns).unionByName(judged.filter("_taken").select(*columns))
    spare = F.when(F.col("_taken"), F.col("_copies") - 1).otherwise(F.col("_copies"))
    rejected = (
        judged.withColumn("reason", F.coalesce("reason", F.lit(REPEATED_ID)))
        .withColumn("copies", spare)
        .filter("copies > 0")
        .select(*columns, "reason", "copies")
    )
    faulty = single.filter("reason IS NOT NULL").select(*columns, "reason", F.lit(1).cast("long").alias("copies"))
    return accepted, faulty.unionByName(rejected)


def _own_fault(dim: int | None) -> Column:
    """What is wrong with a row on its own account, or NULL."""
    wordless = F.size(tx.tokens(F.coalesce("text", F.lit("")))) == 0
    reason = F.when(F.col("image_id").isNull(), NULL_ID).when(
        wordless & F.col("embedding").isNull(), NO_CONTENT
    )
    if dim is not None:
        reason = reason.when(F.col("embedding").isNotNull() & (F.size("embedding") != dim), WRONG_LENGTH)
    return reason


def _named_values(name: str, kind: str) -> Column:
    if kind == "map":
        entries = F.transform(
            F.map_entries(name),
            lambda e: F.struct(
                F.concat(F.lit(f"{name}."), e["key"].cast("string")).alias("field"),
                e["value"].cast("string").alias("value"),
            ),
        )
        return F.coalesce(entries, F.array().cast("array<struct<field:string,value:string>>"))
    value = F.to_json(F.col(name)) if kind == "struct" else F.col(name).cast("string")
    return F.array(F.struct(F.lit(name).alias("field"), value.alias("value")))


def _known_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(image_id, field, value) for every known field. Map entries count as fields."""
    pairs = [_named_values(name, df.schema[name].dataType.typeName()) for name in fields]
    return df.select("image_id", F.inline(F.concat(*pairs))).filter("value IS NOT NULL")


def provenance_audit(
    source: DataFrame,
    output: DataFrame,
    fields: Sequence[str] = ("source", "uri", "file_info", "ts", "meta"),
) -> DataFrame:
    """Per field: items known and unknown in the output, and values the input does not hold.

    ``invented`` must be 0 everywhere: unknown stays NULL.
    """
    known_out = _known_values(output, fields)
    known_in = _known_values(source, fields)
    invented = (
        known_out.join(known_in, ["image_id", "field", "value"], "left_anti")
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("invented"))
    )
    plain = [f for f in fields if output.schema[f].dataType.typeName() != "map"]
    declared = output.select(F.explode(F.array(*[F.lit(f) for f in plain])).alias("field")).distinct()
    known = known_out.groupBy("field").agg(F.count(F.lit(1)).alias("known"))
    total = output.agg(F.count(F.lit(1)).alias("items")).select("items").scalar()
    return (
        declared.join(known, "field", "full")
        .join(invented, "field", "left")
        .select(
            "field",
            F.coalesce("known", F.lit(0)).cast("long").alias("known"),
            (total - F.coalesce("known", F.lit(0))).cast("long").alias("unknown"),
            F.coalesce("invented", F.lit(0)).cast("long").alias("invented"),
        )
    )


def status_rollup(status: DataFrame) -> DataFrame:
    """Items per source, stage and latest state, from an append-only status table.

    Of states of the same time the last by spelling counts.
    """
    latest = status.groupBy("image_id", "stage").agg(
        F.max_by(F.struct("source", "state"), F.struct("at", "state", "source")).alias("_last")
    )
    return latest.groupBy("_last.source", "stage", "_last.state").agg(
        F.count(F.lit(1)).alias("items")
    )
