"""Events created as confirmations arrive (AC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.operators.actions import confirmed, new_events
from recollect.sources.tables import other_folders

BATCH, WRITER = "batch", "writer"


def stream_events(confirmations: DataFrame, proposals: DataFrame, path: str, checkpoint: str, writer: str = "main") -> StreamingQuery:
    """Create an event for each proposal that a stream of (proposal_id, confirmed) confirms, each of them once.

    A batch is written to a folder of its own, named by writer and batch number. A batch that is run again
    overwrites its folder, and leaves out what is in the others. ``writer`` names the stream: two that write
    at the same time need two names, and ``read_events`` counts what both created once.
    """

    def create(batch: DataFrame, number: int) -> None:
        accepted, _ = confirmed(proposals, batch)
        folder = f"{WRITER}={writer}/{BATCH}={number}"
        earlier = other_folders(batch.sparkSession, path, {WRITER: writer, BATCH: number})
        fresh = accepted.dropDuplicates(["proposal_id"]) if earlier is None else new_events(accepted, earlier)
        fresh.write.mode("overwrite").parquet(f"{path}/{folder}")

    return confirmations.writeStream.foreachBatch(create).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events at ``path``, one row for each proposal, whoever created it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("proposal_id", WRITER, BATCH)]
    first = F.min_by(F.struct(*rest), F.struct(WRITER, BATCH)).alias("event")
    return rows.groupBy("proposal_id").agg(first).select("proposal_id", "event.*")
