"""Items that arrive over time (IN5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from recollect.operators.intake import validate
from recollect.plans.segments import add_segment, merge_segments
from recollect.schemas import ITEMS
from recollect.sources import ledger
from recollect.sources.archive import to_items
from recollect.sources.tables import unless_missing

BATCH = "arrival"


def stream_ingest(
    spark: SparkSession,
    incoming: str,
    out: str,
    checkpoint: str,
    dim: int | None = None,
    schema: T.StructType = ITEMS,
    files_per_batch: int = 1000,
    index: str | None = None,
) -> StreamingQuery:
    """Take new files through the same path as an archive; each id is taken once.

    A batch is written to a folder of its own, named by the batch number. A batch that is
    run again after a failure overwrites its folder, and looks for known ids only in what the
    batches before it took; see ``sources.ledger``. With ``index`` each batch becomes a segment of the growing index at that path, and is found by
    searches from then on; see ``plans.segments``.
    """
    arrivals = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(incoming)
    )

    def take(batch: DataFrame, number: int) -> None:
        accepted, rejected = validate(to_items(batch), dim)
        earlier = unless_missing(lambda: spark.read.option("basePath", f"{out}/items").parquet(f"{out}/items"))
        known = ledger.held(accepted, f"{out}/ids", number, earlier)
        fresh = accepted if known is None else accepted.join(known, "image_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/items/{BATCH}={number}")
        taken = spark.read.schema(fresh.schema).parquet(f"{out}/items/{BATCH}={number}")
        ledger.enter(taken, f"{out}/ids", number, earlier)
        if index:
            add_segment(taken, index, f"{BATCH}-{number}")
            merge_segments(spark, index)
        rejected.write.mode("overwrite").parquet(f"{out}/quarantine/{BATCH}={number}")

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
