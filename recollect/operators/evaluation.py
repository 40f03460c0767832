"""Retrieval quality on queries whose answer is known (EV1, EV2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recollect.operators.ranking import EQUAL_WEIGHTS, tune_weights
from recollect.operators.together import Prepared, QuerySet
from recollect.plans.index import Index
from recollect.schemas import SIGNALS


def evaluate(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, found, mrr, hit_at_1, hit_at_k) over (query_id, image_id) truth."""
    place = results.filter(F.col("rank") <= k).select("query_id", "image_id", "rank")
    joined = truth.select("query_id", "image_id").distinct().join(
        place, ["query_id", "image_id"], "left"
    )
    hit = F.col("rank").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(hit).alias("found"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("hit_at_1"),
        F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("hit_at_k"),
    )


def ablate(queries: QuerySet | Prepared, index: Index, truth: DataFrame) -> DataFrame:
    """(signals, queries, mrr): quality of each signal alone and of all together."""
    grid = [{s: 1.0} for s in SIGNALS] + [EQUAL_WEIGHTS]
    names = F.array(*[F.lit(n) for n in (*SIGNALS, "all")])
    return tune_weights(queries, index, truth, grid).select(
        F.element_at(names, F.col("setting") + 1).alias("signals"), "queries", "mrr"
    )
