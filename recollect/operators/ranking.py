"""Combining the signals: candidates, final score, refinement, tuning (RT12-RT15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions import boards, running, vectors as vx
from recollect.functions.bounds import broadcast_if_small, lookup
from recollect.operators import retrieval as rt, shelves, together
from recollect.operators.together import Prepared, QuerySet
from recollect.plans.index import Index
from recollect.schemas import SIGNALS
from recollect.sources.tables import stage

EQUAL_WEIGHTS = dict.fromkeys(SIGNALS, 1.0)


def query_set(queries: DataFrame) -> QuerySet:
    """Long form of the ``queries`` layout (schemas.QUERIES)."""
    return QuerySet(
        terms=queries.select("query_id", F.explode("terms").alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("tf")),
        vecs=queries.select("query_id", "query_vec"),
        filters=queries.select("query_id", F.explode("filters").alias("field", "value")),
        clues=queries.select("query_id", F.inline("clues")),
    )


def prepare(queries: QuerySet, index: Index) -> Prepared:
    weighed = stage(rt.weigh_terms(queries.terms, index), "weighed")
    best = shelves.best_by_terms(weighed, index, rt.TEXT.weight, rt.TEXT.factor, 1, places=15)
    best = stage(best.groupBy("query_id").agg(F.max("score").alias("top")), "best_text")
    # After the search, which writes the lists that clues are looked up in.
    hits = stage(rt.clue_hits(queries.clues, index), "clue_hits") if queries.clues is not None else None
    return Prepared(queries, weighed, hits, best)


def score_pairs(pairs: DataFrame, prepared: Prepared, index: Index, among_pairs: bool = False) -> DataFrame:
    """(query_id, image_id, text, semantic, visual, metadata, clue), one row per pair.

    Text is divided by the greatest text score of all items for the query (of the given pairs if ``among_pairs``), cosines are cut to [0, 1], all is rounded.
    A signal that is not available for a pair is NULL: text and semantic when the item
    has no text, visual when item or query lacks a vector, metadata when no requested
    field is known, clue when the query has no clues.
    """
    queries = prepared.queries
    key = ["query_id", "image_id"]
    by_term = rt.sums_of_pairs(
        pairs,
        prepared.weighed.select("query_id", "term", "bm_idf", "q"),
        index,
        {s.name: (s.weight, s.factor) for s in (rt.TEXT, rt.SEMANTIC)},
    )
    zero = F.lit(0.0)
    with_text = pairs.join(index.docs.select("image_id"), "image_id").select(
        *key, zero.alias("text"), zero.alias("semantic")
    )
    parts = [pairs.select(*key), with_text, by_term]
    if queries.vecs is not None:
        units = rt.unit_queries(queries.vecs).withColumnRenamed("unit", "_asked")
        parts.append(
            pairs.join(broadcast_if_small(units), "query_id")
            .join(index.vectors.select("image_id", "unit"), "image_id")
            .select(*key, vx.dot(F.col("unit"), F.col("_asked")).alias("visual"))
        )
    if queries.filters is not None:
        meta = rt.metadata_score(pairs, queries.filters, index.items)
        parts.append(meta.withColumnRenamed("score", "metadata"))
    if queries.clues is not None:
        clue = rt.clue_score(pairs, queries.clues, prepared.clue_hits)
        parts.append(clue.withColumnRenamed("score", "clue"))
    if not among_pairs:
        return _comparable(_gathered(parts), prepared.best_text)
    gathered = stage(_gathered(parts), "gathered")
    return _comparable(gathered, gathered.groupBy("query_id").agg(F.max("text").alias("top")))


def _gathered(parts: Sequence[DataFrame]) -> DataFrame:
    """One row per pair with the signals of all parts: a union and one aggregate, no joins."""
    rows = []
    for part in parts:
        held = [F.col(s) if s in part.columns else F.lit(None) for s in SIGNALS]
        rows.append(
            part.select("query_id", "image_id", *[c.cast("double").alias(s) for c, s in zip(held, SIGNALS)])
        )
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("query_id", "image_id").agg(*[F.max(s).alias(s) for s in SIGNALS])


def _comparable(scored: DataFrame, best_text: DataFrame) -> DataFrame:
    scaled = lookup(scored, best_text, "query_id", how="left").withColumn(
        "text", F.when(F.col("top") > 0, F.col("text") / F.col("top")).otherwise(F.col("text"))
    )
    for cosine in ("semantic", "visual"):
        held = F.least(F.greatest(F.col(cosine), F.lit(0.0)), F.lit(1.0))
        scaled = scaled.withColumn(cosine, F.when(F.col(cosine).isNotNull(), held))
    return scaled.select(
        "query_id", "image_id", *[F.round(s, rt.PLACES).alias(s) for s in SIGNALS]
    )


def final_score(weights: Mapping[str, float | Column]) -> Column:
    """Weighted sum; a signal that is not available adds 0."""
    total = F.lit(0.0)
    for name in SIGNALS:
        total = total + weights.get(name, 0.0) * F.coalesce(name, F.lit(0.0))
    return total


def rank_scored(
    scored: DataFrame, weights: Mapping[str, float] = EQUAL_WEIGHTS, k: int = 10
) -> DataFrame:
    """First k pairs per query by final score, with every signal kept as evidence."""
    return rt.top_k(scored.withColumn("final", final_score(weights)), k, score="final")


def hybrid_search(
    queries: QuerySet | Prepared,
    index: Index,
    weights: Mapping[str, float] = EQUAL_WEIGHTS,
    k: int = 10,
) -> DataFrame:
    """Ranked results from all signals together: the first k of the whole corpus, with every signal as evidence.

    Items are found shelf by shelf (``together.best_by_final``); the few that are found are scored once more, pair by
    pair, with what is not available as NULL.
    """
    prepared = queries if isinstance(queries, Prepared) else prepare(queries, index)
    found = rt.top_k(together.best_by_final(prepared, index, weights, k), k + boards.SPARE)
    pairs = stage(found.select("query_id", "image_id"), "found")
    return rank_scored(score_pairs(pairs, prepared, index), weights, k)


def refine(
    queries: QuerySet,
    index: Index,
    previous: DataFrame | None = None,
    mode: str = "requery",
    weights: Mapping[str, float] = EQUAL_WEIGHTS,
    k: int = 10,
) -> DataFrame:
    """Results of updated queries.

    ``requery`` searches the whole corpus. ``rerank`` scores only ``previous``, the pairs
    (query_id, image_id) found before, given under the id of the updated query; text is
    divided by its greatest score among those.
    """
    if mode == "requery":
        return hybrid_search(queries, index, weights, k)
    if mode != "rerank" or previous is None:
        raise ValueError("mode is requery, or rerank with the previous pairs")
    pairs = stage(previous.select("query_id", "image_id").distinct(), "previous")
    return rank_scored(score_pairs(pairs, prepare(queries, index), index, among_pairs=True), weights, k)


def rank_delta(results: DataFrame) -> DataFrame:
    """Adds ``previous`` and ``moved`` (places gained) to (conv_id, turn, image_id, rank).

    ``previous`` is the rank the item had when it was last in the results of the conversation.
    """
    return running.running_last(
        results,
        ["conv_id", "image_id"],
        ["turn"],
        F.col("rank"),
        "previous",
        running.blocks_of("turn"),
        include_row=False,
    ).withColumn("moved", F.col("previous") - F.col("rank"))


def tune_weights(
    queries: QuerySet | Prepared, index: Index, truth: DataFrame, grid: Sequence[Mapping[str, float]]
) -> DataFrame:
    """(setting, text, semantic, visual, metadata, clue, queries, mrr) for every weighting.

    ``truth`` is (query_id, image_id). The target's place is 1 + the number of items of the whole corpus that come before
    it, counted shelf by shelf for all weightings at once. Items of which every signal is 0 have no
    place; a target that is one counts 0.
    """
    prepared = queries if isinstance(queries, Prepared) else prepare(queries, index)
    pairs = stage(truth.select("query_id", "image_id").distinct(), "targets")
    scored = score_pairs(pairs, prepared, index)
    own = F.array(*[F.round(final_score(w), rt.PLACES) for w in grid])
    any_signal = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in SIGNALS]) > 0
    goals = stage(scored.filter(any_signal).select("query_id", F.col("image_id").alias("target"), own.alias("own")), "goals")
    ahead = together.places_of_targets(prepared, index, goals, grid)
    score = ahead.groupBy("setting").agg(F.sum(1 / (F.col("ahead") + 1)).alias("_sum"))
    total_queries = pairs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    rows = [(i, *[float(w.get(s, 0.0)) for s in SIGNALS]) for i, w in enumerate(grid)]
    columns = ", ".join(["setting int", *[f"{s} double" for s in SIGNALS]])
    every = pairs.sparkSession.createDataFrame(rows, columns)
    return every.join(score, "setting", "left").select(
        "setting",
        *SIGNALS,
        total_queries.alias("queries"),
        F.round(F.coalesce("_sum", F.lit(0.0)) / total_queries, rt.PLACES).alias("mrr"),
    )
