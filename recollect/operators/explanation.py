"""Why a result was found (EX1-EX4). Every line comes from a signal that ranking used."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.functions.bounds import broadcast_if_small
from recollect.operators.ranking import EQUAL_WEIGHTS, Prepared
from recollect.operators.retrieval import clue_score, metadata_score, unit_queries
from recollect.plans.index import Index
from recollect.schemas import SIGNALS


def explain(results: DataFrame, weights: Mapping[str, float] = EQUAL_WEIGHTS) -> DataFrame:
    """(query_id, image_id, rank, signal, score, weight, share), one row per available signal.

    ``share`` is the signal's part of the final score; NULL when that is 0.
    """
    entry = [
        F.struct(
            F.lit(name).alias("signal"),
            F.col(name).alias("score"),
            F.lit(float(weights.get(name, 0.0))).alias("weight"),
        )
        for name in SIGNALS
    ]
    long = results.select("query_id", "image_id", "rank", "final", F.inline(F.array(*entry)))
    part = F.col("score") * F.col("weight")
    return long.filter(F.col("score").isNotNull()).select(
        "query_id",
        "image_id",
        "rank",
        "signal",
        "score",
        "weight",
        F.round(F.when(F.col("final") > 0, part / F.col("final")), 4).alias("share"),
    )


def matched_terms(weighed: DataFrame, index: Index, results: DataFrame) -> DataFrame:
    """(query_id, image_id, term, part, place): query terms found in each hit, heaviest first."""
    wanted = broadcast_if_small(weighed.select("term").distinct())
    held = index.postings.select("image_id", "term", "bm").join(wanted, "term", "left_semi")
    order = Window.partitionBy("query_id", "image_id").orderBy(F.col("part").desc(), F.col("term"))
    return (
        results.select("query_id", "image_id")
        .join(broadcast_if_small(weighed.select("query_id", "term", "bm_idf")), "query_id")
        .join(held, ["image_id", "term"])
        .select("query_id", "image_id", "term", F.round(F.col("bm") * F.col("bm_idf"), 6).alias("part"))
        .withColumn("place", F.row_number().over(order))
    )


def _named(evidence: DataFrame, entry: Column, name: str) -> DataFrame:
    """(query_id, image_id, name): the entries of each pair in order, joined by commas."""
    return evidence.groupBy("query_id", "image_id").agg(
        F.array_join(F.array_sort(F.collect_set(entry)), ", ").alias(name)
    )


def why(
    explained: DataFrame,
    matched: DataFrame,
    fields: DataFrame | None = None,
    clues: DataFrame | None = None,
    first: int = 3,
) -> DataFrame:
    """(query_id, image_id, rank, signal, line): one line per signal that scored above 0.

    The text line names the heaviest matched terms, the metadata line the ``matched_fields``, the clue
    line the ``matched_clues``; without those tables they give the score. A visual line speaks of
    likeness only: nothing detects objects here.
    """
    words = (
        matched.filter(F.col("place") <= first)
        .groupBy("query_id", "image_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("_words"))
        .select(
            "query_id",
            "image_id",
            F.array_join(F.transform("_words", lambda w: w["term"]), ", ").alias("_terms"),
        )
    )
    score = F.format_string("%.2f", F.col("score"))
    used = explained.filter((F.col("score") > 0) & (F.col("weight") > 0))
    used = used.join(words, ["query_id", "image_id"], "left")
    named = {"_fields": F.lit(None).cast("string"), "_clues": F.lit(None).cast("string")}
    if fields is not None:
        used = used.join(_named(fields, F.col("field"), "_fields"), ["query_id", "image_id"], "left")
        named["_fields"] = F.col("_fields")
    if clues is not None:
        pair = F.concat("slot", F.lit(" "), "value")
        used = used.join(_named(clues, pair, "_clues"), ["query_id", "image_id"], "left")
        named["_clues"] = F.col("_clues")
    line = (
        F.when(F.col("signal") == "text", F.concat(F.lit("Text matched: "), F.col("_terms")))
        .when(F.col("signal") == "semantic", F.concat(F.lit("Wording is related: "), score))
        .when(F.col("signal") == "visual", F.concat(F.lit("Visual likeness to the query: "), score))
        .when(F.col("signal") == "metadata", F.concat(F.lit("Metadata matched: "), F.coalesce(named["_fields"], score)))
        .otherwise(F.concat(F.lit("Remembered clues found: "), F.coalesce(named["_clues"], score)))
    )
    return used.select("query_id", "image_id", "rank", "signal", line.alias("line"))


def grounding_audit(
    explained: DataFrame, matched: DataFrame, index: Index, prepared: Prepared
) -> DataFrame:
    """(evidence, claims, ungrounded): what explanations claim, and what nothing stands behind.

    A term must be in the item; text and wording need a term that item and query share; likeness a
    vector on both sides; metadata a requested field whose value the item has; a clue one of the
    query's clues found in the item. ``ungrounded`` must be 0 everywhere.
    """
    key = ["query_id", "image_id"]
    queries = prepared.queries
    used = explained.filter("score > 0").select(*key, F.col("signal").alias("evidence")).distinct()
    pairs = used.select(*key).distinct()
    terms = matched.select(*key, "term").distinct()
    asked = broadcast_if_small(prepared.weighed.select("query_id", "term"))
    held = index.postings.select("image_id", "term").join(
        broadcast_if_small(prepared.weighed.select("term").distinct()), "term", "left_semi"
    )
    shared = pairs.join(asked, "query_id").join(held, ["image_id", "term"]).select(*key).distinct()
    grounds = [shared.withColumn("evidence", F.lit(name)) for name in ("text", "semantic")]
    if queries.vecs is not None:
        units = broadcast_if_small(unit_queries(queries.vecs).select("query_id"))
        seen = pairs.join(units, "query_id", "left_semi").join(index.vectors.select("image_id"), "image_id", "left_semi")
        grounds.append(seen.withColumn("evidence", F.lit("visual")))
    if queries.filters is not None:
        met = metadata_score(pairs, queries.filters, index.items).filter("score > 0")
        grounds.append(met.select(*key).withColumn("evidence", F.lit("metadata")))
    if queries.clues is not None:
        found = clue_score(pairs, queries.clues, prepared.clue_hits).filter("score > 0")
        grounds.append(found.select(*key).withColumn("evidence", F.lit("clue")))
    grounded = reduce(DataFrame.unionByName, grounds).withColumn("_ok", F.lit(True))
    claims = used.join(grounded, [*key, "evidence"], "left").select("evidence", "_ok")
    in_item = index.postings.select("image_id", "term", F.lit(True).alias("_ok"))
    words = terms.join(in_item, ["image_id", "term"], "left").select(F.lit("term").alias("evidence"), "_ok")
    return claims.unionByName(words).groupBy("evidence").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("_ok").isNull()).alias("ungrounded")
    )
