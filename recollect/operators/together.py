"""All signals together: the best of the whole corpus, and places of known items in it.

What makes up the signals of a block of queries on a shelf comes to one task as entries (``functions.boards``):
postings of asked terms, vectors, metadata profiles that match, items that have a clue. Queries with
equal filters share one row, and so do items of equal metadata.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recollect.functions import boards
from recollect.functions.bounds import lookup
from recollect.operators import retrieval as rt, shelves as sh
from recollect.plans.index import Index
from recollect.sources.tables import stage


@dataclass(frozen=True)
class QuerySet:
    """A batch of queries in long form. Any part but the terms may be missing."""

    terms: DataFrame
    vecs: DataFrame | None = None
    filters: DataFrame | None = None
    clues: DataFrame | None = None


@dataclass(frozen=True)
class Prepared:
    """What scoring needs of a query set, worked out once. ``best_text`` is (query_id, top): the greatest text score of all items."""

    queries: QuerySet
    weighed: DataFrame
    clue_hits: DataFrame | None
    best_text: DataFrame


def signal_rows(prepared: Prepared, numbers: DataFrame, index: Index) -> tuple[list[DataFrame], list[DataFrame]]:
    """Entries of all five signals, of the shelves and of the blocks of queries."""
    queries = prepared.queries
    terms = lookup(lookup(prepared.weighed, numbers, "query_id"), prepared.best_text, "query_id", how="left")
    share = F.when(F.col("top") > 0, F.col("bm_idf") / F.col("top")).otherwise(F.col("bm_idf"))
    shelves = [sh.shelf_rows(index), sh.term_rows(prepared.weighed, index)]
    asked = [sh.asked_terms(terms.select("qb", "qn", "term", share.alias("f1"), F.col("q").alias("f2")))]
    if queries.vecs is not None:
        units = rt.unit_queries(queries.vecs).join(numbers, "query_id").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("qn", "unit"))).alias("_q"))
        asked.append(units.select(*sh.asked(boards.VECTORS, qn="_q.qn", f1=F.flatten("_q.unit"))))
        shelves.append(index.facing.select(*sh.held(boards.VECTORS, at="at", v1="units")))
    if queries.filters is not None:
        asked.append(asked_fields(queries.filters, numbers, index))
        shelves.append(index.sides.select(*sh.held(boards.FIELDS, key="profile", at="at")))
    if queries.clues is not None:
        asked.append(asked_clues(queries.clues, numbers))
        placed = prepared.clue_hits.join(index.places.select("image_id", "shelf", "at"), "image_id")
        lists = placed.groupBy("shelf", "value").agg(F.sort_array(F.collect_list("at")).alias("at"))
        shelves.append(lists.select(*sh.held(boards.CLUE, key="value", at="at")))
    return shelves, asked


def asked_fields(filters: DataFrame, numbers: DataFrame, index: Index) -> DataFrame:
    """Metadata scores above 0 by profile, worked out for distinct filter sets."""
    to_set, members = rt.sets_of(filters, ["field", "value"])
    members = stage(members, "filter_sets")
    profiles = stage(index.sides.groupBy("profile").agg(F.any_value("known").alias("known")), "profiles")
    scored = rt.profile_scores(members, profiles)
    by_block = to_set.join(numbers, "query_id").groupBy("qb", "set_id").agg(F.sort_array(F.collect_list("qn")).alias("qn"))
    return by_block.join(scored, "set_id").select(*sh.asked(boards.FIELDS, key="profile", qn="qn", f1=F.array_repeat("score", F.size("qn"))))


def asked_clues(clues: DataFrame, numbers: DataFrame) -> DataFrame:
    """By clue value, its share of the queries' clues."""
    distinct = clues.select("query_id", "slot", "value").distinct()
    counts = distinct.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    share = distinct.groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("_c")).join(counts, "query_id").join(numbers, "query_id")
    each = F.sort_array(F.collect_list(F.struct("qn", (F.col("_c") / F.col("_n")).alias("f1")))).alias("_q")
    return share.groupBy("qb", "value").agg(each).select(*sh.asked(boards.CLUE, key="value", qn="_q.qn", f1="_q.f1"))


def best_by_final(prepared: Prepared, index: Index, weights: Mapping[str, float], k: int) -> DataFrame:
    """(query_id, image_id, score): at least the k best items of all by their final score."""
    numbers = sh.numbered(_every_query(prepared.queries))
    kernel = boards.best_by_final(k, [float(weights.get(s, 0.0)) for s in boards.SIGNALS])
    found = sh.score(*signal_rows(prepared, numbers, index), kernel, boards.TOP, lambda rows: sh.best(rows, k + boards.SPARE))
    return sh.named(found, numbers)


def places_of_targets(prepared: Prepared, index: Index, goals: DataFrame, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """(query_id, setting, ahead): how many items of all come before each query's target, by every weighting.

    ``goals`` is (query_id, target, own): own holds the target's final score for each weighting.
    """
    numbers = sh.numbered(_every_query(prepared.queries))
    shelves, asked = signal_rows(prepared, numbers, index)
    lists = goals.join(numbers, "query_id").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("qn", "target", "own"))).alias("_q"))
    asked.append(lists.select(*sh.asked(boards.GOAL, qn="_q.qn", ids="_q.target", f1=F.flatten("_q.own"))))
    weights = [[float(w.get(s, 0.0)) for s in boards.SIGNALS] for w in grid]
    added = lambda rows: rows.groupBy("qb", "qn", "setting").agg(F.sum("ahead").alias("ahead"))
    return sh.named(sh.score(shelves, asked, boards.count_ahead(weights), boards.AHEAD, added), numbers)


def _every_query(q: QuerySet) -> DataFrame:
    """Ids of all queries that ask anything."""
    parts = [p.select("query_id") for p in (q.terms, q.vecs, q.filters, q.clues) if p is not None]
    return reduce(DataFrame.unionByName, parts).distinct()
