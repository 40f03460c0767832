"""One search per signal, and the shared top-k (RT1-RT11).

Queries come in long form: ``query_terms(query_id, term, tf)``,
``query_vecs(query_id, query_vec)``, ``query_filters(query_id, field, value)`` and
``query_clues(query_id, slot, value)``. Results are (query_id, image_id, score, rank).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.functions import boards, text as tx, vectors as vx
from recollect.functions.bounds import (
    broadcast_if_small,
    broadcast_limit,
    in_blocks,
    lookup,
    measure,
)
from recollect.operators import shelves
from recollect.operators.signals import rare_weight, term_weight
from recollect.plans.index import FIRSTS, Index, field_slot, known_fields, profile_of, slot_of
from recollect.sources.tables import of_slots, stage, stage_parted

PLACES = 6
# Block sizes of the nearest-vector search: rows of vectors and of queries that meet as matrices.
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024
# Approximate search: parts of a code, entries of a codebook, vectors that it is fitted on, and how many
# items are scored exactly for each of the k asked for.
CODE_PARTS, CODE_ENTRIES, CODE_SAMPLE, RESCORED = 16, 256, 20_000, 12
# Rows up to which the sums of a search over shared terms are made without pruning.
SUM_ROWS = 500_000_000
# Share of the floor that terms left for later may make up. Any value below 1 is exact; a low
# one reads more postings and leaves fewer items.
WEAK_SHARE = 0.4
PHRASE_BLOCK = 8192
# Rounds of phrases whose queries are broadcast in one job; what more of them find is written round by round.
MOST_ROUNDS = 8
# Turn numbers of a segment that are searched together.
TURN_PIECE = 256


def top_k(
    scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score"
) -> DataFrame:
    """First k per group by rounded score, ties by image_id.

    Written as ``row_number() <= k`` so that every task keeps k rows per group
    before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col("image_id").asc())
    return (
        scored.withColumn(score, F.round(score, PLACES))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def weigh_terms(query_terms: DataFrame, index: Index, limit: int | None = None) -> DataFrame:
    """(query_id, term, df, bm_idf, q, max_bm, max_ltf): the weights of every query term.

    ``bm_idf`` and ``q`` are the factors of BM25 and of the cosine, the maxima what a term
    can at most add before them.

    Terms no item has count in the length of the query vector, and match nothing.
    """
    counted = query_terms.groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))
    wanted = counted.select("term").distinct()
    stats = index.terms.join(broadcast_if_small(wanted, limit), "term", "left_semi")
    n_docs = index.corpus.select("n_docs").scalar().cast("double")
    weighed = (
        lookup(counted, stats, "term", how="left", limit=limit)
        .withColumn("idf", F.coalesce("idf", rare_weight(n_docs, F.lit(0.0))))
        .withColumn("_raw", term_weight(F.col("tf")) * F.col("idf"))
    )
    length = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_len"))
    unit = lookup(weighed, length, "query_id", limit=limit)
    return unit.filter(F.col("df").isNotNull()).select(
        "query_id",
        "term",
        "df",
        "bm_idf",
        (F.col("_raw") / F.col("_len") * F.col("idf")).alias("q"),
        "max_bm",
        "max_ltf",
    )


@dataclass(frozen=True)
class TermSignal:
    """Columns of a score that is a sum over shared terms: ``weight`` x ``factor``."""

    name: str
    weight: str
    factor: str
    peak: str


TEXT = TermSignal("text", "bm", "bm_idf", "max_bm")
SEMANTIC = TermSignal("semantic", "ltf", "q", "max_ltf")


def _sums(block: DataFrame, index: Index, weight: str, *keep: str) -> DataFrame:
    """(query_id, image_id, score, *keep): sums over the terms an item shares with a query.

    Postings are bucketed by image_id, so the sums need no shuffle.
    """
    hits = index.postings.select("image_id", "term", weight).join(block, "term")
    return hits.groupBy("query_id", "image_id", *keep).agg(
        F.sum(F.col(weight) * F.col("_factor")).alias("score")
    )


def best_by_terms(
    weighed: DataFrame,
    index: Index,
    signal: TermSignal,
    k: int,
    limit: int | None = None,
    sum_rows: int = SUM_ROWS,
) -> DataFrame:
    """Top k per query by a sum over shared terms. ``weighed`` is a written ``weigh_terms``.

    Frequent terms pair almost every query with almost every item. Up to ``sum_rows`` such
    rows the sums are simply made; beyond it ``_pruned`` adds them on boards. Both give the
    same result; registered queries hold each against the same SQL.
    """
    asked = weighed.withColumn("_factor", F.col(signal.factor))
    rows = weighed.agg(F.sum("df")).first()[0] or 0
    if rows > sum_rows:
        return _pruned(asked, index, signal, k, limit)
    return in_blocks(
        asked.select("query_id", "term", "_factor"),
        "query_id",
        lambda block: top_k(_sums(block, index, signal.weight), k),
        limit,
    )


def _pruned(
    asked: DataFrame, index: Index, signal: TermSignal, k: int, limit: int | None
) -> DataFrame:
    """The same top k without adding weak terms where they cannot matter, on boards (``shelves``).

    1. Sums over each query's rarest terms: the k-th best is surely reached by k items, a floor.
    2. The weakest terms, which all together stay below a share of the floor, cannot lift an
       item there alone. They are added only for queries with an item on the shelf that could reach the floor with
       all of them. No pairs of queries and items are written but the best of each task.
    """
    slack = 1e-5
    own = Window.partitionBy("query_id")
    upward = own.rowsBetween(Window.unboundedPreceding, 0).orderBy
    asked = asked.withColumn("_cap", F.col("_factor") * F.col(signal.peak)).select(
        "query_id",
        "term",
        "_factor",
        "_cap",
        F.sum("df").over(upward("df", "term")).alias("_read"),
        F.sum("df").over(own).alias("_all"),
        F.row_number().over(own.orderBy("df", "term")).alias("_nth"),
    )
    asked = stage(asked, "asked")
    rare = asked.filter(
        (F.col("_nth") == 1) | (F.col("_read") <= F.greatest(F.lit(20 * k), F.col("_all") / 20))
    )
    reached = shelves.best_by_terms(rare, index, signal.weight, "_factor", k, limit)
    floor = (
        reached.groupBy("query_id")
        .agg((F.min("score") - slack).alias("_floor"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == k)
        .drop("_n")
    )
    weak = F.sum("_cap").over(upward("_cap", "term")) < WEAK_SHARE * F.col("_floor")
    marked = (
        lookup(asked, stage(floor, "floor"), "query_id", how="left", limit=limit)
        .withColumn("_weak", F.coalesce(weak, F.lit(False)))
        .withColumn("_rest", F.sum(F.when(F.col("_weak"), F.col("_cap")).otherwise(0.0)).over(own))
        .select("query_id", "term", "_factor", "_weak", "_rest", "_floor")
    )
    return top_k(shelves.best_above(stage(marked, "marked"), index, signal.weight, k, limit), k)


def sums_of_pairs(
    pairs: DataFrame,
    factors: DataFrame,
    index: Index,
    wanted: Mapping[str, tuple[str, str]],
    limit: int | None = None,
) -> DataFrame:
    """(query_id, image_id, *wanted): sums over shared terms for given pairs only.

    ``wanted`` names (weight, factor) columns of the postings and of ``factors``. Postings lie
    by image_id and stay there; the pairs come to them. Where the factors of all queries can
    be broadcast, every posting of a pair's item is looked up among them. Otherwise the pairs
    are spread over their query's terms first and joined on (image_id, term).
    """
    weights = sorted({w for w, _ in wanted.values()})
    terms = broadcast_if_small(factors.select("term").distinct(), limit)
    held = index.postings.select("image_id", "term", *weights).join(terms, "term", "left_semi")
    cap = broadcast_limit(factors) if limit is None else limit
    if measure(factors).bytes <= cap:
        met = held.join(pairs, "image_id").join(F.broadcast(factors), ["query_id", "term"])
    else:
        met = pairs.join(factors, "query_id").join(held, ["image_id", "term"])
    return met.groupBy("query_id", "image_id").agg(
        *[F.sum(F.col(w) * F.col(f)).alias(n) for n, (w, f) in wanted.items()]
    )


def text_search(
    query_terms: DataFrame, index: Index, k: int = 10, limit: int | None = None
) -> DataFrame:
    """BM25 over the postings of the asked terms."""
    return search_by_terms(stage(weigh_terms(query_terms, index, limit), "weighed"), index, TEXT, k, limit)


def search_by_terms(weighed: DataFrame, index: Index, signal: TermSignal, k: int, limit: int | None = None) -> DataFrame:
    """Top k per query by a sum over shared terms, shelf by shelf. ``weighed`` is a written ``weigh_terms``.

    Only postings of asked terms are read. The same result as ``best_by_terms``.
    """
    return top_k(shelves.best_by_terms(weighed, index, signal.weight, signal.factor, k, limit), k)


def context_search(
    turns: DataFrame, context: DataFrame, index: Index, k: int = 10, limit: int | None = None
) -> DataFrame:
    """(conv_id, turn, image_id, score, rank): BM25 of each turn's whole context, top k.

    ``turns`` are the searching turns (conv_id, segment, turn), ``context`` is (conv_id, segment, term, since). A
    term meets the postings once for its segment, at the first searching turn that has it; the turns of a segment are
    neighbours on a board, and each adds what the one before it has. A segment of many turns is cut into pieces of
    TURN_PIECE turn numbers; each piece begins with all terms said before.
    """
    segment = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("segment").cast("string"))
    said = stage(context.select(segment.alias("query_id"), "term", "since", F.lit(1).cast("long").alias("tf")), "said")
    weighed = weigh_terms(said.select("query_id", "term", "tf"), index, limit)
    asked = said.join(weighed.select("query_id", "term", "bm_idf"), ["query_id", "term"])

    piece = F.floor(F.col("turn") / TURN_PIECE)
    searching = turns.select(segment.alias("query_id"), piece.alias("piece"), "conv_id", "turn").distinct()
    blocks = shelves.blocks_for(turns.count())
    searching = searching.withColumn("qb", F.pmod(F.xxhash64("query_id", "piece"), F.lit(blocks)))
    own = Window.partitionBy("qb").orderBy("query_id", "piece")
    numbers = searching.withColumn("qn", F.row_number().over(own.orderBy("query_id", "piece", "turn")) - 1)
    numbers = stage(numbers.withColumn("chain", F.dense_rank().over(own)), "numbers")

    pieces = numbers.groupBy("query_id", "piece", "qb").agg(F.sort_array(F.collect_list(F.struct("turn", "qn"))).alias("_turns"))
    later = F.filter("_turns", lambda t: t["turn"] >= F.col("since"))
    none = F.lit(None).cast("double")
    placed = asked.join(pieces, "query_id").select("qb", F.get(later, F.lit(0))["qn"].alias("qn"), "term", F.col("bm_idf").alias("f1"), none.alias("f2"))
    chains = numbers.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("qn", F.col("chain").cast("double").alias("chain")))).alias("_q"))
    placed = placed.filter(F.col("qn").isNotNull())
    found = shelves.score(
        [shelves.shelf_rows(index), shelves.term_rows(placed, index, limit, [TEXT.weight])],
        [shelves.asked_terms(placed), chains.select(*shelves.asked(boards.CHAIN, qn="_q.qn", f1="_q.chain"))],
        boards.best_by_sum(k, "v1", "f1"),
        boards.TOP,
        lambda rows: shelves.best(rows, k),
    )
    named = shelves.named(found, numbers.select("qb", "qn", "conv_id", "turn"), limit)
    return top_k(named.select("conv_id", "turn", "image_id", "score"), k, by=("conv_id", "turn"))


def semantic_search(
    query_terms: DataFrame, index: Index, k: int = 10, limit: int | None = None
) -> DataFrame:
    """Cosine of TF-IDF vectors, over the postings of the asked terms."""
    return search_by_terms(stage(weigh_terms(query_terms, index, limit), "weighed"), index, SEMANTIC, k, limit)


def phrase_match(phrases: DataFrame, index: Index, limit: int | None = None) -> DataFrame:
    """(query_id, image_id, phrase): items whose tokens hold the phrase, in order and unbroken.

    ``phrases`` is (query_id, phrase), phrases of any length; one without a token matches nothing. No text is read: places
    of the phrases' terms come from ``index.spots``, and are met at the distances that the phrase has. Places are shuffled
    once, and phrases come to them in rounds of bounded size, with the queries that ask them, so that no hits are shuffled.
    """
    words = phrases.select("phrase").distinct().withColumn("_words", tx.tokens("phrase")).filter(F.size("_words") > 0)
    words = stage(words, "phrases")
    numbers = shelves.numbered(words, "phrase", PHRASE_BLOCK)
    said = words.join(broadcast_if_small(numbers, limit), "phrase")
    each = said.select("qb", "qn", F.posexplode("_words").alias("off", "term"))
    wanted = stage(each.select("term").distinct().withColumn("slot", slot_of(F.col("term"), index.slots)), "phrase-terms")
    terms = each.groupBy("qb", "term").agg(F.sort_array(F.collect_list(F.struct("qn", "off"))).alias("_q"))
    sizes = said.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("qn", F.size("_words").alias("size")))).alias("_q"))
    ints = F.lit(None).cast("array<int>")
    asked = terms.select("qb", "term", F.col("_q.qn").alias("qn"), F.col("_q.off").alias("off"), ints.alias("size"))
    asked = asked.unionByName(sizes.select("qb", F.lit(None).cast("string").alias("term"), F.col("_q.qn").alias("qn"), ints.alias("off"), F.col("_q.size").alias("size")))
    asks = phrases.select("query_id", "phrase").distinct()
    asks = stage(asks.join(broadcast_if_small(numbers, limit), "phrase"), "phrase-queries")
    rounds = max(math.ceil(measure(asks).bytes / shelves.SENT_BYTES), 1)
    turn = F.pmod("qb", F.lit(rounds)).cast("long")
    sent = shelves.packed_queries(asked.select(turn.alias("turn"), F.struct("qb", "term", "qn", "off", "size").alias("asked")))

    places = of_slots(index.spots, wanted).join(broadcast_if_small(wanted, limit), ["slot", "term"])
    longs = F.lit(None).cast("array<long>")
    rows = places.select("shelf", F.struct(longs.alias("ids"), "term", "place").alias("held"))
    rows = rows.unionByName(index.shelves.select("shelf", F.struct("ids", F.lit(None).cast("string").alias("term"), longs.alias("place")).alias("held")))
    tasks = shelves.tasks_for(index.shelves)
    together = shelves.neighbours(rows.select("shelf", F.array("held").alias("held")), tasks)
    together = shelves.packed_shelves(together, "places").coalesce(tasks)

    def found(r: int) -> DataFrame:
        hits = shelves.opened(together, sent, r).select("shelf", "held", "chunk", "asked").mapInArrow(boards.phrase_hits, boards.PHRASE_HIT)
        return hits.join(F.broadcast(asks.filter(turn == r)), ["qb", "qn"]).select("query_id", "image_id", "phrase")

    if rounds > MOST_ROUNDS:
        return shelves.in_rounds(found, rounds)
    return reduce(DataFrame.unionByName, [found(r) for r in range(rounds)])


# Slots of stored neighbourhood keys.
KEY_SLOTS = 64


def _key_slot() -> Column:
    return F.pmod("_key", F.lit(KEY_SLOTS)).cast("int")


def neighbour_keys(vocabulary: DataFrame) -> DataFrame:
    """(slot, _key, term): the keys of every term of three letters or more, stored in folders by slot."""
    known = vocabulary.select("term").filter(F.length("term") >= 3)
    keys = known.select(F.explode(tx.one_edit_keys("term")).alias("_key"), "term").withColumn("slot", _key_slot())
    return stage_parted(keys.repartition(KEY_SLOTS, "slot").sortWithinPartitions("_key"), "neighbours", "slot")


def fuzzy_terms(query_terms: DataFrame, vocabulary: DataFrame, limit: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(query_term, term): index terms within edit distance 1 that share three neighbouring letters.

    Both sides are keyed by the hashes of the term less one character. Two terms within
    distance 1 share a key, and a key is shared by few terms. With ``stored``, ``neighbour_keys`` of the vocabulary, only
    the folders of asked keys are read, and the vocabulary is not.
    """
    asked = query_terms.select(F.col("term").alias("query_term")).filter(
        F.length("query_term") >= 3
    )
    asked = asked.distinct().select("query_term", F.explode(tx.one_edit_keys("query_term")).alias("_key"))
    on = ["_key"]
    if stored is None:
        known = vocabulary.select("term").filter(F.length("term") >= 3)
        known = known.select("term", F.explode(tx.one_edit_keys("term")).alias("_key"))
    else:
        asked = stage(asked.withColumn("slot", _key_slot()), "asked-keys")
        known, on = of_slots(stored, asked), ["slot", "_key"]
    pairs = known.join(broadcast_if_small(asked, limit), on).select("query_term", "term")
    return (
        pairs.filter(F.levenshtein("query_term", "term", 1) >= 0)
        .filter(F.arrays_overlap(tx.trigrams("query_term"), tx.trigrams("term")))
        .distinct()
    )


def weights_of(images: DataFrame, index: Index, limit: int | None = None) -> DataFrame:
    """(image_id, term, w): TF-IDF vectors of the given items only."""
    wanted = broadcast_if_small(images.select("image_id").distinct(), limit)
    part = index.postings.join(wanted, "image_id", "left_semi").select("image_id", "term", "ltf")
    return lookup(part, index.terms.select("term", "idf"), "term", limit=limit).select(
        "image_id", "term", (F.col("ltf") * F.col("idf")).alias("w")
    )


def expand(
    query_terms: DataFrame, hits: DataFrame, index: Index, m: int = 5, t: int = 5
) -> DataFrame:
    """(query_id, term, tf, added): the query terms and the t heaviest new terms of the first m hits."""
    best = hits.filter(F.col("rank") <= m).select("query_id", "image_id")
    weights = weights_of(best, index)
    original = query_terms.select("query_id", "term").distinct()
    heavy = (
        best.join(weights, "image_id")
        .groupBy("query_id", "term")
        .agg(F.round(F.sum("w"), PLACES).alias("_w"))
        .join(original, ["query_id", "term"], "left_anti")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("_w").desc(), F.col("term"))
    added = heavy.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= t)
    kept = query_terms.groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))
    return kept.withColumn("added", F.lit(False)).unionByName(
        added.select("query_id", "term", F.lit(1).cast("long").alias("tf"), F.lit(True).alias("added"))
    )


def unit_queries(query_vecs: DataFrame) -> DataFrame:
    """(query_id, unit) of the queries that carry a vector."""
    sized = query_vecs.filter(F.col("query_vec").isNotNull()).withColumn(
        "_len", vx.norm(F.col("query_vec"))
    )
    return sized.filter("_len > 0").select(
        "query_id", vx.scaled(F.col("query_vec"), F.col("_len")).alias("unit")
    )


def _blocks(rows: int, size: int, least: int = 1) -> int:
    return max(math.ceil(rows / size), least, 1)


def _nearest(queries: DataFrame, items: DataFrame, on: Sequence[str], k: int) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    best = (
        queries.groupBy(*on)
        .cogroup(items.groupBy(*on))
        .applyInPandas(vx.best_in_block(k), f"query_id {kind}, image_id long, score double")
    )
    return top_k(best, k)


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """(ids, units): vectors in blocks of about VECTOR_BLOCK, by ascending ids; ``units`` one after the other.

    The index keeps such a table, ``facing``, so that a search need not make one.
    """
    block = F.pmod(F.xxhash64("image_id"), F.lit(_blocks(vectors.count(), VECTOR_BLOCK)))
    lists = vectors.groupBy(block.alias("vb")).agg(F.sort_array(F.collect_list(F.struct("image_id", "unit"))).alias("_list"))
    return stage(lists.select(F.col("_list.image_id").alias("ids"), F.flatten("_list.unit").alias("units")), "vector-blocks")


def vector_search(query_vecs: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k among (image_id, unit); see ``search_vector_blocks``."""
    return search_vector_blocks(query_vecs, vector_blocks(vectors), k)


def asked_blocks(query_vecs: DataFrame) -> tuple[DataFrame, int]:
    """((qb, queries, asked), number of blocks): unit vectors of queries in blocks of about QUERY_BLOCK, written."""
    units = stage(unit_queries(query_vecs), "unit_queries")
    n = _blocks(units.count(), QUERY_BLOCK)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    lists = units.groupBy(block.alias("qb")).agg(F.collect_list(F.struct("query_id", "unit")).alias("_list"))
    return stage(lists.select("qb", F.col("_list.query_id").alias("queries"), F.flatten("_list.unit").alias("asked")), "asked-blocks"), n


def block_pairs(blocks: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Every block of items once for each block of queries: numbers are exploded and joined on. A block of
    queries goes to a few tasks beside each other, so that blocks of items spread over all of them."""
    wide = max(blocks.sparkSession.sparkContext.defaultParallelism, 1)
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    left = blocks.withColumn("qb", F.explode(numbers)).withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(wide)))
    right = asked.withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    return left.join(broadcast_if_small(right), ["qb", "_lane"]).drop("_lane", "qb")


def search_vector_blocks(query_vecs: DataFrame, blocks: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k. ``blocks`` is (ids, units), as ``index.facing`` or ``vector_blocks``.

    Vectors are shuffled once. Queries come to them as broadcasts of bounded size (``shelves.score``); a block of queries and one of
    vectors are one product of matrices, and of all blocks of a task the k best of each query go on.
    """
    units = stage(unit_queries(query_vecs), "unit_queries")
    numbers = shelves.numbered(units)
    lists = units.join(broadcast_if_small(numbers), "query_id").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("qn", "unit"))).alias("_q"))
    asked = lists.select(*shelves.asked(boards.VECTORS, qn="_q.qn", f1=F.flatten("_q.unit")))
    # An id is in one block only, so that the first one names it.
    held = blocks.filter(F.size("ids") > 0).select(F.get("ids", F.lit(0)).alias("shelf"), "ids", "units")
    at = F.sequence(F.lit(0), F.size("ids") - 1)
    rows = [held.select(*shelves.held(boards.IDS, ids="ids")), held.select(*shelves.held(boards.VECTORS, at=at, v1="units"))]
    found = shelves.score(rows, [asked], boards.best_by_vectors(k), boards.TOP, lambda some: shelves.best(some, k))
    return top_k(shelves.named(found, numbers), k)


def vector_search_ann(
    query_vecs: DataFrame, centroids: DataFrame, cells: DataFrame, k: int = 10, nprobe: int = 4
) -> DataFrame:
    """Cosine top-k among the vectors of the ``nprobe`` cells nearest to the query.

    A cell with many vectors, or with many queries, is cut into blocks, so that no
    task gets a whole hot cell. ``nprobe`` = number of cells gives the exact result.
    """
    near = vector_search(
        query_vecs, centroids.select(F.col("cell").cast("long").alias("image_id"), "unit"), nprobe
    )
    probes = near.select("query_id", F.col("image_id").alias("cell"))
    # Both tables below hold one row per cell, and the number of cells is a parameter.
    wide = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).alias("_across"))
    tall = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_down"))
    grid = F.broadcast(wide.join(F.broadcast(tall), "cell"))
    left = (
        probes.join(grid, "cell")
        .join(unit_queries(query_vecs), "query_id")
        .select(
            "cell",
            "query_id",
            "unit",
            F.pmod(F.xxhash64("query_id"), F.col("_down")).alias("_qb"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_across") - 1)).alias("_vb"),
        )
    )
    right = cells.join(grid, "cell").select(
        "cell",
        "image_id",
        "unit",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_down") - 1)).alias("_qb"),
        F.pmod(F.xxhash64("image_id"), F.col("_across")).alias("_vb"),
    )
    return _nearest(left, right, ["cell", "_qb", "_vb"], k)


def measured_recall(query_vecs: DataFrame, centroids: DataFrame, cells: DataFrame, k: int = 10, sample: int = 1000) -> list[float]:
    """Recall of ``vector_search_ann`` against the exact search, for ``nprobe`` of 1, 2 and so on to all cells.

    Measured on about ``sample`` queries by a hash of their ids, or on all if there are fewer. An exact neighbour is
    found as soon as its cell is among those probed, so that one exact search gives all figures.
    """
    share = min(1.0, sample / max(query_vecs.count(), 1))
    asked = query_vecs.filter(F.shiftrightunsigned(F.xxhash64(F.lit(41), "query_id"), 33) <= int(share * 2**31))
    asked, places = stage(asked, "sampled-queries"), centroids.count()
    exact = vector_search(asked, cells, k).select("query_id", "image_id")
    near = vector_search(asked, centroids.select(F.col("cell").cast("long").alias("image_id"), "unit"), places)
    near = near.select("query_id", F.col("image_id").alias("cell"), F.col("rank").alias("probe"))
    found = exact.join(cells.select("image_id", "cell"), "image_id").join(near, ["query_id", "cell"])
    hits = {r["probe"]: r["n"] for r in found.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, so_far, recall = sum(hits.values()), 0, []
    for probe in range(1, places + 1):
        so_far += hits.get(probe, 0)
        recall.append(so_far / total if total else 1.0)
    return recall


def probes_for(
    query_vecs: DataFrame, centroids: DataFrame, cells: DataFrame, k: int = 10, least: float = 0.92, sample: int = 1000
) -> int:
    """The smallest ``nprobe`` with a measured recall of ``least``, which leaves room for what a sample can be off from 0.9."""
    recall = measured_recall(query_vecs, centroids, cells, k, sample)
    return 1 + next((i for i, r in enumerate(recall) if r >= least), len(recall) - 1)


def fit_cells(vectors: DataFrame, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(cell, center, unit) of n centroids, and (image_id, unit, cell) of every vector: the cell of the nearest center."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    featured = vectors.select("image_id", "unit", array_to_vector("unit").alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=10, predictionCol="cell").fit(featured)
    cells = model.transform(featured).select("image_id", "unit", F.col("cell").cast("long"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    raw = spark.createDataFrame(centers, "cell long, embedding array<double>")
    length = vx.norm(F.col("embedding"))
    return raw.select("cell", F.col("embedding").alias("center"), vx.scaled(F.col("embedding"), length).alias("unit")), cells


def fit_cells(vectors: DataFrame, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(cell, center, unit) of n centroids, and (image_id, unit, cell) of every vector: the cell of the nearest center."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    featured = vectors.select("image_id", "unit", array_to_vector("unit").alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=10, predictionCol="cell").fit(featured)
    cells = model.transform(featured).select("image_id", "unit", F.col("cell").cast("long"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    raw = spark.createDataFrame(centers, "cell long, embedding array<double>")
    length = vx.norm(F.col("embedding"))
    return raw.select("cell", F.col("embedding").alias("center"), vx.scaled(F.col("embedding"), length).alias("unit")), cells


@dataclass(frozen=True)
class Codes:
    """A stored approximate index: ``books`` (part, book) and ``codes`` (ids, codes), one byte for each part of a vector."""

    books: DataFrame
    codes: DataFrame

    def all_books(self) -> Column:
        """The codebooks of all parts as one array, a literal of bounded size in the plan."""
        lists = self.books.agg(F.sort_array(F.collect_list(F.struct("part", "book"))).alias("_b"))
        return lists.select(F.col("_b.book").alias("books")).scalar()


def fit_codes(blocks: DataFrame, vectors: DataFrame, parts: int = CODE_PARTS, entries: int = CODE_ENTRIES, sample: int = CODE_SAMPLE) -> Codes:
    """Codebooks and the codes of every vector, both written.

    For each part of the vectors k-means finds a codebook, on up to ``sample`` vectors, the first by a hash of their ids; there
    are as many parts as divide the vectors evenly, ``parts`` at most. ``blocks`` is (ids, units) of the same ``vectors``.
    """
    first = vectors.select(F.size("unit").alias("n")).first()
    parts = math.gcd(first["n"], parts) if first else parts
    key = F.xxhash64(F.lit(5), "image_id")
    share = min(1.0, 2.0 * sample / max(vectors.count(), 1))
    some = vectors.filter(F.shiftrightunsigned(key, 33) <= int(share * 2**31)).orderBy(key).limit(sample)
    cut = some.select(key.alias("key"), F.posexplode(vx.parts_of("unit", parts)).alias("part", "x"))
    books = stage(cut.groupBy("part").applyInArrow(boards.fitted_book(entries), "part int, book array<double>"), "codebooks")
    coded = Codes(books, blocks)
    made = blocks.select("ids", "units", coded.all_books().alias("books")).mapInArrow(boards.encoded, "ids array<long>, codes binary")
    return Codes(books, stage(made, "codes"))


def search_codes(query_vecs: DataFrame, coded: Codes, vectors: DataFrame, k: int = 10, rescored: int = RESCORED) -> DataFrame:
    """Cosine top-k, approximate: codes are read in place of vectors, and the ``rescored`` * k best by code are scored exactly.

    Every item has a code and every code is looked at. The score of a code is a sum of entries of one table
    for each query, its products with all entries of the codebooks.
    """
    asked, n = asked_blocks(query_vecs)
    asked = asked.withColumn("books", coded.all_books())
    kind = query_vecs.schema["query_id"].dataType.simpleString()
    best = block_pairs(coded.codes, asked, n).mapInArrow(boards.best_codes(k * rescored), f"query_id {kind}, image_id long, score double")
    pairs = top_k(best, k * rescored).select("query_id", "image_id")
    units = unit_queries(query_vecs).withColumnRenamed("unit", "_asked")
    held = pairs.join(vectors.select("image_id", "unit"), "image_id").join(broadcast_if_small(units), "query_id")
    return top_k(held.select("query_id", "image_id", vx.dot(F.col("unit"), F.col("_asked")).alias("score")), k)


def field_value(field: Column) -> Column:
    """The value a record has for a named field: its source, or an entry of ``meta``."""
    return F.when(field == "source", F.col("source")).otherwise(
        F.try_element_at(F.col("meta"), field)
    )


def metadata_filter(records: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Records that have every wanted value. An unknown value does not pass."""
    for name, value in wanted.items():
        have = F.col(name) if name in records.columns else F.try_element_at(F.col("meta"), F.lit(name))
        records = records.filter(have == value)
    return records


def passing_pairs(
    pairs: DataFrame, query_filters: DataFrame, records: DataFrame, limit: int | None = None
) -> DataFrame:
    """The (query_id, image_id) pairs whose record meets every filter of the query."""
    asked = (
        pairs.join(broadcast_if_small(query_filters, limit), "query_id")
        .join(records.select("image_id", "source", "meta"), "image_id")
        .select("query_id", "image_id", (field_value(F.col("field")) == F.col("value")).alias("_ok"))
    )
    failed = asked.filter(~F.coalesce("_ok", F.lit(False))).select("query_id", "image_id").distinct()
    return pairs.join(failed, ["query_id", "image_id"], "left_anti")


def metadata_score(
    pairs: DataFrame, query_filters: DataFrame, records: DataFrame, limit: int | None = None
) -> DataFrame:
    """(query_id, image_id, score): share of the known requested fields that match.

    NULL when none of them is known. Pairs of a query without filters are left out.
    """
    asked = (
        pairs.join(broadcast_if_small(query_filters, limit), "query_id")
        .join(records.select("image_id", "source", "meta"), "image_id")
        .withColumn("_have", field_value(F.col("field")))
    )
    match = F.when(
        F.col("_have").isNotNull(), F.when(F.col("_have") == F.col("value"), 1.0).otherwise(0.0)
    )
    return asked.groupBy("query_id", "image_id").agg(F.avg(match).alias("score"))


def matched_fields(
    pairs: DataFrame, query_filters: DataFrame, records: DataFrame, limit: int | None = None
) -> DataFrame:
    """(query_id, image_id, field, value): the requested fields whose value the item has."""
    return (
        pairs.select("query_id", "image_id")
        .join(broadcast_if_small(query_filters, limit), "query_id")
        .join(records.select("image_id", "source", "meta"), "image_id")
        .filter(field_value(F.col("field")) == F.col("value"))
        .select("query_id", "image_id", "field", "value")
        .distinct()
    )


def matched_clues(
    pairs: DataFrame, query_clues: DataFrame, hits: DataFrame, limit: int | None = None
) -> DataFrame:
    """(query_id, image_id, slot, value): the query's clues found in the item. ``hits`` is ``clue_hits``."""
    asked = pairs.select("query_id", "image_id").join(broadcast_if_small(query_clues, limit), "query_id")
    return asked.join(hits, ["value", "image_id"]).select("query_id", "image_id", "slot", "value").distinct()


def sets_of(long: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, set_id) and (set_id, *columns): queries that ask the same share one set."""
    entry = F.struct(*columns)
    keyed = long.groupBy("query_id").agg(F.sort_array(F.collect_set(entry)).alias("_set"))
    keyed = keyed.withColumn("set_id", F.sha2(F.to_json("_set"), 256))
    members = keyed.groupBy("set_id").agg(F.any_value("_set").alias("_set"))
    return keyed.select("query_id", "set_id"), members


def metadata_best(query_filters: DataFrame, index: Index, n: int, limit: int | None = None) -> DataFrame:
    """The same as ``metadata_top``, from what the index holds: of the profiles only those with an asked value, of
    their items only the first n, and of the profiles of a filter set, by score, only as many as n items take."""
    if n > FIRSTS:
        return metadata_top(query_filters, index.items, n, limit)
    to_set, members = sets_of(query_filters, ["field", "value"])
    members = stage(members, "filter_sets")
    scored = profile_scores(members, index.firsts.select("profile", "known"), limit, index.fields)
    listed = scored.join(index.firsts.select("profile", F.slice("ids", 1, n).alias("ids")), "profile")
    # All items of better profiles come before: a profile counts only if those hold fewer than n.
    own = Window.partitionBy("set_id")
    placed = listed.withColumn("_place", F.dense_rank().over(own.orderBy(F.round("score", PLACES).desc())))
    before = F.sum(F.size("ids")).over(own.orderBy("_place").rangeBetween(Window.unboundedPreceding, -1))
    open_ = placed.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < n)
    best = top_k(open_.select("set_id", "score", F.explode("ids").alias("image_id")), n, by=("set_id",))
    return to_set.join(best, "set_id").select("query_id", "image_id", "score", "rank")


def profile_scores(members: DataFrame, profiles: DataFrame, limit: int | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(set_id, profile, score) above 0, for filter sets (``sets_of``) and (profile, known).

    ``fields``: the stored (slot, field, value, profile) of the profiles, of which only the asked slots are read.
    """
    on, asked = ["field", "value"], members.select("set_id", F.inline("_set"))
    if fields is None:
        fields = profiles.select("profile", F.explode("known").alias("field", "value"))
    else:
        on, asked = ["slot", *on], asked.withColumn("slot", field_slot())
        fields = of_slots(fields, asked)
    matches = (
        fields.join(broadcast_if_small(asked, limit), on)
        .groupBy("set_id", "profile")
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    wanted = F.transform("_set", lambda f: f["field"])
    return (
        matches.join(profiles, "profile")
        .join(members, "set_id")
        .withColumn("_known", F.size(F.filter(wanted, lambda f: F.map_contains_key("known", f))))
        .select("set_id", "profile", (F.col("_hits") / F.col("_known")).alias("score"))
    )


def metadata_top(
    query_filters: DataFrame, records: DataFrame, n: int, limit: int | None = None
) -> DataFrame:
    """Top n per query by metadata score above 0, ties by image_id.

    Records with the same metadata score the same, and queries with the same filters
    get the same answer. So distinct filter sets are matched with distinct metadata,
    each standing for its n lowest ids, and only the answer is spread to the queries.
    """
    to_set, members = sets_of(query_filters, ["field", "value"])
    members = stage(members, "filter_sets")
    ranked = Window.partitionBy("profile").orderBy("image_id")
    lowest = (
        records.select("image_id", profile_of().alias("profile"), known_fields().alias("known"))
        .withColumn("_n", F.row_number().over(ranked))
        .filter(F.col("_n") <= n)
    )
    lowest = stage(lowest, "profiles")
    scored = profile_scores(members, lowest.filter("_n = 1").select("profile", "known"), limit)
    best = top_k(scored.join(lowest.select("profile", "image_id"), "profile"), n, by=("set_id",))
    return to_set.join(best.select("set_id", "image_id", "score", "rank"), "set_id").select(
        "query_id", "image_id", "score", "rank"
    )


def clue_terms(query_clues: DataFrame) -> DataFrame:
    """(value, term, n): the distinct clue values, their terms and how many those are."""
    words = F.array_distinct(tx.tokens("value"))
    return (
        query_clues.select("value")
        .distinct()
        .select("value", F.size(words).alias("n"), F.explode(words).alias("term"))
    )


def clue_hits(
    query_clues: DataFrame, index: Index, limit: int | None = None
) -> DataFrame:
    """(value, image_id): clue values found in an item.

    A value is found when all its terms are in the item's text, or when it equals the
    item's source or one of its metadata values, whatever the case. Where the index has lists of postings, only those of asked terms are
    read, and the metadata profiles; they are not written for this: without them texts and metadata are read once.
    """
    values = query_clues.select("value").distinct().withColumn("_lower", F.lower("value"))
    if not index.has_lists:
        return _clues_in_items(stage(clue_terms(query_clues), "clue-terms"), values, index.source, limit)
    asked = stage(clue_terms(query_clues).withColumn("slot", slot_of(F.col("term"), index.slots)), "clue-terms")
    lists = of_slots(index.blocks, asked).select("slot", "term", "shelf", "at").join(broadcast_if_small(asked, limit), ["slot", "term"])
    met = lists.groupBy("shelf", "value", "n").agg(F.collect_list("at").alias("_lists")).filter(F.size("_lists") == F.col("n"))
    common = F.aggregate("_lists", F.get("_lists", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    in_text = met.select("shelf", "value", common.alias("at")).filter(F.size("at") > 0)
    held = index.sides.select("shelf", "at", F.explode(_lowered("known")).alias("_lower"))
    in_meta = held.join(broadcast_if_small(values, limit), "_lower").select("shelf", "value", "at")
    places = in_text.unionByName(in_meta).join(index.shelves, "shelf")
    return places.select("value", F.explode(F.transform("at", lambda i: F.get("ids", i))).alias("image_id")).distinct()


def _lowered(known: Column | str) -> Column:
    """The distinct values of a map, in lower case."""
    return F.array_distinct(F.transform(F.map_values(known), lambda v: F.lower(v)))


def _clues_in_items(asked: DataFrame, values: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """``clue_hits`` from the items themselves: what is shuffled are met values, a row for each item and value of a task."""
    named = items.filter(F.col("image_id").isNotNull())
    words = named.select("image_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("term"))
    met = words.join(broadcast_if_small(asked, limit), "term").groupBy("image_id", "value", "n").agg(F.collect_set("term").alias("_terms"))
    in_text = met.filter(F.size("_terms") == F.col("n")).select("value", "image_id")
    held = named.select("image_id", F.explode(_lowered(known_fields())).alias("_lower"))
    in_meta = held.join(broadcast_if_small(values, limit), "_lower").select("value", "image_id")
    return in_text.unionByName(in_meta).distinct()


def clue_score(
    pairs: DataFrame, query_clues: DataFrame, hits: DataFrame, limit: int | None = None
) -> DataFrame:
    """(query_id, image_id, score): share of the query's clues found in the item."""
    clues = query_clues.select("query_id", "slot", "value").distinct()
    asked = pairs.join(broadcast_if_small(clues, limit), "query_id")
    found = hits.withColumn("_hit", F.lit(1.0))
    return (
        asked.join(found, ["value", "image_id"], "left")
        .groupBy("query_id", "image_id")
        .agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("score"))
    )


def clue_top(
    query_clues: DataFrame, hits: DataFrame, n: int, limit: int | None = None
) -> DataFrame:
    """Top n per query by clue score above 0, ties by image_id.

    Queries with the same clues share one answer, and items in which the same clues are found score the same: each
    such group stands for its n lowest ids, so that sets of clues meet groups, not items. ``hits`` is ``clue_hits``.
    """
    to_set, members = sets_of(query_clues, ["slot", "value"])
    asked = members.select("set_id", F.size("_set").alias("_n"), F.inline("_set"))
    grouped = hits.groupBy("image_id").agg(F.sort_array(F.collect_set("value")).alias("_values"))
    order = Window.partitionBy("_values").orderBy("image_id")
    lowest = grouped.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n)
    lowest = stage(lowest.groupBy("_values").agg(F.collect_list("image_id").alias("ids")), "clue_groups")
    groups = lowest.select(F.sha2(F.to_json("_values"), 256).alias("group"), "_values", "ids")
    scored = (
        groups.select("group", F.explode("_values").alias("value"))
        .join(broadcast_if_small(asked, limit), "value")
        .groupBy("set_id", "group", "_n")
        .agg(F.count(F.lit(1)).alias("_found"))
        .join(groups.select("group", "ids"), "group")
        .select("set_id", F.explode("ids").alias("image_id"), (F.col("_found") / F.col("_n")).alias("score"))
    )
    best = top_k(scored, n, by=("set_id",))
    return to_set.join(best.select("set_id", "image_id", "score", "rank"), "set_id").select(
        "query_id", "image_id", "score", "rank"
    )
