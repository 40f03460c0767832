"""Test conventions: the given tables read as items, vectors, turns and history.

documents + embeddings  -> items (an item has a vector where vec_id = doc_id)
conversations           -> turns; the text of a user turn gets a spoken opening, chosen
                           by the numbers of turn and conversation, since the texts themselves name no intent
every user turn         -> a query, its id conv_id * 1000 + turn; its vector is the one with
                           vec_id = conv_id, its filters are language and source of the
                           document with doc_id = conv_id
events                  -> the history a user supplies
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.functions import text as tx
from recollect.operators import conversation as cv
from recollect.operators.ranking import QuerySet, hybrid_search, prepare
from recollect.operators.retrieval import Codes, fit_cells, fit_codes, neighbour_keys
from recollect.plans.index import Index, build_index
from recollect.sources.archive import normalize, scan_archive
from recollect.sources.tables import stage

DIM = 64

# Openings, and the lexicon of the clue tests. Its values are
# words that occur in the given texts.
OPENINGS = (
    "Find the handwritten notes about ",
    "Show me the screenshot of ",
    "No, I remember it was on a dark background, ",
    "The one with the large diagram and ",
    "Why did you show me this? ",
    "Summarize these. ",
    "Create a plan for 3 days. ",
    "Schedule this. ",
    "Which screenshot had ",
    "Do you remember the meme about ",
    "Thanks, that helps. ",
    "Hi! How did that receipt look with ",
)
LEXICON = (
    ("handwritten notes", "type", "notes"),
    ("screenshot", "type", "screenshot"),
    ("dark background", "appearance", "dark"),
    ("it was on a dark background", "appearance", "was on"),
    ("large diagram", "visual", "diagram"),
    ("that", "topic", "that"),
    ("this", "topic", "this"),
    ("was", "context", "was"),
    ("nicht", "context", "nicht"),
    ("tion", "text", "tion"),
    ("from", "text", "from the"),
    ("by", "source", "src1"),
    ("des", "source", "src2"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_archive(spark, f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"),
        "source",
        F.create_map(F.lit("lang"), F.col("lang")).alias("meta"),
        "text",
    )
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    return normalize(docs.join(vecs, "image_id", "full"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    spoken = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("turn") + F.col("conv_id") % 3 * 4) % len(OPENINGS) + 1).cast("int"))
    raw = table(spark, sf, "conversations")
    text = F.when(F.col("role") == "user", F.concat(spoken, F.col("text"))).otherwise(F.col("text"))
    return raw.select("conv_id", "turn", "role", text.alias("text"))


# Ids of queries: a conversation has fewer turns than this.
TURNS = 1000


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, conv_id, turn, text): every user turn as it stands."""
    said = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return said.select((F.col("conv_id") * TURNS + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")


def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = user_turns(spark, sf).select("query_id", F.explode(tx.tokens("text")).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_vecs(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("query_vec"))
    return user_turns(spark, sf).join(vecs, "conv_id").select("query_id", "query_vec")


def query_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "lang", "source")
    pair = F.array(
        F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")),
        F.struct(F.lit("source").alias("field"), F.col("source").alias("value")),
    )
    return user_turns(spark, sf).join(docs, "conv_id").select("query_id", F.inline(pair))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "phrase string, slot string, value string")


def query_clues(spark: SparkSession, sf: str) -> DataFrame:
    said = user_turns(spark, sf).select(
        F.col("query_id").alias("conv_id"), "turn", F.lit(0).cast("long").alias("segment"), "text"
    )
    return cv.extract_clues(said, lexicon(spark)).select(
        F.col("conv_id").alias("query_id"), "slot", "value"
    )


def queries(spark: SparkSession, sf: str) -> QuerySet:
    return QuerySet(
        terms=query_terms(spark, sf),
        vecs=query_vecs(spark, sf),
        filters=query_filters(spark, sf),
        clues=query_clues(spark, sf),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("kind"),
    )


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written out as the texts of receipts: dates in three forms, and one that is none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(
        F.lit("Receipt for order "),
        F.col("o_orderkey").cast("string"),
        F.lit(". Please pay by "),
        day,
        F.lit(". Do not mix up with 2024-13-"),
        F.date_format("o_orderdate", "dd"),
        F.lit("! Delivered "),
        F.date_format("o_orderdate", "d MMMM yyyy"),
        F.lit(". Due "),
        F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("."),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), text.alias("text"))


# Index and scored candidates are written tables, made once per session and data folder.


@lru_cache(maxsize=None)
def index(spark: SparkSession, sf: str) -> Index:
    return build_index(items(spark, sf), DIM)


@lru_cache(maxsize=None)
def codes(spark: SparkSession, sf: str) -> Codes:
    return fit_codes(index(spark, sf).facing, index(spark, sf).vectors)


@lru_cache(maxsize=None)
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_keys(index(spark, sf).known)


@lru_cache(maxsize=None)
def cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Centroids, and the vectors with their cells."""
    centroids, held = fit_cells(index(spark, sf).vectors, 16)
    return stage(centroids, "centroids"), stage(held, "cells")


@lru_cache(maxsize=None)
def prepared(spark: SparkSession, sf: str):
    """What scoring needs of all user turns."""
    return prepare(queries(spark, sf), index(spark, sf))


@lru_cache(maxsize=None)
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search of all user turns: the first ten of each."""
    return stage(hybrid_search(prepared(spark, sf), index(spark, sf)), "ranked")


@lru_cache(maxsize=None)
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with intent and segment."""
    return stage(cv.segment_searches(cv.label_intent(turns(spark, sf))), "labelled")
