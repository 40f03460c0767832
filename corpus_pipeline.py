"""From documents to a sharded training mix: stages that each work on all the one before kept.

All stages but the last return the columns of their input as they are, whatever other columns there are and whatever
their names (mixing cuts texts, and n_chars with them). Any column can be NULL. Empty tables go through and stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm import decontam, language, mixing, sharding, similar
from recollect.llm.common import table
from recollect.sources.tables import stage

SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the given ones name; those without letters go, and those like none of the languages.

    NULL and empty texts have no letter. Repeated rows, and rows of one text, are judged alike.
    """
    model = language.train(docs, F.lit(True))
    # The documents travel as one column, so that nothing of theirs is taken for what is added.
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    marked = language.with_language(held, model, familiar_col="familiar")
    sure = (F.col("lang_pred") != language.UNDETERMINED) & F.col("familiar")
    return marked.filter(sure).select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike or more.

    The one of the smallest id stays, NULL last; texts without a word are one group; of rows equal in all columns one stays.
    """
    return similar.one_of_each_group(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    NULL and empty texts and items match nothing. Rows equal in id and text are judged alike.
    """
    return decontam.without_copies(docs, table(spark, sf_dir, "benchmark"))


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often and as far as it takes them.

    NULL and empty texts have no words and go; a NULL source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document of the mix.

    NULL texts count as empty, NULL ids share a place, and repeated rows are numbered one after the other.
    """
    return sharding.assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_by_weight),
    ("sharding", put_into_shards),
]

# Models, fingerprints and draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
