"""One query for each operator, over its whole table; ``ORACLE_SQL`` where SQL can say the same.

Each query gives one row for each row of its table (op3: for each document and item it copies; op5: for each query and
place; op11: for each word), also for repeated rows and NULL ids, and none for an empty table. Columns beyond those
that are named are not looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm import (
    codes,
    decontam,
    language,
    mixing,
    quality,
    rules,
    sharding,
    simhash,
    spelling,
    substrings,
    suffixes,
    topk,
    twins,
    warc,
)
from recollect.llm.common import table
from recollect.sources.tables import shared_dir

SHARDS = 8


def op1_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. A NULL text counts as empty, NULL ids share a place on the ring, equal rows are numbered one after the other."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back. A NULL html is an empty payload; of repeated pages one at most is the response."""
    path = f"{shared_dir(spark)}/recollect/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.parse_records(warc.read_records(spark, path))
    # The declared digest stands only where it is that of the payload that was read.
    return records.select(
        "page_id",
        "payload_bytes",
        F.when(F.col("intact"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_benchmark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they copy. Texts and items that are NULL, empty or without a word match nothing; ties go to the first window."""
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. NULL and empty texts have none; a NULL source is a source, the last; repeated rows count each."""
    documents, pieces = mixing.mix_sources(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "uid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def op5_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query. Vectors that are NULL or hold NULL or non-finite components take no part; ties go to the smaller id, a NULL id last."""
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def op6_byte_network_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. NULL and empty texts are scored as no bytes; equal texts score the same; without labels scores lie near the middle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    net = quality.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = quality.with_quality(docs, net)
    held_out = F.coalesce(fold == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Texts that are NULL or without a letter are "und" with score 0; equal texts score the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.train(docs, fold != 2)
    scored = language.with_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_anchor_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Texts without a word (NULL, empty) are one component; NULL ids name none."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings. NULL, empty and short texts lose nothing; repeated rows are documents of their own."""
    return suffixes.repeated_strings(table(spark, sf_dir, "documents"), 200).drop("spans")


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows that start earlier as well. NULL ids come last; equal ids by a hash of their texts."""
    return substrings.repeated_windows(table(spark, sf_dir, "documents"), 20).drop("spans")


def op11_pivotal_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their forms; see ``spelling.group_spellings`` for NULLs, ties, repeated rows and empty tables."""
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op12_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; see ``rules.with_verdict`` for NULLs, ties, repeated rows and empty tables."""
    judged = rules.with_verdict(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op13_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector; see ``codes.encode_vectors`` for NULLs, ties, repeated rows and empty tables."""
    coded, books = codes.encode_vectors(table(spark, sf_dir, "embeddings"))
    judged = codes.with_label_error(coded).withColumn("codebooks_sha256", codes.digest(books))
    return judged.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_consistent_hash_shards,
        op2_warc_archive,
        op3_benchmark_copies,
        op4_weighted_mix,
        op5_dual_tree_top_k,
        op6_byte_network_quality,
        op7_string_kernel_language,
        op8_anchor_near_duplicates,
        op9_prefix_doubling,
        op10_repeated_windows,
        op11_pivotal_spellings,
        op12_rule_cascade,
        op13_limb_codes,
    )
}

# Models, fingerprints and block-wise draws are beyond SQL; tests/llm holds those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_pivotal_spellings": twins.SPELLINGS,
    "op12_rule_cascade": twins.RULES,
    "op13_limb_codes": twins.CODES,
}
