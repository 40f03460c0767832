"""Mixing sources to target weights.

The words of each source are laid end to end and cut into blocks of fixed length. The target of
a source says how many block slots it gets; how many of them fall into each output shard is a
multinomial draw. A slot is mapped through the source's own pseudorandom permutation of block
indexes, one for each pass, and the blocks are joined by index. Totals are fixed before the
draw, so that a source meets its target to the word and not just on average: the draw is the
multinomial conditioned on them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from recollect.llm.common import WORD, running_totals, word_count
from recollect.sources.tables import stage

BLOCK_WORDS = 512
SLOTS_PER_ROW = 65_536  # slots made by one row, so that the slots of a large source are spread
ROUNDS = 4
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function, for the rounds of the permutation."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key & _MASK)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``index`` under a permutation of range(n) chosen by ``key``.

    A Feistel network over the next even power of two; images outside the range go through it
    again, until they fall inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * ROUNDS + r) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, parts: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources take the ``weights`` in turn, by code point, NULL last. Together they get ``share``
    of all sizes; a source stops at ``most`` times its size and what it leaves is shared anew by
    weight. That is min(most * size, level * weight), where the level is found by putting the
    sources in order of the level at which they stop.
    """
    ones = sizes.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(ones, [F.col("source").asc_nulls_last()], "_one", "_rank", parts, "source-ranks")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.get(table, (F.col("_rank") % len(weights)).cast("int")))
    stops = ranked.withColumn("_stop", F.col("source_size") * most / F.col("_weight"))
    order = [F.col("_stop"), F.col("_rank")]
    by_cap = running_totals(stops, order, "source_size", "_size_before", parts, "source-stops")
    weight_units = by_cap.withColumn("_w", F.round(F.col("_weight") * 1_000_000).cast("long"))
    levels = running_totals(weight_units, order, "_w", "_w_before", parts, "source-levels")
    whole = levels.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    # The level if exactly the sources before this one stop: right for the first source that does not reach its own stop.
    level_here = (F.lit((whole["size"] or 0) * share) - F.col("_size_before") * most) / (
        (F.lit(whole["w"] or 0) - F.col("_w_before")) / 1_000_000.0
    )
    reached = levels.withColumn("_level", level_here).filter("_level <= _stop")
    first = reached.agg(F.min_by("_level", F.struct("_stop", "_rank")).alias("level")).first()
    level = float("inf") if first["level"] is None else float(first["level"])
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("_weight") * F.lit(level))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shards: int = 8,
    seed: int = 42,
    parts: int | None = None,
    uid_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of ``docs`` (doc_id, text, source; other columns are ignored).

    documents: uid, doc_id, size, source_size, target, one row for each row of ``docs``. ``uid_col`` names
    a LONG column that tells the rows of a written table apart; without it rows are numbered.
    pieces: shard, slot, uid, epoch, first_word, words: which words of which document stand in
    which block slot of which output shard. A word is taken at most ceil(``most``) times.

    NULL and empty texts have no words and no pieces; a NULL source is a source of its own, the
    last. Repeated rows are documents of their own. Row order and partitioning do not matter: documents
    lie in their source by a hash of their content. Empty tables give empty results.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = stage(
        docs.select(
            (F.col(f"`{uid_col}`") if uid_col else F.monotonically_increasing_id()).alias("uid"),
            F.col("doc_id"),
            F.col("source"),
            word_count("text").alias("size"),
            F.xxhash64("doc_id", "text").alias("_order"),
        ),
        "mix-documents",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most, min(parts, 32))
    placed = running_totals(
        sized, [F.col("source").asc_nulls_last(), F.col("_order"), F.col("doc_id")], "size", "_before", parts, "mix-order"
    )
    starts = placed.groupBy("source").agg(F.min("_before").alias("_start"), F.sum("size").alias("source_size"))
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))
    sources = stage(
        starts.alias("a")
        .join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.source", "a.source_size", "target", "_start")
        .withColumn("_key", key),
        "mix-sources",
    )
    small = F.broadcast if sources.count() <= 100_000 else lambda df: df
    with_source = (
        placed.alias("d")
        .join(small(sources.alias("s")), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.uid", "d.doc_id", "d.size", "d._before", "s.source_size", "s.target", "s._start", "s._key")
    )
    documents = with_source.select("uid", "doc_id", "size", "source_size", "target")

    # Blocks by index: the words that each document gives to each block it lies in.
    offset = F.col("_before") - F.col("_start")
    laid = with_source.filter("size > 0").select("uid", "size", "_key", offset.alias("_off"))
    last = F.floor((F.col("_off") + F.col("size") - 1) / block_words)
    in_blocks = laid.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_off") / block_words), last)))
    from_word = F.greatest(F.col("_block") * block_words - F.col("_off"), F.lit(0))
    to_word = F.least((F.col("_block") + 1) * block_words - F.col("_off"), F.col("size"))
    in_blocks = in_blocks.select(
        "_key",
        "_block",
        "uid",
        from_word.alias("_from"),
        to_word.alias("_to"),
        (F.col("_off") + from_word - F.col("_block") * block_words).alias("_at"),
    )
    slots = _slots(sources, block_words, shards, seed)
    kept = F.least(F.col("_to") - F.col("_from"), F.col("_words") - F.col("_at"))
    # By sorting: the planner takes the slots to be as few as the sources, and would broadcast them.
    pieces = (
        in_blocks.join(slots.hint("merge"), ["_key", "_block"])
        .select("shard", F.xxhash64("_key", "slot").alias("slot"), "uid", "epoch", F.col("_from").alias("first_word"), kept.alias("words"))
        .filter("words > 0")
    )
    return documents, pieces


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row of the columns of ``docs`` for each document and pass that takes words of it.

    Where a pass takes all words the text stays as it is; else it is the taken words, joined by
    blanks. n_chars, if there is such a column, is that of the new text. Documents of which no
    word is taken go. ``how``: see ``mix_sources``.
    """
    own = ("doc_id", "text", "source")
    others = [c for c in docs.columns if c not in own]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    # All other columns travel as one, so that their names meet none of ours.
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("uid"), *own, rest.alias("rest")), "mix-input")
    documents, pieces = mix_sources(keyed, uid_col="uid", **how)
    spans = pieces.groupBy("uid", "epoch").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("spans")
    )
    sizes = documents.select("uid", "size")
    spans = spans.join(sizes, "uid").drop("epoch")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.transform("spans", lambda s: F.slice(words, (s["first_word"] + 1).cast("int"), s["words"].cast("int")))
    whole = F.col("taken") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.flatten(cut), " "))
    made = keyed.join(spans, "uid").withColumn("text", text)
    held = {c: F.col(c) for c in own} | {c: F.col("rest")[c] for c in others}
    if "n_chars" in others:
        held["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.select(*[held[c].alias(c) for c in docs.columns])


def _slots(sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """(_key, _block, epoch, slot, shard, _words): which block each slot takes and how much of it.

    The last pass of a source may be partial: its last slot takes the words still wanted from
    the head of its block. The short block at the end of a source comes last in every pass.
    """
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("_key", "_block", "epoch", "slot", "shard", "_words")]
    )
    wanted = sources.filter("target > 0").select(
        "_key", F.col("source_size").alias("n"), F.round("target").cast("long").alias("want")
    )
    blocks = F.ceil(F.col("n") / block_words)
    rest = F.col("want") % F.col("n")
    count = F.floor(F.col("want") / F.col("n")) * blocks + F.ceil(rest / block_words)
    chunks = (
        wanted.withColumn("blocks", blocks)
        .withColumn("count", count)
        .filter("count > 0")
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(SLOTS_PER_ROW).cast("long"))))
        .repartition("_key", "first")
    )

    def made(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                key, n, want, blocks, count = int(r[0]), int(r.n), int(r.want), int(r.blocks), int(r.count_)
                # The draw is the source's own and the same in each of its rows.
                draw = np.random.Generator(np.random.PCG64([key & _MASK, seed]))
                ends = np.cumsum(draw.multinomial(count, [1 / shards] * shards))
                slot = np.arange(int(r.first), min(int(r.first) + SLOTS_PER_ROW, count), dtype=np.int64)
                epoch, k = slot // blocks, slot % blocks
                full = n // block_words
                block = k.copy()
                for e in np.unique(epoch):
                    at = (epoch == e) & (k < full)
                    block[at] = permuted(k[at], full, (key ^ int(e) * 0x9E3779B97F4A7C15 ^ seed) & _MASK)
                left = np.maximum(want - epoch * n - k * block_words, 0)
                yield pd.DataFrame(
                    {
                        "_key": key,
                        "_block": block,
                        "epoch": epoch,
                        "slot": slot,
                        "shard": np.searchsorted(ends, slot, side="right"),
                        "_words": np.minimum(left, block_words),
                    }
                )

    return chunks.withColumnRenamed("count", "count_").mapInPandas(made, schema)
