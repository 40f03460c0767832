"""Benchmark decontamination: windows of item size, compared by SimHash and then exactly.

Texts are lower-cased runs of letters and digits, in shingles of five words. For a benchmark item
of L words, every window of L words of a document is a possible copy. Windows and items are similar to
the degree of their weighted shingles (Jaccard over multisets), copies from ``similarity`` on.

1. Windows are fingerprinted where they start at a shingle of the item and hold as many shingles of it as a
   copy must; the best window starts so. Nothing is lost by either.
2. The SimHash of each such window and of each item is cut into blocks. Two fingerprints within
   ``radius`` bits agree in at least one block up to radius // blocks bits: the item states every
   block value within that reach, the window its own, and they meet by equal block values.
3. For pairs within ``radius``, and for no others, the shared weight is worked out, and with it the exact similarity.

An item shorter than a shingle is one shingle of its own length, and so are the windows of that length.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.bounds import broadcast_if_small
from recollect.llm.common import free_name
from recollect.sources.tables import stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8  # of eight bits each
BITS = 64
GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for NULL."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words by start; of the whole sequence if it is shorter; none without words."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(SHINGLE)]))
        return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    # One pass: the words are bound to a name, not cut again at each use.
    return F.transform(F.array(hashed), of)[0]


def simhash(hashes: Column) -> Column:
    """SimHash of an array of hashes: a bit is 1 if it is in over half of them."""
    one = F.lit(1).cast("long")

    def bit(h: Column, i: Column) -> Column:
        return F.call_function("shiftrightunsigned", h, i).bitwiseAND(one).cast("int")

    counts = F.aggregate(
        hashes, F.array_repeat(F.lit(0), BITS), lambda acc, h: F.transform(acc, lambda c, i: c + bit(h, i))
    )
    half = F.size(hashes)
    set_ = F.transform(counts, lambda c, i: F.when(c * 2 > half, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def block_values(fp: Column, reach: int) -> Column:
    """(block, value) for every block of the fingerprint and every value within ``reach`` bits of its own."""
    width = BITS // BLOCKS
    masks = F.array(*[F.lit(m) for m in range(1 << width) if m.bit_count() <= reach])

    def values(block: int) -> Column:
        own = F.shiftrightunsigned(fp, block * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
        return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[values(b) for b in range(BLOCKS)]))


def _least_shared(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Shared shingles that two multisets of these sizes need."""
    return F.ceil((size_a + size_b) * (similarity / (1 + similarity)) - 1e-9)


def _mark() -> Column:
    """Identity of a row: its id and text. Rows that are equal in both are judged alike."""
    return F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), F.col("text"))


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, item_id, start, hamming, similarity): the most similar window for each document and item that it copies.

    ``start`` is the first shingle of the window; among equally similar windows the first that starts at a
    shingle of the item, or the last window of the document. A document with
    fewer words than the item is one window. An item shorter than a shingle is copied where its words stand
    one after the other, whatever is around them; items and documents without words match nothing. Rows
    of one id are judged each by itself and reported together, NULL ids as one document; items of
    one id likewise. Other columns are ignored. Empty tables give no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    copies = stage(_copies(rows, benchmark, similarity, radius), "copies")
    named = rows.select(_mark().alias("mark"), "id").join(broadcast_if_small(copies), "mark")
    return (
        named.groupBy("id", "item_id")
        .agg(F.min("best").alias("best"))
        .select(
            F.col("id").alias(id_col),
            "item_id",
            F.col("best.start").alias("start"),
            F.col("best.hamming").alias("hamming"),
            (-F.col("best.s")).alias("similarity"),
        )
    )


def without_copies(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that copy no benchmark item, as they are; see ``contaminations``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    name = free_name(docs, "_copy_mark")
    marks = stage(_copies(rows, benchmark, similarity, radius).select(F.col("mark").alias(name)).distinct(), "copies")
    own = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    mark = F.xxhash64(F.coalesce(own["id"].cast("string"), F.lit("")), own["id"].isNull(), own["text"])
    return docs.withColumn(name, mark).join(broadcast_if_small(marks), name, "left_anti").drop(name)


def _copies(rows: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(mark, item_id, best) for the rows (id, text) and items of which one copies the other."""
    mark = _mark()
    items = benchmark.select(
        F.col("item_id"), shingles(F.col("text")).alias("hashes"), F.size(words(F.col("text"))).alias("n_words")
    ).filter("size(hashes) > 0")
    items = stage(items.withColumn("key", F.xxhash64("item_id", "hashes")).dropDuplicates(["key"]), "benchmark-items")
    item_shingles = items.select("key", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    item_shingles = stage(item_shingles.groupBy("key", "size", "hash").agg(F.count(F.lit(1)).alias("weight")), "benchmark-shingles")
    vocabulary = broadcast_if_small(item_shingles.select("hash").distinct())

    shared = rows.select(mark.alias("mark"), shingles(F.col("text")).alias("all"))
    shared = shared.select("mark", F.size("all").alias("total"), F.posexplode("all").alias("at", "hash"))
    shared = stage(shared.join(vocabulary, "hash"), "shared-shingles").distinct()

    # 1. Windows that start at a shared shingle and hold enough of them. Hits lie in order, so
    # that the window from hit j has enough if the hit need - 1 places further on is inside it.
    hits = shared.join(broadcast_if_small(item_shingles), "hash")
    width = F.least("size", "total")
    last = F.greatest(F.col("total") - F.col("size"), F.lit(0))
    by_pair = hits.groupBy("mark", "key", "size", "total").agg(
        F.sort_array(F.collect_list(F.struct("at", "hash", "weight"))).alias("hits")
    )
    by_pair = by_pair.withColumn("need", F.greatest(_least_shared(F.col("size"), width, similarity), F.lit(1)).cast("int"))

    def enough(j: Column) -> Column:
        start = F.least(F.col("hits")[j]["at"], last)
        new = (j == 0) | (F.get("hits", j - 1)["at"] < last)
        return new & (F.get("hits", j + F.col("need") - 1)["at"] < start + width)

    by_pair = by_pair.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.size("hits") - 1), enough)))
    by_pair = by_pair.withColumn("start", F.least(F.col("hits")[F.col("j")]["at"], last))
    ahead = F.slice("hits", F.col("j") + 1, width)
    inside = F.filter(ahead, lambda h: h["at"] < F.col("start") + width)
    possible = by_pair.select("mark", "key", "size", width.alias("width"), "start", inside.alias("inside"))
    possible = stage(possible, "windows")

    # 2. SimHash of windows and items, met by blocks.
    by_mark = possible.groupBy("mark").agg(F.collect_set(F.struct("start", "width")).alias("wanted"))
    chosen = rows.withColumn("mark", mark).join(broadcast_if_small(by_mark), "mark")
    cut = chosen.select("mark", shingles(F.col("text")).alias("all"), "wanted")
    cut = cut.select("mark", "all", F.inline("wanted")).select(
        "mark", "start", "width", simhash(F.slice("all", F.col("start") + 1, F.col("width"))).alias("fp")
    )
    fps = stage(cut.distinct(), "window-fingerprints")
    stated = items.select("key", simhash(F.col("hashes")).alias("item_fp"))
    stated = stage(stated.select("key", "item_fp", F.inline(block_values(F.col("item_fp"), radius // BLOCKS))), "item-blocks")
    asked = possible.drop("inside").join(fps, ["mark", "start", "width"])
    asked = asked.select("mark", "key", "start", "fp", F.inline(block_values(F.col("fp"), 0)))
    met = asked.join(broadcast_if_small(stated), ["key", "block", "value"])
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = met.filter(hamming <= radius).select("mark", "key", "start", hamming.alias("hamming")).distinct()

    # 3. Shared weight of the pairs that are left: each shingle as often as it occurs in both.
    kinds = F.array_distinct(F.transform("inside", lambda h: F.struct(h["hash"].alias("hash"), h["weight"].alias("weight"))))
    both = F.aggregate(
        kinds,
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(k["weight"], F.size(F.filter("inside", lambda h: h["hash"] == k["hash"])).cast("long")),
    )
    exact = F.col("both") / (F.col("size") + F.col("width") - F.col("both"))
    found = possible.join(near, ["mark", "key", "start"]).withColumn("both", both).withColumn("similarity", exact.cast("double"))
    found = found.filter(F.col("similarity") >= similarity - 1e-12)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("hamming"))).alias("best")
    found = found.select("mark", "key", "start", "hamming", "similarity").unionByName(_short_copies(rows, items))
    pairs = found.groupBy("mark", "key").agg(best)
    return pairs.join(items.select("key", "item_id"), "key").select("mark", "item_id", "best")


def _short_copies(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(mark, key, start, hamming, similarity) of the places where items shorter than a shingle stand.

    A window of so many words is one shingle, its fingerprint the hash itself.
    """
    short = items.filter(F.col("n_words") < SHINGLE).select("key", F.get("hashes", F.lit(0)).alias("hash"), "n_words")
    lengths = sorted(r["n_words"] for r in short.select("n_words").distinct().collect())  # SHINGLE - 1 rows at most

    def runs(w: Column) -> Column:
        made = F.array().cast("array<struct<hash:bigint,start:int>>")
        for n in lengths:
            starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
            of_length = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("hash"), i.cast("int").alias("start")))
            made = F.concat(made, F.when(F.size(w) >= n, of_length).otherwise(F.array().cast("array<struct<hash:bigint,start:int>>")))
        return made

    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    cut = rows.select(_mark().alias("mark"), F.inline(F.transform(F.array(hashed), runs)[0])) if lengths else None
    if cut is None:
        return short.select(F.lit(0).cast("long").alias("mark"), "key", F.lit(0).alias("start"), F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity"))
    found = cut.join(broadcast_if_small(short.select("key", "hash")), "hash").groupBy("mark", "key").agg(F.min("start").alias("start"))
    return found.select("mark", "key", "start", F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity"))
