"""Groups of documents whose five-word shingles are 0.8 alike or more (Jaccard over sets).

Candidates come in two ways and are then verified exactly:

1. SimHash: fingerprints of the shingles that differ in two bits or fewer, met by anchor points (simhash.py).
   That finds copies that are all but equal, and no others: at a similarity of 0.8 fingerprints differ in
   about 10 of 64 bits, and anchors for so many would be copied to beyond all bounds.
2. Minwise hashes: BANDS keys of ROWS minima each. A pair of similarity s shares a key with probability
   1 - (1 - s**ROWS)**BANDS, which is 0.99993 at 0.8. Two bits of each minimum travel along as a sketch, and pairs
   whose sketches are more than five standard deviations away from 0.8 are not looked at.

Within a key the most central text is a leader, and so is every text like none of the leaders before it; leaders
meet all texts of the key, so that a group of copies costs a pair for each text and not for each two.
Keys of very many texts are cut into parts, whose leaders meet afterwards.

Leaders alone are not enough: copies can each be 0.8 like a text that is no leader, and not like the leader. So texts of
a key that have not met each other, and are in different components once the pairs of leaders are verified, all
meet in blocks, where they are verified at once (``_links_left``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from recollect.functions.bounds import broadcast_if_small
from recollect.llm import simhash
from recollect.llm.components import connected_components
from recollect.sources.tables import stage

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
BANDS = 24
MOST_UNLIKE = 38  # minima of ROWS * BANDS whose two bits may differ; at 0.8 these are 18, with a deviation of 3.9
PART = 2048  # texts of one key compared in one group
GRAMS = 1 << 20  # shingles of one part where texts meet with their shingles
CENTRES = 64  # texts of a group whose distances tell which texts are central
MULTIPLIER = 0x9E3779B97F4A7C15
FACTORS = np.random.default_rng(20).integers(0, 1 << 31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
SKETCH = [f"s{i}" for i in range(4)]
ODD = np.uint64(0x5555555555555555)


def _slices(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of texts that are not empty, in runs of about simhash.SLICE bytes."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t and run and size + len(t) > simhash.SLICE:
            yield run
            run, size = [], 0
        if t:
            run.append(i)
            size += len(t)
    if run:
        yield run


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, band keys, sketches) of plain texts, as signed 64-bit integers; those of empty texts are 0."""
    fps = np.zeros(len(texts), np.int64)
    keys, sketches = np.zeros((len(texts), BANDS), np.int64), np.zeros((len(texts), len(SKETCH)), np.int64)
    for run in _slices(texts):
        h, offsets = simhash.shingle_hashes([texts[i] for i in run], SHINGLE)
        fps[run] = simhash.majority(h, offsets)
        low, minima = (h >> np.uint64(32)).astype(np.uint32), np.empty((ROWS * BANDS, len(run)), np.uint32)
        for k, factor in enumerate(FACTORS):
            minima[k] = np.minimum.reduceat(low * factor, offsets[:-1])
        wide = minima.astype(np.uint64)
        for band in range(BANDS):
            key = np.full(len(run), band + 1, np.uint64)
            for m in wide[band * ROWS : (band + 1) * ROWS]:
                key = (key ^ m) * np.uint64(MULTIPLIER)
                key ^= key >> np.uint64(29)
            keys[run, band] = key.view(np.int64)
        # The lowest bits of a product depend on the lowest of the hash alone; higher ones are mixed.
        symbols = wide >> np.uint64(14) & np.uint64(3)
        packed = np.zeros((len(SKETCH), len(run)), np.uint64)
        for k, s in enumerate(symbols):
            packed[k // 32] |= s << np.uint64(2 * (k % 32))
        sketches[run] = packed.T.view(np.int64)
    return fps, keys, sketches


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and plain texts, some megabytes of text at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        first, some, size = 0, [], 0
        for i, t in enumerate(texts):
            some.append(simhash.plain(t.as_py() or b""))
            size += len(some[-1])
            if size >= 4 * simhash.SLICE or i == len(texts) - 1:
                yield batch.column(0).slice(first, len(some)), some
                first, some, size = i + 1, [], 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _rows_of(batches):
        fps, keys, sketches = signatures(texts)
        text_key = np.array([xxhash.xxh64_intdigest(t, 7) for t in texts], np.uint64).view(np.int64)
        ends = np.cumsum([0] + [BANDS * bool(t) for t in texts]).astype(np.int32)
        bands = pa.ListArray.from_arrays(ends, keys[[bool(t) for t in texts]].ravel())
        columns = [ids, pa.array(text_key), pa.array(fps), *(pa.array(np.ascontiguousarray(s)) for s in sketches.T), bands]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "fp", *SKETCH, "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _rows_of(batches):
        sets = [np.unique(simhash.shingle_hashes([t], SHINGLE)[0]).view(np.int64) if t else np.empty(0, np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"])


def _unlike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of sketched minima that differ."""
    x = one ^ others
    return np.bitwise_count((x | x >> np.uint64(1)) & ODD).sum(-1)


def _compared(key: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, leaders) of the texts of one group; leaders are taken in order of how near they are to the others."""
    open_, left, right, leaders = np.ones(len(key), bool), [], [], []
    far = np.zeros(len(key), np.uint64)
    for other in sketch[:: -(-len(key) // CENTRES)]:
        far += _unlike(other, sketch)
    for at in np.argsort(far, kind="stable"):
        if open_[at]:
            like = _unlike(sketch[at], sketch) <= MOST_UNLIKE
            like[at] = False
            right.append(key[like])
            left.append(np.full(len(right[-1]), key[at]))
            leaders.append(key[at])
            open_ &= ~like
    return np.concatenate(left), np.concatenate(right), np.array(leaders, np.int64)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of groups that lie together in order; as a, with the key, leaders of divided keys and texts that have not met."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rest):
            last = (rest["bucket"] == rest["bucket"].iat[-1]) & (rest["part"] == rest["part"].iat[-1])
            yield _settled(rest[~last])
            rest = rest[last]
    if rest is not None:
        yield _settled(rest)


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    bucket, part, key = (rows[c].to_numpy() for c in ("bucket", "part", "key"))
    sketch = np.ascontiguousarray(rows[SKETCH].to_numpy()).view(np.uint64)
    divided = rows["divided"].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    none = np.empty(0, np.int64)
    left, right, heads, of = [none], [none], [none], [none]
    alone = (size == 1) & divided[first] if len(rows) else none.astype(bool)
    heads.append(key[first[alone]])
    of.append(bucket[first[alone]])
    # Texts of a divided key have not met those of other parts.
    unmet, unmet_of = [key[divided]], [bucket[divided]]
    two = first[size == 2]
    two = two[~divided[two]]
    like = _unlike(sketch[two], sketch[two + 1]) <= MOST_UNLIKE
    left.append(key[two[like]])
    right.append(key[two[like] + 1])
    for f, n in zip(first, size):
        if n > 2 or (n == 2 and divided[f]):
            a, b, leaders = _compared(key[f : f + n], sketch[f : f + n])
            left.append(a)
            right.append(b)
            if divided[f]:
                heads.append(leaders)
                of.append(np.full(len(leaders), bucket[f]))
            elif n - len(leaders) > 1:
                unmet.append(np.setdiff1d(key[f : f + n], leaders))
                unmet_of.append(np.full(len(unmet[-1]), bucket[f]))
    a, b, h, k, u, v = (np.concatenate(x) for x in (left, right, heads, of, unmet, unmet_of))
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bucket": 0, "kind": "pair"}).drop_duplicates(["a", "b"])
    single = [pd.DataFrame({"a": x, "b": x, "bucket": y, "kind": kind}) for x, y, kind in ((h, k, "leader"), (u, v, "unmet"))]
    return pd.concat([pairs, *single])


def _meet(rows: DataFrame) -> DataFrame:
    """Compare rows (bucket, part, divided, key, sketch) by bucket and part."""
    near = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")
    return near.mapInPandas(_groups, "a long, b long, bucket long, kind string").distinct()


def _band_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of texts that share a band key and have similar sketches, those with leaders.

    And (bucket, key): texts of each band key that have not met all others of it.
    """
    keyed = classes.select("key", *SKETCH, F.explode("bands").alias("bucket"))
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART)
    full = stage(full.select("bucket", F.ceil(F.col("n") / PART).alias("parts")), "full-bands")
    dealt = keyed.join(broadcast_if_small(full), "bucket", "left").withColumn("divided", F.col("parts").isNotNull())
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).cast("string")
    met = stage(_meet(dealt.withColumn("part", part).drop("parts")), "band-pairs")
    # Leaders of divided keys: each two of their parts lie together once. Where the texts are copies, that is one part.
    heads = met.filter("kind = 'leader'").select("bucket", F.col("a").alias("key"))
    sizes = heads.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    heads = heads.join(broadcast_if_small(sizes), "bucket").join(classes.select("key", *SKETCH), "key")
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    heads = heads.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    grid = heads.withColumn("part", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")))
    again = _meet(grid.withColumn("divided", F.lit(False)).drop("own", "other", "parts"))
    pairs = met.unionByName(again).filter("kind = 'pair'").select("a", "b")
    return pairs, met.filter("kind = 'unmet'").select("bucket", F.col("a").alias("key"))


def _simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of texts with equal fingerprints, or with fingerprints linked by anchors."""
    first = classes.filter("size(bands) > 0").groupBy("fp").agg(F.min("key").alias("first"))
    first = stage(first, "fingerprints")
    same = classes.join(first.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("key").alias("b"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_key")) for c in "ab")
    linked = simhash.links(first).join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return same.unionByName(linked.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))).filter("a <> b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets are that similar."""
    one, two = (sets.select(F.col("key").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    either = F.size("a_grams") + F.size("b_grams") - both
    near = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return near.filter(both >= similarity * either - 1e-9).select("a", "b")


def _linked(rows: pd.DataFrame, similarity: float) -> tuple[list[int], list[int]]:
    """Roots (a, b) of texts of one block that are so similar, as few as connect the components that are met.

    Where two parts lie together only pairs across them are looked at: each part is a block of its own, too.
    """
    sketch = np.ascontiguousarray(rows[SKETCH].to_numpy()).view(np.uint64)
    root, part = rows["root"].to_numpy(), rows["own"].to_numpy()
    size = rows["grams"].map(len).to_numpy()
    start = np.cumsum(size) - size
    _, place = np.unique(np.concatenate(rows["grams"].to_numpy()), return_inverse=True)
    _, group = np.unique(root, return_inverse=True)
    seen, across = np.zeros(len(place), bool), part.min() != part.max()
    a, b = [], []
    for i in range(len(rows) - 1):
        near = group[i + 1 :] != group[i]
        if across:
            near &= part[i + 1 :] != part[i]
        others = np.flatnonzero(near) + i + 1
        others = others[(_unlike(sketch[i], sketch[others]) <= MOST_UNLIKE) & (size[others] > 0)]
        if not len(others) or not size[i]:
            continue
        own = place[start[i] : start[i] + size[i]]
        seen[own] = True
        both = np.array([seen[place[start[j] : start[j] + size[j]]].sum() for j in others])
        seen[own] = False
        for j in others[both >= similarity * (size[i] + size[others] - both) - 1e-9]:
            if group[i] != group[j]:
                a.append(root[i])
                b.append(root[j])
                group[group == group[j]] = group[i]
    return a, b


def _links_left(unmet: DataFrame, roots: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots that texts of one band key link, which have not met and are in different components so far."""
    named = unmet.join(roots.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = named.join(sets.select("key", F.size("grams").alias("n")).hint("merge"), "key")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("n") / GRAMS)).alias("parts")
    several = named.groupBy("bucket").agg(parts, F.min("root").alias("low"), F.max("root").alias("high"))
    several = stage(several.filter("low <> high").select("bucket", "parts"), "open-bands")
    rows = named.join(broadcast_if_small(several), "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    rows = rows.select("bucket", "low", "high", "own", "key", "root").join(sketches.hint("merge"), "key").join(sets.hint("merge"), "key")

    def links(block: pd.DataFrame) -> pd.DataFrame:
        a, b = _linked(block.sort_values("key"), similarity)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("bucket", "low", "high").applyInPandas(links, "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, component_id): one row for each row of ``docs``.

    Texts are linked if the sets of their shingles are ``similarity`` (0.8 or more) alike; component_id is the smallest id
    that links lead to. A-Z count as a-z and white space as one blank; texts that are then equal are always linked, those
    without a word (NULL, empty, blank) among each other. A text of fewer words is one shingle. NULL ids never name a
    component, unless it has no other. Ids have to be BIGINT. Extra columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "id long, key long, fp long, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"
    marked = stage(rows.mapInArrow(_signed, kinds), "signatures")
    classes = stage(marked.dropDuplicates(["key"]), "texts")
    banded, unmet = _band_pairs(classes)
    pairs = _simhash_pairs(classes).unionByName(banded)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "candidate-pairs")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(unmet.select("key")).distinct()
    named = stage(classes.select("key", "id").join(asked.hint("merge"), "key"), "candidates")
    # By sorting at every size, as in simhash.one_of_each_group.
    texts = rows.join(named.hint("merge"), "id").select("key", "text").dropDuplicates(["key"])
    sets = stage(texts.mapInArrow(_shingle_sets, "key long, grams array<long>"), "shingle-sets")

    # One pair for each text first; then only pairs whose ends are not linked with the same text.
    once = stage(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, similarity), "similar-pairs")
    one, two = (once.select(F.col("b").alias(c), F.col("a").alias(f"{c}_head")) for c in "ab")
    apart = pairs.join(one.hint("merge"), "a", "left").join(two.hint("merge"), "b", "left")
    apart = apart.filter(F.coalesce("a_head", "a") != F.coalesce("b_head", "b")).select("a", "b")
    more = _verified(apart, sets, similarity)
    roots = stage(connected_components(once.unionByName(more)).withColumnRenamed("node", "key"), "roots")
    # Texts that have not met link components as a whole.
    links = _links_left(unmet, roots, classes.select("key", *SKETCH), sets, similarity)
    joined = stage(connected_components(links).select(F.col("node").alias("at"), F.col("root").alias("to")), "joined-roots")
    alone = joined.join(roots.select(F.col("key").alias("at")).hint("merge"), "at", "left_anti")
    moved = roots.join(joined.hint("merge"), F.col("root") == F.col("at"), "left")
    roots = moved.select("key", F.coalesce("to", "root").alias("root")).unionByName(alone.select(F.col("at").alias("key"), F.col("to").alias("root")))

    of_key = marked.groupBy("key").agg(F.min("id").alias("first_id")).join(roots.hint("merge"), "key", "left")
    of_key = stage(of_key.withColumn("root", F.coalesce("root", "key")), "text-roots")
    ids = of_key.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = of_key.join(ids.hint("merge"), "root").select("key", "component_id")
    return marked.select("id", "key").join(found.hint("merge"), "key").select(F.col("id").alias(id_col), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of similar texts, chosen as in simhash.one_of_each_group."""
    return simhash.one_of_each_group(docs, id_col, text_col, find=similar_groups)
