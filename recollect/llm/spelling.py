"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered by how many words have them, rare ones first. A word's prefix is its
first three in that order, with all places of the third; its pivots are two bigrams of the
prefix that do not overlap, together as rare as can be. One edit leaves one of two pivots whole. Of two
words, let s be the one whose third bigram comes no later in the order: the whole pivot of s is a bigram
of the other word that comes no later either, so it is in that word's prefix, and one place
further at most. So near words meet where a pivot of the one equals a bigram in the prefix of the other.

Common syllables would still bring many words together. The edit lies on one side of the whole pivot;
the other side is equal in both words, and so is one half of the side that has the edit. The key by
which words meet holds all that, with length and place. It loses nothing: the key is stated for
either side and either half. A side of SHORT letters or fewer is not cut. What meets is verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.functions.bounds import lookup
from recollect.llm.exchange import BASE, Rolling, mixed
from recollect.sources.tables import stage

RUN = "[A-Za-z\\u00C0-\\u00FF]"  # fixed value: the letters of a word
LETTERS = 26 + 64  # a to z, and the others as they are
SHORT = 3  # letters of the side with the edit that few words differ in
NO_END = np.iinfo(np.int64).max
_U = np.uint64
LEAST_LENGTH, LEAST_COUNT = 7, 2
NOISE = 31  # one in so many (document, word) loses a letter
RATIO = 10  # how many times as frequent a form is
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more.

    A NULL text has no words; a NULL id counts as an empty one in the hash that takes letters away. Rows count as often as they stand there.
    """
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all words one after the other, first place of each word, lengths)."""
    words = column.to_pylist()
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    return np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26), np.cumsum(sizes) - sizes, sizes


def _grams(letters: np.ndarray) -> np.ndarray:
    """Number of the bigram that starts at each place but the last."""
    return letters[:-1] * LETTERS + letters[1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the LETTERS**2 bigrams occurs in the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LETTERS**2, np.int64)
        for batch in batches:
            letters, first, _ = _letters(batch.column(0))
            inside = np.ones(max(len(letters) - 1, 0), bool)
            inside[first[1:] - 1] = False  # not from one word into the next
            seen += np.bincount(_grams(letters)[inside], minlength=LETTERS**2)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some), "n": pa.array(seen[some])})

    counts = np.zeros(LETTERS**2, np.int64)
    for r in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def prefix(ranks: list[int]) -> list[int]:
    """Places of the bigrams that come no later in the order than the third one."""
    last = sorted(ranks)[min(2, len(ranks) - 1)]
    return [i for i, r in enumerate(ranks) if r <= last]


def pivots(places: list[int], weights: list[int]) -> tuple[int, int]:
    """The two of ``places`` that lie two or more apart with the least sum of weights, the first ones if there are several.

    Going through the places, the best first pivot for each is the best one that ends before it.
    """
    best, pair = None, (places[0], places[0])
    first = None  # the lightest of those before ``done``
    done = 0
    for p in places:
        while places[done] <= p - 2:
            if first is None or weights[places[done]] < weights[first]:
                first = places[done]
            done += 1
        if first is not None and (best is None or weights[first] + weights[p] < best):
            best, pair = weights[first] + weights[p], (first, p)
    return pair


def keys(
    roll: Rolling, first: np.ndarray, size: np.ndarray, at: np.ndarray, more: int, shift: int, since: np.ndarray | int = -1, until: np.ndarray | int = NO_END
) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): where words meet others that are ``more`` letters longer, by their bigram at ``at``, which the others have ``shift`` further on.

    The edit may be before the bigram, at ``since`` or later, if the shift is the difference in length, and behind
    it, at ``until`` or earlier, if the shift is 0. The half that cannot have the edit is not stated as the one that has it.
    """
    out = []
    length, end = size + more, first + size
    rows = np.arange(len(at))

    def state(kind: int, fits: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        key = mixed(mixed(mixed(a + _U(kind)) ^ b) + length.astype(np.uint64) * _U(BASE) + place.astype(np.uint64))
        out.append((rows[fits], key[fits]))

    if shift == more:  # all from the bigram on is equal
        there = at + shift
        half = np.maximum(there // 2, 0)
        cut = there > SHORT
        equal = roll.of(first + at, end)
        state(1, cut, there, roll.of(first, first + half), equal)
        second = roll.of(first + np.maximum(at - there + half, 0), end)
        state(2, cut & (since <= half), there, second, second)
        state(3, (there >= 0) & ~cut, there, equal, equal)
    if shift == 0:  # all up to the bigram is equal
        rest = length - at - 2
        half = np.maximum(rest // 2, 0)
        cut = rest > SHORT
        equal = roll.of(first, first + at + 2)
        state(4, cut, at, equal, roll.of(np.maximum(end - half, first), end))
        second = roll.of(first, np.minimum(first + at + 2 + rest - half, end))
        state(5, cut & (until >= at + 1 + rest - half), at, second, second)
        state(6, (rest >= 0) & ~cut, at, equal, equal)
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def _lists(words: int, rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """One list of int64 for each word."""
    order = np.argsort(rows, kind="stable")
    ends = np.cumsum(np.bincount(rows, minlength=words))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values[order].view(np.int64)))


def stated_keys(words: DataFrame) -> DataFrame:
    """(word, own, asked): the keys by which a word's prefix is found, and those that its pivots ask for."""
    counts = gram_counts(words)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    values = mixed((np.arange(LETTERS, dtype=np.uint64) + _U(1)) * _U(BASE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, first, size = _letters(batch.column(0))
            roll, grams = Rolling(values[letters]), _grams(letters)
            ranks, weights = rank[grams].tolist(), counts[grams].tolist()
            whose, at, chosen = [], [], []
            for w, (a, n) in enumerate(zip(first.tolist(), size.tolist())):
                places = prefix(ranks[a : a + n - 1])
                whose += [w] * len(places)
                at += places
                chosen += pivots(places, weights[a : a + n - 1])
            whose, at = np.array(whose, np.int64), np.array(at, np.int64)
            row, own = keys(roll, first[whose], size[whose], at, 0, 0)
            two, chosen = np.repeat(np.arange(len(size)), 2), np.array(chosen, np.int64)
            # An edit before the first pivot is found by the first, one behind the second by the second: else it is between.
            since, until = np.full(len(chosen), -1), np.full(len(chosen), NO_END)
            since[1::2], until[::2] = chosen[::2], chosen[1::2] + 1
            asked = [keys(roll, first[two], size[two], chosen, more, shift, since, until) for more, shift in ((0, 0), (1, 0), (-1, 0), (1, 1), (-1, -1))]
            rows, asks = two[np.concatenate([r for r, _ in asked])], np.concatenate([k for _, k in asked])
            lists = [_lists(len(size), whose[row], own), _lists(len(size), rows, asks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["word", "own", "asked"])

    return words.select("word").mapInArrow(run, "word string, own array<bigint>, asked array<bigint>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every two words that differ by one inserted, deleted or replaced letter, both ways round."""
    stated = stage(stated_keys(words), "gram-keys")
    asked = stated.select(F.explode("asked").alias("key"), F.col("word").alias("a"))
    own = stated.select(F.explode("own").alias("key"), F.col("word").alias("b"))
    met = asked.join(own, "key").filter(F.levenshtein("a", "b", 1) == 1)
    pair = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return met.select(F.inline(pair)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain of forms. Each round follows the chains twice as far.

    Forms are RATIO times as frequent as their words, so chains end, after few steps.
    """
    reach = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stage(lookup(reach, ahead, "root", "left"), "roots")
        if not longer.filter(F.col("_next").isNotNull()).head(1):
            return reach
        reach = stage(longer.select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``count_words``.

    ``form``: the near word of largest n (of equally frequent ones the smallest by code points), if that is ``ratio`` times
    the word's n or more, else NULL; ``root``: where following forms leads, the word itself without one;
    ``n_near``: number of near words. Other columns are ignored; an empty table gives no rows.
    """
    words = stage(count_words(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    # Each word asks every near one: a word has as many as it has near words, all within one length of it.
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best")
    met = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    fits = form_n >= F.col("n") * ratio
    joined = words.join(met, "word", "left").select(
        "word",
        F.when(fits, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, form_n).cast("long").alias("form_n"),
    )
    joined = stage(joined, "forms")
    ends = roots(joined.filter(F.col("form").isNotNull()))
    out = joined.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
