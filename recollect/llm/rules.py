"""Quality rules in a short-circuit cascade.

Every rule is a condition that rejects a text. A document is kept if none holds, so the order
of the rules cannot change a verdict, only what it costs: ``CASE`` looks at the next condition only
where the earlier ones did not hold. Cost and rejections of each rule are measured on
a sample, and the rule with the most rejections per cost among what the earlier ones leave comes next.

Everything is DataFrame functions on one row at a time: no shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recollect.llm.common import WORD, about, free_name
from recollect.sources.tables import stage

SPACE = " \t\n\x0b\x0c\r"  # fixed value: ASCII white space, which ends words
SYMBOLS = "#*$%&|<>"
RUN = 5  # words in a window of repeated words
SAMPLE = 1000  # documents on which rules are measured
TIMES = 3  # measurements of each rule, of which the shortest counts


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, SPACE)) > 0)


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Number of words inside windows of ``run`` words that occur in ``words`` more than once.

    Windows are compared by 64-bit hashes: among the n of one text two differing ones are taken for equal
    with a probability of n * n / 2**65. Texts that repeat nothing are told by one hash
    set; for the others windows are sorted by hash.
    """

    def places(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(sorted_: Column) -> Column:
            def same(p: Column, i: Column) -> Column:
                return F.coalesce(F.get(sorted_, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == p["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(sorted_, same), lambda p: p["i"]))

        return _bound(order, again)

    def covered(starts: Column) -> Column:
        # A window adds the words up to the next one's start, and no more than it has.
        return F.aggregate(
            F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(run)), F.lit(run))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - run), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(run)]))

    def counted(hashes: Column) -> Column:
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, _bound(places(hashes), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > run, _bound(hashed(words), counted)).otherwise(F.lit(0).cast("long"))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (LONG) of the whole text; NULL counts as empty.

    Columns of these names are replaced. ``word_chars`` are code points; a line counts as repeated if it holds a word and equals an earlier one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = free_name(docs, "_words")  # worked out once, in a step of its own
    own = {
        "n_words": F.col(both)["n"],
        "word_chars": F.length(_without(text, SPACE)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": _bound(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col(both)["again"],
    }
    made = docs.withColumn(both, _bound(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"))))
    return made.withColumns({name: value.cast("long") for name, value in own.items()}).drop(both)


def base_failed() -> Column:
    """Too few words, or over a fifth of them inside repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def standard_rules(text_col: str = "text") -> dict[str, Column]:
    """What rejects a text, from its measures and the text itself. Each holds in no text that reads as prose."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    breaks = F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)[ \t\r]*$"))
    marks = F.regexp_count(text, F.lit(r"[!?]{2}"))
    return {
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "word_length": (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 25),
        "repeated_lines": F.col("n_dup_lines") * 10 > F.size(lines(text)) * 3,
        "few_letters": letters * 2 < F.col("word_chars"),
        "capitals": (capitals * 2 > letters) & (letters > 0),
        "cut_lines": breaks * 10 > F.size(lines(text)) * 3,
        "exclamations": marks * 10 > F.col("n_words"),
    }


def measured(sample: DataFrame, rules: Mapping[str, Column]) -> tuple[dict[str, float], dict[frozenset[str], int]]:
    """(seconds of each rule, number of rows by the set of rules that reject them) over a sample."""

    def seconds(value: Column) -> float:
        def once() -> float:
            start = time.perf_counter()
            sample.agg(F.count_if(value)).collect()
            return time.perf_counter() - start

        return min(once() for _ in range(TIMES))

    idle = seconds(F.lit(True))
    names = list(rules)
    flags = F.array(*[F.coalesce(rules[n], F.lit(False)) for n in names]).alias("flags")
    rows = sample.groupBy(flags).count().collect()  # a row for each set that the sample holds, no more than SAMPLE
    found = {frozenset(n for n, hit in zip(names, r["flags"]) if hit): r["count"] for r in rows}
    return {n: max(seconds(rules[n]) - idle, 1e-4) for n in names}, found


def ordered(cost: Mapping[str, float], rejected: Mapping[frozenset[str], int]) -> list[str]:
    """Rules by rejections per cost, each counted on what the ones before it leave; ties by cost and name."""
    left, out = dict(rejected), []
    while len(out) < len(cost):
        rest = [n for n in cost if n not in out]
        hits = {n: sum(k for names, k in left.items() if n in names) for n in rest}
        best = min(rest, key=lambda n: (-hits[n] / cost[n], cost[n], n))
        left = {names: k for names, k in left.items() if best not in names}
        out.append(best)
    return out


def cascade(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Name of the first rule in ``order`` that rejects a row, NULL if none does; later ones are not looked at. NULL is no rejection."""
    first, *rest = order
    return reduce(lambda case, n: case.when(rules[n], n), rest, F.when(rules[first], first))


def sampled(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Up to ``sample`` texts as ``text``, the first by a hash, with their measures; without those on which the base fails."""
    body = docs.select(F.col(f"`{text_col}`").alias("text"))
    key = F.xxhash64("text")
    some = body.filter(about(key, sample, body.count())).orderBy(key).limit(sample)
    return stage(with_measures(some).filter(~base_failed()), "rule-texts")


def with_verdict(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``.

    ``kept``: neither does the base fail nor one of ``standard_rules`` hold. NULL and empty texts have no words, so that
    the base fails. Equal texts get equal verdicts, rows stay as often as they are, and all other
    columns stay as they are; columns of the added names are replaced. An empty table gives no rows.
    """
    order = ordered(*measured(sampled(docs, text_col, sample), standard_rules()))
    out = with_measures(docs, text_col).withColumn("base_failed", base_failed())
    refused = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(standard_rules(text_col), order))
    return out.withColumn("kept", refused.isNull())
