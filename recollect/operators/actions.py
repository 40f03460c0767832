"""What is done with results: summary, roadmap, schedule, proposals (AC1-AC7).

Nothing here ranks, and nothing here creates an event that was not confirmed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.functions import text as tx
from recollect.functions.bounds import broadcast_if_small
from recollect.operators.retrieval import PLACES, weights_of
from recollect.operators.shelves import heaviest_terms
from recollect.plans.index import Index

# The ways of writing a date that are read.
MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"
NTH = "(?:st|nd|rd|th)?"
ISO_DATE = r"\b(\d{4}-\d{1,2}-\d{1,2})\b"
MONTH_FIRST = rf"(?i)\b((?:{MONTH}) \d{{1,2}}{NTH},? \d{{4}})\b"
DAY_FIRST = rf"(?i)\b(\d{{1,2}}{NTH} (?:of )?(?:{MONTH}),? \d{{4}})\b"
NUMERIC = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
NO_YEAR = rf"(?i)\b((?:{MONTH}) \d{{1,2}}{NTH}|\d{{1,2}}{NTH} (?:of )?(?:{MONTH}))\b(?!,? \d{{4}})"
RELATIVE_DAY = r"(?i)\b(today|tomorrow)\b"


def summarize(results: DataFrame, index: Index, n: int = 3) -> DataFrame:
    """(query_id, pos, image_id, sentence, weight): the n heaviest sentences of the retrieved items.

    A sentence weighs the mean TF-IDF weight of its tokens. Each item's sentences are
    weighed once, however many queries found it, and only its n heaviest go on.
    """
    images = results.select("image_id").distinct()
    texts = index.items.select("image_id", "text").join(
        broadcast_if_small(images), "image_id", "left_semi"
    )
    cut = texts.select("image_id", F.posexplode(tx.sentences("text")).alias("at", "sentence"))
    words = cut.select("image_id", "at", F.explode(tx.tokens("sentence")).alias("term"))
    weights = weights_of(images, index)
    weighed = (
        words.join(weights, ["image_id", "term"])
        .groupBy("image_id", "at")
        .agg(F.round(F.avg("w"), PLACES).alias("weight"))
    )
    inside = Window.partitionBy("image_id").orderBy(F.col("weight").desc(), "at")
    heaviest = weighed.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= n)
    order = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "image_id", "at")
    chosen = (
        results.select("query_id", "image_id")
        .join(heaviest.drop("_n"), "image_id")
        .withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= n)
    )
    return chosen.join(cut, ["image_id", "at"]).select(
        "query_id", "pos", "image_id", "sentence", "weight"
    )


def roadmap(results: DataFrame, index: Index, steps: int = 5) -> DataFrame:
    """(query_id, step, topic, weight): key topics of the retrieved items, heaviest first."""
    order = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), F.col("topic"))
    return (
        heaviest_terms(results, index, steps)
        .select("query_id", F.col("term").alias("topic"), F.round("weight", PLACES).alias("weight"))
        .withColumn("step", F.row_number().over(order))
        .filter(F.col("step") <= steps)
        .select("query_id", "step", "topic", "weight")
    )


def schedule(plan: DataFrame, start: Column | dt.date, days: int) -> DataFrame:
    """Adds ``day``: the steps of each plan spread over ``days`` days from ``start``.

    ``start`` comes from the user; there is no default.
    """
    first = F.lit(start).cast("date") if isinstance(start, dt.date) else start
    order = Window.partitionBy("query_id").orderBy("step")
    return plan.withColumn("_part", F.ntile(days).over(order)).select(
        *plan.columns, F.date_add(first, F.col("_part") - 1).alias("day")
    )


def _read(pattern: str, day: Callable[[Column], Column]) -> Column:
    """(found, day) of all places in a sentence that fit the pattern."""
    return F.transform(
        F.regexp_extract_all("context", F.lit(pattern), F.lit(1)),
        lambda s: F.struct(s.alias("found"), day(s).alias("day")),
    )


def _spelled(form: str) -> Callable[[Column], Column]:
    """Reads a date with the month in letters; "of", commas and ordinal endings are left out."""

    def day(s: Column) -> Column:
        plain = F.regexp_replace(F.lower(s), r"(?<=\d)(st|nd|rd|th)\b| of\b|,", "")
        return F.try_to_date(F.initcap(plain), form)

    return day


def _numeric(s: Column) -> Column:
    """The day where only one order of day and month is possible, or both are the same; else NULL."""
    parts = F.split(s, "/")
    a, b = parts[0].cast("int"), parts[1].cast("int")
    first, second = F.concat_ws("-", parts[2], parts[1], parts[0]), F.concat_ws("-", parts[2], parts[0], parts[1])
    return F.when((a > 12) | (a == b), F.try_to_date(first, "yyyy-M-d")).when(b > 12, F.try_to_date(second, "yyyy-M-d"))


def _sentences(items: DataFrame, said_on: Column | None) -> DataFrame:
    said = [said_on.alias("_said_on")] if said_on is not None else []
    return items.select("image_id", *said, F.explode(tx.sentences("text")).alias("context"))


def find_deadlines(items: DataFrame, said_on: Column | None = None) -> DataFrame:
    """(image_id, day, found, context): dates that really stand in a text, with their sentence.

    What looks like a date but is none is dropped; what could be two days, or lacks the year, is not guessed
    (``unread_dates`` names it). "Today" and "tomorrow" are read only against ``said_on``, a date the
    user gave; without it they are dropped.
    """
    found = [
        _read(ISO_DATE, lambda s: F.try_to_date(s, "yyyy-M-d")),
        _read(MONTH_FIRST, _spelled("MMMM d yyyy")),
        _read(DAY_FIRST, _spelled("d MMMM yyyy")),
        _read(NUMERIC, _numeric),
    ]
    if said_on is not None:
        later = lambda s: F.when(F.lower(s) == "tomorrow", 1).otherwise(0)
        found.append(_read(RELATIVE_DAY, lambda s: F.date_add(F.col("_said_on"), later(s))))
    return (
        _sentences(items, said_on)
        .select("image_id", "context", F.inline(F.concat(*found)))
        .filter(F.col("day").isNotNull())
        .select("image_id", "day", "found", "context")
        .distinct()
    )


def unread_dates(items: DataFrame) -> DataFrame:
    """(image_id, found, reason, context): dates that a user must settle, ambiguous or without a year."""
    parts = F.split("found", "/")
    low = (parts[0].cast("int") <= 12) & (parts[1].cast("int") <= 12) & (parts[0] != parts[1])
    context = _sentences(items, None)
    numeric = context.select("image_id", "context", F.explode(F.regexp_extract_all("context", F.lit(NUMERIC), F.lit(1))).alias("found"))
    open_ = context.select("image_id", "context", F.explode(F.regexp_extract_all("context", F.lit(NO_YEAR), F.lit(1))).alias("found"))
    both = numeric.filter(low).withColumn("reason", F.lit("day and month")).unionByName(open_.withColumn("reason", F.lit("no year")))
    return both.select("image_id", "found", "reason", "context").distinct()


def _identified(df: DataFrame) -> DataFrame:
    """Adds ``proposal_id``, a hash of what is proposed: the same proposal has the same id."""
    content = F.concat_ws(
        "\u001f", "kind", F.col("day").cast("string"), "title", "evidence"
    )
    return df.select(F.sha2(content, 256).alias("proposal_id"), "kind", "day", "title", "evidence")


def propose(deadlines: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Reminders for deadlines and events for scheduled steps, each with its evidence."""
    reminders = deadlines.select(
        F.lit("reminder").alias("kind"),
        "day",
        F.col("context").alias("title"),
        F.concat(F.lit("item "), F.col("image_id").cast("string"), F.lit(": "), F.col("found")).alias(
            "evidence"
        ),
    )
    events = scheduled.select(
        F.lit("event").alias("kind"),
        "day",
        F.col("topic").alias("title"),
        F.concat(
            F.lit("plan "), F.col("query_id").cast("string"), F.lit(", step "), F.col("step").cast("string")
        ).alias("evidence"),
    )
    return _identified(reminders.unionByName(events).distinct())


def confirmed(proposals: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals that were explicitly confirmed, and the others, which stay proposals."""
    yes = confirmations.filter(F.col("confirmed")).select("proposal_id").distinct()
    return (
        proposals.join(yes, "proposal_id", "left_semi"),
        proposals.join(yes, "proposal_id", "left_anti"),
    )


def new_events(accepted: DataFrame, target: DataFrame) -> DataFrame:
    """Confirmed proposals that are not yet in the event table."""
    once = accepted.dropDuplicates(["proposal_id"])
    return once.join(target.select("proposal_id"), "proposal_id", "left_anti")


def create_events(accepted: DataFrame, path: str) -> None:
    """Append confirmed proposals to the event table at ``path``, each of them once."""
    spark = accepted.sparkSession
    try:
        target = spark.read.schema(accepted.schema).parquet(path)
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        target = accepted.limit(0)
    new_events(accepted, target).write.mode("append").parquet(path)
