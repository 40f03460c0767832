"""From the turns of conversations to queries (CV1-CV8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from recollect.functions import running, text as tx
from recollect.functions.bounds import broadcast_if_small
from recollect.operators.ranking import QuerySet

# The intents and the wordings that signal them. How a turn opens says what it is
# about; nouns such as "plan" or "calendar" may be part of what is looked for. The first
# opening that fits wins.
OPENINGS = (
    ("why", r"^\W*(why|explain why)\b"),
    ("confirm", r"^\W*(yes|confirm|go ahead)\b"),
    ("search", r"^\W*((can|could|would|will) you |please )*(find|show|search|look for|where (is|are))\b"),
    ("refine", r"^\W*(no|the one|i (also )?remember|(it|they|there) (was|were|also|had))\b"),
)
# What is to be done stands at the head of a clause: "Summarize this and create a plan."
CLAUSE = r"(^\W*|[.!?;,]\s*|\b(and|then|now|please|also|you)\s+)"
ACTIONS = (
    ("summarize", CLAUSE + r"(summari[sz]e\b|(give|write|make|create)\b[^.!?]*\bsummary\b)"),
    ("reminder", CLAUSE + r"(remind\b|(set|create|add|make)\b[^.!?]*\breminder\b)"),
    ("schedule", CLAUSE + r"(schedule\b|(add|put)\b[^.!?]*\bcalendar\b)"),
    ("roadmap", CLAUSE + r"(plan\b|(create|make|build|write|prepare|draw up|give)\b[^.!?]*\b(road ?map|plan)\b)"),
)
# What may stand before a turn without changing what it is about.
GREETING = r"^\W*((hello|hi|hey|thanks|thank you|thx|ok|okay|sorry|great|cool|well|so|please)\b\W*)+"
# A question is a search in other words, unless it is small talk as a whole, or has no word beyond
# those of any question. Anything that is no question describes what is looked for.
QUESTION = r"^\W*(what|who|whose|when|where|how|which|is|are|was|were|do|does|did|has|have|had)\b"
SMALL_TALK = (
    r"^\W*(what('s| is| was) (the |your |today's )?(weather|time|date|day|name)( (like|today|now|tomorrow|here))*"
    r"|what (can|do|are|did) you( do| mean| say| think| doing)*( for me)?|who (are|made|built) you"
    r"|how (are|old are|do|does|did) (you|this|that|it)( do| doing| work| go| going| today)*|how('s| is) it going"
    r"|(are|is|do|did|does|was|were) (you|that|this|it|we)( (there|sure|ok|okay|right|all|a bot|human|real|done|it|help|work|understand|know|know that))+)\W*$"
)
EMPTY_WORDS = (
    r"^\W*((what|who|whose|when|where|how|which|is|are|was|were|do|does|did|has|have|had|it|its|that|this|these|those|they|them|there"
    r"|you|i|we|he|she|me|my|your|the|a|an|of|to|for|in|on|so|not|no|about|else|more|much|many|s)\b\W*)*$"
)
OUT_OF_SCOPE = "out of scope"
RETRIEVING = ("search", "refine")
ACTING = ("why", "summarize", "roadmap", "reminder", "schedule", "confirm")


def label_intent(
    turns: DataFrame,
    openings: Sequence[tuple[str, str]] = OPENINGS,
    actions: Sequence[tuple[str, str]] = ACTIONS,
) -> DataFrame:
    """Adds ``intent`` and ``intents`` to user turns; other roles have none.

    ``intent`` is what the turn is about: its opening, else the first action of ``actions`` it asks
    for, else a search for what it describes or asks. ``intents`` are that and all actions it asks for. Small
    talk, thanks, and a turn without a word are out of scope; a greeting before anything else does not count.
    The rules are a short parameter and become expressions, not a join.
    """
    lowered = F.regexp_replace(F.lower("text"), GREETING, "")
    greeted = F.lower("text").rlike(GREETING)
    asked = F.array_compact(F.array(*[F.when(lowered.rlike(p), F.lit(name)) for name, p in actions]))
    label = F.lit(None).cast("string")
    for name, pattern in reversed(openings):
        label = F.when(lowered.rlike(pattern), name).otherwise(label)
    asks = lowered.rlike(QUESTION)
    aside = lowered.rlike(EMPTY_WORDS) | F.when(asks, lowered.rlike(SMALL_TALK)).otherwise(greeted)
    rest = F.when(aside | F.col("text").isNull(), OUT_OF_SCOPE).otherwise("search")
    intent = F.coalesce(label, F.get(asked, F.lit(0)), rest)
    said = F.col("role") == "user"
    return turns.withColumn("intent", F.when(said, intent)).withColumn(
        "intents", F.when(said, F.array_distinct(F.concat(F.array(intent), asked)))
    )


def segment_searches(turns: DataFrame) -> DataFrame:
    """Adds ``segment``: a search opens one, all that follows stays in it. 0 before the first."""
    opens = F.when(F.col("intent") == "search", 1).otherwise(0).cast("long")
    return running.running_sum(
        turns, ["conv_id"], ["turn"], opens, "segment", running.blocks_of("turn")
    )


def triggered(turns: DataFrame) -> DataFrame:
    """The turns that run retrieval: searches and refinements."""
    return turns.filter(F.col("intent").isin(*RETRIEVING))


def extract_clues(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, slot, value): lexicon phrases found in a turn.

    Runs of tokens as long as any phrase of the lexicon are looked up by equality. Where a turn names
    several values for one slot, the longest phrase counts, then the first by spelling.
    """
    cut = lexicon.select(tx.tokens("phrase").alias("_words"), "slot", "value").filter(F.size("_words") > 0)
    lengths = sorted(r["n"] for r in cut.select(F.size("_words").alias("n")).distinct().collect())  # one for each length
    # Tokens are a column of their own: inside the run expressions they would be cut anew per run.
    words = turns.select("conv_id", "turn", "segment", tx.tokens("text").alias("_words"))
    runs = words.select("conv_id", "turn", "segment", F.explode(tx.word_runs(F.col("_words"), lengths)).alias("_run"))
    known = cut.select(F.array_join("_words", " ").alias("_run"), "slot", "value")
    order = F.struct(-F.length("_run"), F.col("_run"), F.col("value"))
    return (
        runs.join(broadcast_if_small(known), "_run")
        .groupBy("conv_id", "turn", "segment", "slot")
        .agg(F.min_by("value", order).alias("value"))
    )


def accumulate_context(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, term, since): every term said in a segment, and its first turn.

    The context of a turn is what has ``since`` <= that turn. This holds it once per
    term, where an array per turn would grow with the square of the conversation.
    """
    said = turns.select("conv_id", "segment", "turn", F.explode(tx.tokens("text")).alias("term"))
    return said.groupBy("conv_id", "segment", "term").agg(F.min("turn").alias("since"))


def context_at(turns: DataFrame, context: DataFrame) -> DataFrame:
    """(conv_id, turn, term): the context of each given turn, one row per term."""
    at = turns.select("conv_id", "segment", "turn")
    return (
        at.join(context, ["conv_id", "segment"])
        .filter(F.col("since") <= F.col("turn"))
        .select("conv_id", "turn", "term")
    )


def clue_state(turns: DataFrame, clues: DataFrame, slots: Sequence[str]) -> DataFrame:
    """(conv_id, turn, slot, value): the latest value of each slot as of each given turn.

    A clue replaces the earlier value of its own slot and no other. One running value per
    slot, worked out side by side, in place of a join of turns with all earlier clues.
    """
    said = clues.groupBy("conv_id", "turn").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"_said_{s}") for s in slots]
    )
    rows = turns.select("conv_id", "segment", "turn").join(said, ["conv_id", "turn"], "left")
    state = running.running_last_of(
        rows,
        ["conv_id", "segment"],
        ["turn"],
        {f"_now_{s}": F.col(f"_said_{s}") for s in slots},
        running.blocks_of("turn"),
    )
    entries = [
        F.struct(F.lit(s).alias("slot"), F.col(f"_now_{s}").alias("value")) for s in slots
    ]
    return state.select("conv_id", "turn", F.inline(F.array(*entries))).filter(
        "value IS NOT NULL"
    )


def query_key(conv="conv_id", turn="turn"):
    """Id of the query that a turn makes."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def formulate(
    context: DataFrame, state: DataFrame, filters: DataFrame | None = None
) -> QuerySet:
    """The queries of all retrieving turns, from their context and clue state.

    ``context`` is ``context_at``, ``state`` is ``clue_state``; a turn without clues has
    terms only. ``filters`` is (conv_id, turn, field, value) where the user gave any.
    """
    key = query_key().alias("query_id")
    return QuerySet(
        terms=context.select(key, "term", F.lit(1).cast("long").alias("tf")),
        clues=state.select(key, "slot", "value"),
        filters=None if filters is None else filters.select(key, "field", "value"),
    )


def trigger_counts(turns: DataFrame) -> DataFrame:
    """(intent, retrieves, turns): user turns per intent and whether they run retrieval."""
    return (
        turns.filter(F.col("intent").isNotNull())
        .groupBy("intent")
        .agg(F.count(F.lit(1)).alias("turns"))
        .select("intent", F.col("intent").isin(*RETRIEVING).alias("retrieves"), "turns")
    )


def bind_actions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, intent, query_id, proposed_at): what an action turn acts on, a row for each action it asks for.

    ``query_id`` is the latest retrieval at or before the turn, in any segment.
    ``proposed_at`` is, for a confirmation, the latest turn that asked for a reminder or
    a schedule since that retrieval; without one the user confirms the result itself.
    """
    made = F.when(F.col("intent").isin(*RETRIEVING), F.col("turn"))
    asked = F.when(F.arrays_overlap("intents", F.array(F.lit("reminder"), F.lit("schedule"))), F.col("turn"))
    bound = running.running_last_of(
        turns.select("conv_id", "turn", "intent", "intents"),
        ["conv_id"],
        ["turn"],
        {"_made": made, "_asked": asked},
        running.blocks_of("turn"),
    )
    proposal = F.when(
        (F.col("intent") == "confirm") & (F.col("_asked") > F.col("_made")), F.col("_asked")
    )
    each = bound.withColumn("intent", F.explode("intents"))
    return each.filter(F.col("intent").isin(*ACTING)).select(
        "conv_id",
        "turn",
        "intent",
        F.when(F.col("_made").isNotNull(), query_key("conv_id", "_made")).alias("query_id"),
        proposal.alias("proposed_at"),
    )
