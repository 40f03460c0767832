"""The ten representative queries, as conversations over the small archive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.operators import actions as ac, conversation as cv, explanation as ex, ranking as rk, retrieval as rt
from recollect.schemas import LEXICON, SLOTS, TURNS
from recollect.sources import tables

# What is said, and the clue words of the tests.
SAID = [
    (1, 0, "Find my CN notes about OSI."),
    (1, 1, "No, I remember it was handwritten."),
    (1, 2, "Why did you show me this?"),
    (1, 3, "Summarize these."),
    (1, 4, "Create a revision roadmap."),
    (1, 5, "Schedule this for the next 3 days."),
    (1, 6, "Yes, do that."),
    (2, 0, "Find the screenshot of my Python login error."),
    (2, 1, "Find that confused guy meme."),
    (3, 0, "Find my handwritten database notes."),
    (4, 0, "Find the CN notes with a large diagram."),
    (4, 1, "What is the weather?"),
]
WORDS = [("handwritten", "type", "handwritten"), ("large diagram", "visual", "diagram"), ("diagram", "visual", "chart"), ("cn", "topic", "computer networks")]


def turns(spark):
    raw = spark.createDataFrame([(c, t, "user", s) for c, t, s in SAID], TURNS)
    return cv.segment_searches(cv.label_intent(raw))


def searches(spark):
    asked = cv.triggered(turns(spark))
    clues = cv.extract_clues(asked, spark.createDataFrame(WORDS, LEXICON))
    context = cv.context_at(asked, cv.accumulate_context(asked))
    return cv.formulate(context, cv.clue_state(asked, clues, SLOTS))


def test_intents_and_segments(spark):
    got = {(r["conv_id"], r["turn"]): (r["intent"], r["segment"]) for r in turns(spark).collect()}
    assert [got[1, t][0] for t in range(7)] == ["search", "refine", "why", "summarize", "roadmap", "schedule", "confirm"]
    assert {got[1, t][1] for t in range(7)} == {1}
    assert got[2, 1] == ("search", 2) and got[4, 1] == ("out of scope", 1)


# How users speak, and what they want.
SPOKEN = [
    ("The screenshot where I fixed my Python login error.", ["search"]),
    ("That confused guy meme.", ["search"]),
    ("Find my plan for the trip", ["search"]),
    ("Find the calendar photo", ["search"]),
    ("Find the summary of chapter 2", ["search"]),
    ("Can you find my notes?", ["search"]),
    ("Show me the screenshot of my Python login error.", ["search"]),
    ("I remember it was handwritten", ["refine"]),
    ("No, I remember they were handwritten and had a big diagram.", ["refine"]),
    ("No, the one with the red button.", ["refine"]),
    ("Why this result?", ["why"]),
    ("Yes, that's the one.", ["confirm"]),
    ("Summarize these notes.", ["summarize"]),
    ("Summarize this and create a short plan.", ["summarize", "roadmap"]),
    ("Create a 3-day revision roadmap from these notes.", ["roadmap"]),
    ("Make a 3-day plan.", ["roadmap"]),
    ("Schedule it.", ["schedule"]),
    ("Schedule this for the next 3 days.", ["schedule"]),
    ("Remind me about step 1 tomorrow.", ["reminder"]),
    ("Find my CN notes and summarize them.", ["search", "summarize"]),
    ("Which screenshot had the login error?", ["search"]),
    ("What was that diagram about the OSI model?", ["search"]),
    ("Do you remember the meme about exams?", ["search"]),
    ("Is there a photo of the whiteboard with SQL joins?", ["search"]),
    ("How did that receipt from March look?", ["search"]),
    ("When did I save the train ticket?", ["search"]),
    ("Who sent me the invoice for the flat?", ["search"]),
    ("Are there notes on normalization?", ["search"]),
    ("Did I save a recipe with lentils?", ["search"]),
    ("What is the wifi password I took a picture of?", ["search"]),
    ("What time does my train leave, according to the ticket?", ["search"]),
    ("Hi, which slide explained deadlocks?", ["search"]),
    ("Hello! Find my CN notes", ["search"]),
    ("Thanks! Now summarize them.", ["summarize"]),
    ("Okay, summarize them.", ["summarize"]),
    ("Ok, no, the one with the red button.", ["refine"]),
    ("Has the poster a QR code?", ["search"]),
    ("What is the weather?", ["out of scope"]),
    ("What's the time now?", ["out of scope"]),
    ("How are you today?", ["out of scope"]),
    ("Who are you?", ["out of scope"]),
    ("What can you do for me?", ["out of scope"]),
    ("Are you sure?", ["out of scope"]),
    ("How does this work?", ["out of scope"]),
    ("What is it about?", ["out of scope"]),
    ("Thanks, that helps a lot", ["out of scope"]),
    ("Hi there", ["out of scope"]),
    ("Thank you!", ["out of scope"]),
    ("", ["out of scope"]),
]


def test_spoken_sentences(spark):
    raw = spark.createDataFrame([(1, i, "user", s) for i, (s, _) in enumerate(SPOKEN)], TURNS)
    got = {r["turn"]: (r["intent"], r["intents"]) for r in cv.label_intent(raw).collect()}
    assert {SPOKEN[i][0]: v for i, v in got.items()} == {s: (w[0], w) for s, w in SPOKEN}


def test_two_actions_are_both_bound(spark):
    raw = spark.createDataFrame([(1, 0, "user", "Find my notes"), (1, 1, "user", "Summarize this and create a short plan.")], TURNS)
    bound = cv.bind_actions(cv.label_intent(raw)).collect()
    assert sorted((r["intent"], r["query_id"]) for r in bound) == [("roadmap", "1:0"), ("summarize", "1:0")]


def test_long_phrases_of_the_lexicon_are_found(spark):
    said = spark.createDataFrame([(1, 0, 0, "It had a big red round button, I think")], "conv_id long, turn long, segment long, text string")
    words = [("red round button", "visual", "button"), ("big red round button", "visual", "big button"), ("it had a big red round", "type", "six")]
    got = cv.extract_clues(said, spark.createDataFrame(words, LEXICON)).collect()
    assert {(r["slot"], r["value"]) for r in got} == {("visual", "big button"), ("type", "six")}
    assert cv.extract_clues(said, spark.createDataFrame([], LEXICON)).count() == 0


def test_a_refinement_keeps_the_earlier_words_and_clues(spark):
    made = searches(spark)
    terms = {}
    for r in made.terms.collect():
        terms.setdefault(r["query_id"], set()).add(r["term"])
    assert terms["1:0"] < terms["1:1"] and "handwritten" in terms["1:1"]
    assert "login" not in terms["2:1"]
    clues = {}
    for r in made.clues.collect():
        clues.setdefault(r["query_id"], {})[r["slot"]] = r["value"]
    assert clues["1:0"] == {"topic": "computer networks"}
    assert clues["1:1"] == {"topic": "computer networks", "type": "handwritten"}
    assert clues["4:0"] == {"topic": "computer networks", "visual": "diagram"}


def test_representative_searches_find_their_item(spark, index):
    best = {r["query_id"]: r["image_id"] for r in rk.hybrid_search(searches(spark), index).filter("rank = 1").collect()}
    assert best["1:0"] in (1, 2) and best["2:0"] == 3 and best["3:0"] == 6 and best["4:0"] == 2


def test_a_meme_is_found_by_likeness_where_text_does_not_help(spark, index):
    base = searches(spark)
    vecs = spark.createDataFrame([("2:1", [0.0, 0.0, 0.0, 1.0])], "query_id string, query_vec array<float>")
    found = rk.hybrid_search(rk.QuerySet(base.terms, vecs, None, base.clues), index)
    assert found.filter("query_id = '2:1' AND image_id = 5 AND visual > 0.9").count() == 1


def test_actions_act_on_the_latest_retrieval(spark):
    got = {(r["conv_id"], r["turn"]): r for r in cv.bind_actions(turns(spark)).collect()}
    assert all(got[1, t]["query_id"] == "1:1" for t in range(2, 7))
    assert got[1, 6]["proposed_at"] == 5 and got[1, 3]["proposed_at"] is None


def test_why_speaks_only_of_signals_that_scored(spark, index):
    prepared = rk.prepare(searches(spark), index)
    ranked = rk.hybrid_search(prepared, index)
    explained = ex.explain(ranked)
    matched = ex.matched_terms(prepared.weighed, index, ranked)
    lines = ex.why(explained, matched).collect()
    assert not [r for r in lines if r["signal"] == "visual"]
    text = [r["line"] for r in lines if r["query_id"] == "2:0" and r["image_id"] == 3 and r["signal"] == "text"]
    assert "login" in text[0]
    audit = {r["evidence"]: r["ungrounded"] for r in ex.grounding_audit(explained, matched, index, prepared).collect()}
    assert set(audit.values()) == {0}
    forged = matched.withColumn("term", F.lit("invented"))
    audit = {r["evidence"]: r["ungrounded"] for r in ex.grounding_audit(explained, forged, index, prepared).collect()}
    assert audit["term"] > 0
    elsewhere = explained.withColumn("image_id", F.lit(8).cast("long")).withColumn("signal", F.explode(F.array(*[F.lit(s) for s in ("text", "visual", "metadata", "clue")])))
    audit = {r["evidence"]: (r["claims"], r["ungrounded"]) for r in ex.grounding_audit(elsewhere, matched, index, prepared).collect()}
    assert all(audit[s][0] == audit[s][1] > 0 for s in ("visual", "metadata", "clue"))


def test_roadmap_schedule_and_confirmation(spark, index, start):
    ranked = rk.hybrid_search(searches(spark), index, k=2).filter("query_id = '1:1'")
    summary = ac.summarize(ranked, index, 2).collect()
    assert sorted(r["pos"] for r in summary) == [1, 2]
    plan = ac.schedule(ac.roadmap(ranked, index, 5), start, 3)
    days = [str(r["day"]) for r in plan.orderBy("step").collect()]
    assert days == ["2025-01-06"] * 2 + ["2025-01-07"] * 2 + ["2025-01-08"]
    made = tables.stage(ac.propose(ac.find_deadlines(index.items), plan))
    reminders = made.filter("kind = 'reminder'").collect()
    assert [str(r["day"]) for r in reminders] == ["2024-05-17"]
    none = spark.createDataFrame([], "proposal_id string, confirmed boolean")
    yes, rest = ac.confirmed(made, none)
    assert yes.count() == 0 and rest.count() == made.count()
    answers = made.select("proposal_id", (F.col("kind") == "event").alias("confirmed"))
    yes, rest = ac.confirmed(made, answers)
    path = f"{tables.shared_dir(spark)}/events-{uuid.uuid4().hex}"
    ac.create_events(yes, path)
    ac.create_events(yes, path)
    assert spark.read.parquet(path).count() == yes.count() == 5 and rest.count() == 1


def test_relative_days_need_a_given_date(spark, start):
    said = spark.createDataFrame([(1, "Remind me tomorrow. Due March 3, 2024")], "image_id long, text string")
    assert [r["found"] for r in ac.find_deadlines(said).collect()] == ["March 3, 2024"]
    days = {str(r["day"]) for r in ac.find_deadlines(said, F.lit(start)).collect()}
    assert days == {"2024-03-03", "2025-01-07"}


def test_dates_in_other_forms_and_those_left_open(spark):
    text = "Due 15 March 2024. Or the 3rd of April, 2024. Or April 4th, 2024. Not 31/02/2024. On 25/12/2024 or 12/25/2023. On 03/04/2024! By May 7th. At 05/05/2025"
    said = spark.createDataFrame([(1, text)], "image_id long, text string")
    assert sorted(str(r["day"]) for r in ac.find_deadlines(said).collect()) == [
        "2023-12-25", "2024-03-15", "2024-04-03", "2024-04-04", "2024-12-25", "2025-05-05"
    ]
    assert {(r["found"], r["reason"]) for r in ac.unread_dates(said).collect()} == {("03/04/2024", "day and month"), ("May 7th", "no year")}


def test_rank_delta(spark):
    rows = [(1, 0, 5, 3), (1, 1, 5, 1), (1, 1, 6, 2)]
    got = rk.rank_delta(spark.createDataFrame(rows, "conv_id long, turn long, image_id long, rank int"))
    assert {(r["turn"], r["image_id"]): r["moved"] for r in got.collect()} == {(0, 5): None, (1, 5): 2, (1, 6): None}


def test_expansion_adds_terms_of_the_best_hits(spark, index):
    asked = spark.createDataFrame([(1, "osi", 1)], "query_id long, term string, tf long")
    wider = rt.expand(asked, rt.text_search(asked, index, 2), index, m=2, t=3)
    new = {r["term"] for r in wider.filter("added").collect()}
    assert len(new) == 3 and "osi" not in new
