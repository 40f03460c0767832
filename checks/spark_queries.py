"""One query per operator over the given tables. Oracles are in ``checks.oracle``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from checks import adapters as A
from recollect.functions import text as tx
from recollect.operators import (
    actions as ac,
    conversation as cv,
    evaluation as ev,
    explanation as ex,
    history as hi,
    intake,
    ranking as rk,
    retrieval as rt,
    signals as sg,
)
from recollect.plans import segments
from recollect.schemas import SLOTS
from recollect.sources import archive, tables
from recollect.streaming import arrivals, events, live

START = dt.date(2025, 1, 6)
DAYS = 3
GRID = (
    {"text": 1.0},
    {"text": 1.0, "semantic": 1.0},
    {"text": 1.0, "visual": 1.0},
    {"text": 0.5, "metadata": 1.0, "clue": 0.5},
    rk.EQUAL_WEIGHTS,
)


def whole(df: DataFrame, *ints: str, places: dict[str, int] | None = None) -> DataFrame:
    """Counts as LONG and measures rounded, as the comparison needs them."""
    for name in ints:
        df = df.withColumn(name, F.col(name).cast("long"))
    for name, n in (places or {}).items():
        df = df.withColumn(name, F.round(name, n))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"


# Intake


def in1(spark, sf):
    docs = archive.scan_archive(spark, f"{sf}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("image_id"), "source", "lang", "n_chars", F.length("text").cast("long").alias("read_chars")
    )


def _pages(spark, sf):
    return A.table(spark, sf, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("image_id"), F.col("url").alias("uri"), F.col("html").alias("text")
    )


def _docs(spark, sf):
    return A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), "source", F.create_map(F.lit("lang"), F.col("lang")).alias("meta"), "text"
    )


def _common(df):
    return df.select(
        "image_id",
        "source",
        "uri",
        F.col("file_info.name").alias("file_name"),
        F.try_element_at("meta", F.lit("lang")).alias("lang"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.length("text").cast("long").alias("n_chars"),
        F.size("embedding").cast("long").alias("dims"),
    )


def in2(spark, sf):
    vecs = A.table(spark, sf, "embeddings").select((F.col("vec_id") + 2_000_000_000).alias("image_id"), "embedding")
    return _common(archive.normalize(_docs(spark, sf), _pages(spark, sf), vecs))


def in3(spark, sf):
    docs = _docs(spark, sf)
    vecs = A.table(spark, sf, "embeddings")
    short = vecs.select(
        (F.col("vec_id") + 2_000_000_000).alias("image_id"),
        F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"),
    )
    nameless = A.table(spark, sf, "benchmark").select(F.lit(None).cast("long").alias("image_id"), "text")
    empty = A.table(spark, sf, "labels").select(
        (F.col("doc_id") + 3_000_000_000).alias("image_id"), F.lit(" ... ").alias("text")
    )
    arrived = archive.normalize(docs, docs.filter("source = 'src1'"), docs.filter("source = 'src1'"), short, nameless, empty)
    ok, bad = intake.validate(arrived, A.DIM)
    return ok.select("image_id", F.lit("accepted").alias("verdict"), F.lit(1).cast("long").alias("copies")).unionByName(
        bad.select("image_id", F.col("reason").alias("verdict"), "copies")
    )


def in4(spark, sf):
    raw = archive.normalize(_docs(spark, sf), _pages(spark, sf))
    ok, _ = intake.validate(raw, A.DIM)
    return intake.provenance_audit(raw, ok)


def in6(spark, sf):
    return _common(archive.land_source(_pages(spark, sf), "web export"))


def _status(spark, sf):
    return A.table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"),
        F.lit("archive").alias("source"),
        F.col("event_type").alias("stage"),
        F.when(F.col("value") > 10, "done").otherwise("waiting").alias("state"),
        F.col("ts").alias("at"),
        "event_id",
    )


def in7(spark, sf):
    return intake.status_rollup(_status(spark, sf))


def in8(spark, sf):
    path = fresh_path(spark, "status")
    tables.write_table(_status(spark, sf), path, ["stage"])
    latest = tables.read_latest(spark, path, ["image_id", "stage"], "at")
    return latest.select("image_id", "stage", "state", "event_id")


def in5(spark, sf):
    incoming, out, ckpt = (fresh_path(spark, n) for n in ("incoming", "taken", "progress"))
    A.items(spark, sf).write.parquet(incoming)
    query = arrivals.stream_ingest(spark, incoming, out, ckpt, A.DIM)
    query.awaitTermination()
    taken = spark.read.parquet(f"{out}/items")
    return taken.select("image_id", "source", F.length("text").cast("long").alias("n_chars"))


def in5_search(spark, sf):
    """Items arrive in five drops, are indexed as they come, and all are searched."""
    incoming, out, ckpt, grown = (fresh_path(spark, n) for n in ("incoming", "taken", "progress", "segments"))
    items = tables.stage(A.items(spark, sf), "items")
    for drop in range(5):
        items.filter(F.pmod(F.xxhash64("image_id"), F.lit(5)) == drop).coalesce(1).write.mode("append").parquet(incoming)
    arrivals.stream_ingest(spark, incoming, out, ckpt, A.DIM, files_per_batch=1, index=grown).awaitTermination()
    return whole(segments.search_segments(A.query_terms(spark, sf), grown).select(*HIT), "rank")


# Signals


def sg1(spark, sf):
    return sg.tokenize(A.items(spark, sf))


def sg2(spark, sf):
    return sg.postings(A.items(spark, sf))


def sg3(spark, sf):
    corpus, terms = sg.text_stats(A.items(spark, sf))
    return whole(
        terms.select(
            "term",
            "df",
            "bm_idf",
            "idf",
            corpus.select("n_docs").scalar().alias("n_docs"),
            corpus.select("n_tokens").scalar().alias("n_tokens"),
            corpus.select("avg_dl").scalar().alias("avg_dl"),
        ),
        places={"bm_idf": 6, "idf": 6, "avg_dl": 6},
    )


def sg4(spark, sf):
    units = sg.prepare_vectors(A.items(spark, sf), A.DIM)
    return units.select("image_id", F.round("norm", 6).alias("norm"), F.posexplode("unit").alias("pos", "x")).select(
        "image_id", "norm", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


def sg5(spark, sf):
    ix = A.index(spark, sf)
    return whole(sg.tfidf(ix.counted, ix.known), places={"w": 6})


def sg6(spark, sf):
    """Every vector with whether no centroid is nearer to it than that of its cell."""
    centroids, cells = A.cells(spark, sf)
    distance = F.aggregate(F.zip_with("unit", "_center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    centers = centroids.select(F.col("cell").alias("_cell"), F.col("center").alias("_center"))
    far = cells.join(F.broadcast(centers)).select("image_id", "cell", "_cell", distance.alias("d"))  # 16 centroids
    own = F.max(F.when(F.col("cell") == F.col("_cell"), F.col("d")))
    return far.groupBy("image_id").agg((own <= F.min("d") + 1e-9).alias("nearest"))


def _records(spark, sf):
    ix = A.index(spark, sf)
    return sg.assemble(ix.items, ix.vectors, ix.docs)


def sg7(spark, sf):
    rec = _records(spark, sf)
    return rec.select(
        "image_id",
        "source",
        F.try_element_at("meta", F.lit("lang")).alias("lang"),
        F.round("norm", 6).alias("norm"),
        "dl",
        "n_terms",
        "has_text",
        "has_vector",
        "has_ts",
    )


def sg8(spark, sf):
    return sg.coverage(_records(spark, sf))


def sg9(spark, sf):
    rec = _records(spark, sf).withColumn("lang", F.try_element_at("meta", F.lit("lang")))
    return sg.facets(rec, ["source", "lang", "has_vector"])


# Retrieval

HIT = ["query_id", "image_id", "score", "rank"]


def rt1(spark, sf):
    return whole(rt.text_search(A.query_terms(spark, sf), A.index(spark, sf)).select(*HIT), "rank")


def _weighed(spark, sf):
    return tables.stage(rt.weigh_terms(A.query_terms(spark, sf), A.index(spark, sf)), "weighed")


SMALL_LIMIT = 20_000  # bytes of a broadcast, to take the ways around one


def rt1_pruned(spark, sf):
    found = rt.best_by_terms(_weighed(spark, sf), A.index(spark, sf), rt.TEXT, 10, sum_rows=0)
    return whole(found.select(*HIT), "rank")


def rt4_pruned(spark, sf):
    found = rt.best_by_terms(_weighed(spark, sf), A.index(spark, sf), rt.SEMANTIC, 10, SMALL_LIMIT, sum_rows=0)
    return whole(found.select(*HIT), "rank")


def rt1_blocks(spark, sf):
    found = rt.text_search(A.query_terms(spark, sf), A.index(spark, sf), 10, SMALL_LIMIT)
    return whole(found.select(*HIT), "rank")


def rt2(spark, sf):
    words = A.user_turns(spark, sf).select("query_id", tx.tokens("text").alias("w"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " ")
    )
    phrases = words.filter(F.size("w") >= 2).select("query_id", F.explode(pairs).alias("phrase"))
    return rt.phrase_match(phrases, A.index(spark, sf))


def rt3(spark, sf):
    return rt.fuzzy_terms(A.query_terms(spark, sf), A.index(spark, sf).known, stored=A.neighbours(spark, sf))


def rt4(spark, sf):
    return whole(rt.semantic_search(A.query_terms(spark, sf), A.index(spark, sf)).select(*HIT), "rank")


def rt5(spark, sf):
    terms, ix = A.query_terms(spark, sf), A.index(spark, sf)
    return rt.expand(terms, rt.text_search(terms, ix), ix)


def rt6(spark, sf):
    return whole(rt.search_vector_blocks(A.query_vecs(spark, sf), A.index(spark, sf).facing).select(*HIT), "rank")


def rt7(spark, sf):
    found = rt.search_codes(A.query_vecs(spark, sf), A.codes(spark, sf), A.index(spark, sf).vectors, 10)
    return whole(found.select(*HIT), "rank")


def rt7_all(spark, sf):
    found = rt.vector_search_ann(A.query_vecs(spark, sf), *A.cells(spark, sf), 10, 16)
    return whole(found.select(*HIT), "rank")


def rt8(spark, sf):
    docs = rt.metadata_filter(A.table(spark, sf, "documents"), {"lang": "en", "source": "src7"})
    return docs.select(F.col("doc_id").alias("image_id"), "lang", "source")


def _text_pairs(spark, sf):
    return rt.text_search(A.query_terms(spark, sf), A.index(spark, sf)).select("query_id", "image_id")


def rt8_pairs(spark, sf):
    return rt.passing_pairs(_text_pairs(spark, sf), A.query_filters(spark, sf), A.index(spark, sf).items)


def rt9(spark, sf):
    found = rt.metadata_score(_text_pairs(spark, sf), A.query_filters(spark, sf), A.index(spark, sf).items)
    return whole(found, places={"score": 6})


def rt9_top(spark, sf):
    return whole(rt.metadata_best(A.query_filters(spark, sf), A.index(spark, sf), 10), "rank")


def rt10(spark, sf):
    clues = A.query_clues(spark, sf)
    hits = rt.clue_hits(clues, A.index(spark, sf))
    return whole(rt.clue_score(_text_pairs(spark, sf), clues, hits), places={"score": 6})


def rt10_top(spark, sf):
    clues = A.query_clues(spark, sf)
    return whole(rt.clue_top(clues, rt.clue_hits(clues, A.index(spark, sf)), 10), "rank")


def rt11(spark, sf):
    """Top 3 rows per customer by order value."""
    orders = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("score")
    )
    return whole(rt.top_k(orders, 3), "rank")


def _ranked(spark, sf):
    return A.ranked(spark, sf)


SCORED = ["query_id", "image_id", "text", "semantic", "visual", "metadata", "clue", "final", "rank"]


def rt12(spark, sf):
    return whole(rk.hybrid_search(A.queries(spark, sf), A.index(spark, sf)).select(*SCORED), "rank")


def _updated(spark, sf):
    """The same queries after all user turns of their conversation."""
    said = A.user_turns(spark, sf)
    words = said.select("conv_id", F.explode(tx.tokens("text")).alias("term"))
    of_conv = words.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = said.select("query_id", "conv_id").join(of_conv, "conv_id").select("query_id", "term", "tf")
    old = A.queries(spark, sf)
    return rk.QuerySet(terms, old.vecs, old.filters, old.clues)


def rt13_rerank(spark, sf):
    found = rk.refine(_updated(spark, sf), A.index(spark, sf), _ranked(spark, sf), "rerank")
    return whole(found.select(*SCORED), "rank")


def rt13_requery(spark, sf):
    return whole(rk.refine(_updated(spark, sf), A.index(spark, sf)).select(*SCORED), "rank")


def _turn_results(spark, sf):
    """Text results of every retrieving turn, from the context of the conversation so far."""
    turns = _retrieving(spark, sf)
    found = rt.context_search(turns, cv.accumulate_context(turns), A.index(spark, sf))
    return found.select("conv_id", "turn", "image_id", F.col("rank").cast("long").alias("rank"))


def rt14(spark, sf):
    return rk.rank_delta(_turn_results(spark, sf))


def _truth(spark, sf):
    return A.user_turns(spark, sf).select("query_id", F.col("conv_id").alias("image_id"))


def rt15(spark, sf):
    tuned = rk.tune_weights(A.prepared(spark, sf), A.index(spark, sf), _truth(spark, sf), GRID)
    return whole(tuned, "setting")


# Explanation


def _matched(spark, sf):
    return ex.matched_terms(A.prepared(spark, sf).weighed, A.index(spark, sf), _ranked(spark, sf))


def ex1(spark, sf):
    return whole(ex.explain(_ranked(spark, sf)), "rank")


def ex2(spark, sf):
    return whole(_matched(spark, sf), "place")


def ex3(spark, sf):
    found, prepared = _ranked(spark, sf), A.prepared(spark, sf)
    fields = rt.matched_fields(found, prepared.queries.filters, A.index(spark, sf).items)
    clues = rt.matched_clues(found, prepared.queries.clues, prepared.clue_hits)
    return whole(ex.why(ex.explain(found), _matched(spark, sf), fields, clues), "rank")


def ex4(spark, sf):
    return ex.grounding_audit(ex.explain(_ranked(spark, sf)), _matched(spark, sf), A.index(spark, sf), A.prepared(spark, sf))


def ex4_forged(spark, sf):
    """The same claims made of another item: most have nothing behind them."""
    other = (F.col("image_id") + 1).alias("image_id")
    explained, matched = ex.explain(_ranked(spark, sf)), _matched(spark, sf)
    forged = [df.select(*[other if c == "image_id" else c for c in df.columns]) for df in (explained, matched)]
    return ex.grounding_audit(*forged, A.index(spark, sf), A.prepared(spark, sf))


# Conversation


def cv1(spark, sf):
    return cv.label_intent(A.turns(spark, sf)).select("conv_id", "turn", "role", "intent")


def cv2(spark, sf):
    return cv.segment_searches(cv.label_intent(A.turns(spark, sf))).select("conv_id", "turn", "segment")


def _retrieving(spark, sf):
    return cv.triggered(A.labelled(spark, sf))


def _clues(spark, sf):
    return cv.extract_clues(_retrieving(spark, sf), A.lexicon(spark))


def cv3(spark, sf):
    return _clues(spark, sf)


def cv4(spark, sf):
    turns = _retrieving(spark, sf)
    return cv.context_at(turns, cv.accumulate_context(turns))


def cv5(spark, sf):
    user = A.labelled(spark, sf).filter("role = 'user'")
    return cv.clue_state(user, _clues(spark, sf), SLOTS)


def _formulated(spark, sf):
    turns = _retrieving(spark, sf)
    state = cv.clue_state(turns, _clues(spark, sf), SLOTS)
    return cv.formulate(cv.context_at(turns, cv.accumulate_context(turns)), state)


def cv6(spark, sf):
    made = _formulated(spark, sf)
    terms = made.terms.select("query_id", F.lit("term").alias("part"), F.lit("").alias("name"), F.col("term").alias("value"))
    clues = made.clues.select("query_id", F.lit("clue").alias("part"), F.col("slot").alias("name"), "value")
    return terms.unionByName(clues)


def cv7(spark, sf):
    return cv.trigger_counts(A.labelled(spark, sf))


def cv8(spark, sf):
    return cv.bind_actions(A.labelled(spark, sf).filter("role = 'user'"))


def cv9(spark, sf):
    """All turns as a stream of three batches; its result must be the batch clue state."""
    incoming, out, ckpt = (fresh_path(spark, n) for n in ("turns", "live", "progress"))
    user = A.labelled(spark, sf).filter("role = 'user'")
    rows = tables.stage(live.clued(user, _clues(spark, sf)), "clued")
    for part in ("turn < 2", "turn >= 2 AND turn < 4", "turn >= 4"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(incoming)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    stream = live.stream_context(arriving)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.option("checkpointLocation", ckpt)
            .trigger(availableNow=True)
            .outputMode("append")
            .format("parquet")
            .start(out)
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out).select("conv_id", "turn", "slot", "value")


def _streamed(spark, rows, name, make, parts, ckpt, out):
    """``make`` of a stream of ``rows`` that arrive by ``parts``, written to ``out``."""
    incoming = fresh_path(spark, name)
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(incoming)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = make(arriving).writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
        stream.outputMode("append").format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(key, before)


def cv9_live(spark, sf):
    """All turns as a stream, some of them late; what is left after all changes must be the batch context and clue state."""
    out, ckpt = fresh_path(spark, "answers"), fresh_path(spark, "progress")
    user = A.labelled(spark, sf).filter("role = 'user'")
    rows = tables.stage(live.said_turns(user, _clues(spark, sf)), "said")
    late = ("turn % 4 = 2", "turn % 4 = 0 AND conv_id % 2 = 0", "turn % 4 <> 2 AND NOT (turn % 4 = 0 AND conv_id % 2 = 0)")
    _streamed(spark, rows, "turns", live.stream_answers, late, ckpt, out)
    return live.settled(spark.read.parquet(out))


# Actions


def ac1(spark, sf):
    return whole(ac.summarize(_ranked(spark, sf), A.index(spark, sf)), "pos")


def ac2(spark, sf):
    return whole(ac.roadmap(_ranked(spark, sf), A.index(spark, sf)), "step")


def _scheduled(spark, sf):
    return ac.schedule(ac.roadmap(_ranked(spark, sf), A.index(spark, sf)), START, DAYS)


def ac3(spark, sf):
    plan = whole(_scheduled(spark, sf), "step")
    return plan.select("query_id", "step", "topic", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _deadlines(spark, sf):
    texts = A.receipts(spark, sf).unionByName(A.items(spark, sf).select("image_id", "text"))
    return ac.find_deadlines(texts)


def ac4(spark, sf):
    return _deadlines(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _proposals(spark, sf):
    return ac.propose(_deadlines(spark, sf), _scheduled(spark, sf))


def ac5(spark, sf):
    return _proposals(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _confirmations(proposals):
    """A stand-in for the user's answers: yes to what falls in the first half of a month."""
    return proposals.select("proposal_id", (F.dayofmonth("day") <= 15).alias("confirmed"))


def ac6(spark, sf):
    made = _proposals(spark, sf)
    yes, rest = ac.confirmed(made, _confirmations(made))
    return yes.select("proposal_id", F.lit("confirmed").alias("state")).unionByName(
        rest.select("proposal_id", F.lit("proposed").alias("state"))
    )


def ac7(spark, sf):
    """Events first, then everything confirmed, then everything again."""
    made = tables.stage(_proposals(spark, sf), "proposals")
    yes, _ = ac.confirmed(made, _confirmations(made))
    path = fresh_path(spark, "events")
    ac.create_events(yes.filter("kind = 'event'"), path)
    ac.create_events(yes, path)
    ac.create_events(yes, path)
    return spark.read.parquet(path).select("proposal_id", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "title")


def ac7_streamed(spark, sf):
    """Confirmations arrive in overlapping drops, on two streams."""
    made = tables.stage(_proposals(spark, sf), "proposals")
    incoming, path = fresh_path(spark, "confirmations"), fresh_path(spark, "events")
    answers = _confirmations(made)
    for drop in ("proposal_id < '8'", "proposal_id > '4'", "true"):
        answers.filter(drop).coalesce(1).write.mode("append").parquet(incoming)
    for writer in ("one", "two"):
        arriving = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        events.stream_events(arriving, made, path, fresh_path(spark, "progress"), writer).awaitTermination()
    return events.read_events(spark, path).select("proposal_id", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "title")


# History and evaluation


def hi1(spark, sf):
    dated = A.history(spark, sf).select(F.col("event_id").alias("image_id"), "ts")
    undated = A.items(spark, sf).select("image_id", "ts")
    found = hi.timeline(dated.unionByName(undated), "month")
    return found.select(F.date_format("bucket", "yyyy-MM").alias("bucket"), "items")


def hi2(spark, sf):
    found = hi.history_summary(A.history(spark, sf))
    return found.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


def hi3(spark, sf):
    """What each user viewed last before each purchase."""
    history = A.history(spark, sf)
    anchors = history.filter("kind = 'purchase'").select(F.col("event_id").alias("anchor_id"), "user_id", "ts")
    return hi.viewed_before(history, anchors).select("anchor_id", "user_id", "event_id")


def _known_items(spark, sf):
    """Queries of the five heaviest terms of every document, whose answer is that document."""
    ix = A.index(spark, sf)
    order = Window.partitionBy("image_id").orderBy(F.col("w").desc(), "term")
    heavy = (
        sg.tfidf(ix.counted, ix.known)
        .withColumn("w", F.round("w", 6))
        .withColumn("n", F.row_number().over(order))
        .filter("n <= 5")
    )
    return heavy.select(F.col("image_id").alias("query_id"), "term", F.lit(1).cast("long").alias("tf"))


def ev1(spark, sf):
    terms = tables.stage(_known_items(spark, sf), "known_items")
    truth = terms.select("query_id", F.col("query_id").alias("image_id")).distinct()
    return ev.evaluate(rt.text_search(terms, A.index(spark, sf)), truth)


def ev2(spark, sf):
    return ev.ablate(A.prepared(spark, sf), A.index(spark, sf), _truth(spark, sf))


QUERIES = {
    "in1_scan_archive": in1,
    "in2_normalize": in2,
    "in3_validate": in3,
    "in4_provenance_audit": in4,
    "in5_stream_ingest": in5,
    "in5_search_as_it_arrives": in5_search,
    "in6_land_source": in6,
    "in7_status_rollup": in7,
    "in8_write_read_latest": in8,
    "sg1_tokenize": sg1,
    "sg2_postings": sg2,
    "sg3_corpus_stats": sg3,
    "sg4_prepare_vectors": sg4,
    "sg5_tfidf": sg5,
    "sg6_fit_cells": sg6,
    "sg7_assemble": sg7,
    "sg8_coverage": sg8,
    "sg9_facets": sg9,
    "rt1_text_search": rt1,
    "rt1_pruned": rt1_pruned,
    "rt1_blocks": rt1_blocks,
    "rt4_pruned": rt4_pruned,
    "rt2_phrase_match": rt2,
    "rt3_fuzzy_terms": rt3,
    "rt4_semantic_search": rt4,
    "rt5_expand": rt5,
    "rt6_vector_search": rt6,
    "rt7_vector_search_ann": rt7,
    "rt7_ann_all_cells": rt7_all,
    "rt8_metadata_filter": rt8,
    "rt8_passing_pairs": rt8_pairs,
    "rt9_metadata_score": rt9,
    "rt9_metadata_top": rt9_top,
    "rt10_clue_score": rt10,
    "rt10_clue_top": rt10_top,
    "rt11_top_k": rt11,
    "rt12_hybrid_search": rt12,
    "rt13_rerank": rt13_rerank,
    "rt13_requery": rt13_requery,
    "rt14_rank_delta": rt14,
    "rt15_tune_weights": rt15,
    "ex1_explain": ex1,
    "ex2_matched_terms": ex2,
    "ex3_why": ex3,
    "ex4_grounding_audit": ex4,
    "ex4_forged_evidence": ex4_forged,
    "cv1_label_intent": cv1,
    "cv2_segment_searches": cv2,
    "cv3_extract_clues": cv3,
    "cv4_context": cv4,
    "cv5_clue_state": cv5,
    "cv6_formulate": cv6,
    "cv7_triggered": cv7,
    "cv8_bind_actions": cv8,
    "cv9_stream_context": cv9,
    "cv9_live_answers": cv9_live,
    "ac1_summarize": ac1,
    "ac2_roadmap": ac2,
    "ac3_schedule": ac3,
    "ac4_find_deadlines": ac4,
    "ac5_propose": ac5,
    "ac6_confirmed": ac6,
    "ac7_create_events": ac7,
    "ac7_streamed_events": ac7_streamed,
    "hi1_timeline": hi1,
    "hi2_history_summary": hi2,
    "hi3_viewed_before": hi3,
    "ev1_evaluate": ev1,
    "ev2_ablate": ev2,
}
