from __future__ import annotations

import random
import uuid


from recollect.functions import bounds
from recollect.operators import retrieval as rt
from recollect.plans import segments
from recollect.plans.index import build_index
from recollect.schemas import ITEMS
from recollect.sources import ledger, tables
from recollect.streaming import events, live
from recollect.streaming.arrivals import stream_ingest


def test_two_drops_a_restart_and_a_repeated_file(spark, monkeypatch):
    base = f"{tables.shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def drop(ids):
        rows = [(i, "phone", None, None, None, None, f"note {i}", None) for i in ids]
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", files_per_batch=1).awaitTermination()
        return sorted(r["image_id"] for r in spark.read.parquet(f"{base}/out/items").collect())

    drop([1, 2, 2])
    assert run() == [1, 2]
    drop([2, 3])
    drop([1, 2])
    assert run() == [1, 2, 3]
    monkeypatch.setattr(bounds, "DEFAULT_LIMIT", 0)
    drop([3, 4])
    assert run() == [1, 2, 3, 4]


def test_runs_of_the_ledger_cover_all_batches_once():
    for number in range(300):
        runs = ledger.runs_before(number)
        assert [b for run in runs for b in range(*run)] == list(range(number))
        assert len(runs) <= (ledger.FAN - 1) * 5
        first, end = ledger.run_of(number)
        assert ledger.runs_before(number + 1) == [r for r in runs if r[1] <= first] + [(first, end)]


def test_ledger_reads_slots_of_asked_ids_only(spark):
    """Every taken id is found, none else, and a batch that runs again does not find its own."""
    path = f"{tables.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for number in range(6):
        ids = spark.range(number * 2000, number * 2000 + 2000).toDF("image_id")
        asked = spark.createDataFrame([(5,), (number * 2000 - 1,), (number * 2000,), (10**9,)], "image_id long")
        found = ledger.held(asked, path, number)
        assert sorted(r["image_id"] for r in found.collect()) == [5, number * 2000 - 1] if number else found is None
        for _ in range(2):
            ledger.enter(ids, path, number)
    again = ledger.held(spark.range(12_000).toDF("image_id"), path, 5)
    assert sorted(r["image_id"] for r in again.collect()) == list(range(10_000))
    one = ledger.held(spark.createDataFrame([(5,)], "image_id long"), path, 6)
    plan = one._jdf.queryExecution().executedPlan().toString()
    slot = spark.sql(f"SELECT pmod(xxhash64(5L), {ledger.SLOTS * 4}) AS slot").first()["slot"]
    assert f"= {slot})" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_target_older_than_its_ledger(spark):
    """Where runs are missing, the rows of the target say what was taken."""
    path = f"{tables.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    taken = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "image_id long, arrival int")
    asked = spark.createDataFrame([(1,), (3,), (4,)], "image_id long")
    assert sorted(r["image_id"] for r in ledger.held(asked, path, 4, taken).collect()) == [1, 3]
    assert [r["image_id"] for r in ledger.held(asked, path, 3, taken).collect()] == [1]
    ledger.enter(spark.createDataFrame([(4,)], "image_id long"), path, 4, taken)
    assert sorted(r["image_id"] for r in ledger.held(asked, path, 5, taken).collect()) == [1, 3, 4]


def test_late_turns_do_not_replace_newer_ones(spark):
    base = f"{tables.shared_dir(spark)}/live-{uuid.uuid4().hex}"
    schema = "conv_id long, turn long, intent string, slot string, value string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key)
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            stream = live.stream_context(spark.readStream.schema(schema).parquet(f"{base}/in"))
            out = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
            out.outputMode("append").format("parquet").start(f"{base}/out").awaitTermination()
        finally:
            spark.conf.set(key, before)

    arrive((1, 0, "search", "type", "notes"), (1, 3, "refine", "topic", "third"))
    arrive((1, 2, "refine", "topic", "second"), (1, 1, "why", None, None))
    arrive((1, 4, "why", None, None), (1, 5, "search", "topic", "new"))
    got = {}
    for r in spark.read.parquet(f"{base}/out").collect():
        got.setdefault((r["turn"], r["segment"]), {})[r["slot"]] = r["value"]
    assert got == {
        (0, 1): {"type": "notes"},
        (1, 1): {"type": "notes"},
        (2, 1): {"type": "notes", "topic": "second"},
        (3, 1): {"type": "notes", "topic": "third"},
        (4, 1): {"type": "notes", "topic": "third"},
        (5, 2): {"topic": "new"},
    }


def test_growing_index_is_searched_as_one(spark):
    """After every drop the search is that of an index of all items so far, before and after merging."""
    base = f"{tables.shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, None, None, None, None, None, " ".join(rnd.choices(words, k=rnd.randint(1, 20))) if i % 7 else None, None) for i in range(60)]
    asked = spark.createDataFrame([(q, f"w{q * 7 % 30 + j}", 1) for q in range(4) for j in range(4)] + [(9, "unknown", 1)], "query_id long, term string, tf long")
    assert segments.search_segments(asked, base, 5).count() == 0
    for drop in range(6):
        segments.add_segment(spark.createDataFrame(rows[drop * 10 : drop * 10 + 10], ITEMS), base, f"drop-{drop}", slots=4)
        segments.merge_segments(spark, base, most=2, slots=4)
        if drop == 4:  # the same drop once more: it was merged by now, or is replaced
            for again in (0, 4):
                segments.add_segment(spark.createDataFrame(rows[again * 10 : again * 10 + 10], ITEMS), base, f"drop-{again}", slots=4)
        if drop in (0, 2, 4, 5):
            got = segments.search_segments(asked, base, 5, slots=4).collect()
            want = rt.text_search(asked, build_index(spark.createDataFrame(rows[: drop * 10 + 10], ITEMS), 4, 1), 5).collect()
            assert {(r["query_id"], r["image_id"], r["score"], r["rank"]) for r in got} == {(r["query_id"], r["image_id"], r["score"], r["rank"]) for r in want}
    live_ones = segments.live_segments(spark, base)
    assert len(live_ones) == 2 and sorted(n for s in live_ones for n in s.holds) == [f"drop-{i}" for i in range(6)]


def test_segments_hold_a_term_once_for_each_shelf(spark):
    """Searches meet shelves, not single postings, also of merged segments, whose shelves are filled anew."""
    base = f"{tables.shared_dir(spark)}/shelved-{uuid.uuid4().hex}"
    for drop in range(3):
        rows = [(drop * 10 + i, None, None, None, None, None, f"all w{i} w{i}", None) for i in range(10)]
        segments.add_segment(spark.createDataFrame(rows, ITEMS), base, f"drop-{drop}", slots=4)
    segments.merge_segments(spark, base, most=1, slots=4)
    (merged,) = segments.live_segments(spark, base)
    held = spark.read.parquet(f"{base}/{merged.name}/postings").filter("term = 'all'").collect()
    assert [len(r["at"]) for r in held] == [30] and merged.postings == 60
    asked = spark.createDataFrame([(q, "all", 1) for q in range(5)], "query_id long, term string, tf long")
    assert segments.search_segments(asked, base, 4, slots=4).groupBy("image_id").count().collect() and segments.search_segments(asked, base, 4, slots=4).count() == 20


def test_events_are_created_once_by_replays_and_two_streams(spark):
    base = f"{tables.shared_dir(spark)}/confirm-{uuid.uuid4().hex}"
    made = spark.createDataFrame([(f"p{i}", "event", f"title {i}") for i in range(6)], "proposal_id string, kind string, title string")
    schema = "proposal_id string, confirmed boolean"

    def drop(*ids, yes=True):
        spark.createDataFrame([(f"p{i}", yes) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run(writer, ckpt):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        events.stream_events(stream, made, f"{base}/out", f"{base}/{ckpt}", writer).awaitTermination()
        return sorted(r["proposal_id"] for r in events.read_events(spark, f"{base}/out").collect())

    drop(0, 1, 1)
    drop(1, 2)
    drop(3, yes=False)
    assert run("a", "first") == ["p0", "p1", "p2"]
    assert run("a", "lost") == ["p0", "p1", "p2"]  # all batches once more, as after a lost checkpoint
    assert run("b", "other") == ["p0", "p1", "p2"]
    drop(3, 0)
    assert run("a", "first") == ["p0", "p1", "p2", "p3"]
    assert spark.read.parquet(f"{base}/out").count() == 4


def test_late_turns_take_back_what_no_longer_holds(spark):
    base = f"{tables.shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    turns = [(1, 0, "search", "osi notes"), (1, 1, "refine", "the handwritten one"), (1, 2, "search", "python error"), (1, 3, "refine", "red button"), (1, 4, "why", "why this")]
    turns += [(2, t, "search" if t == 0 else "refine", f"a{t} b{t}") for t in range(6)]
    said = spark.createDataFrame(turns, "conv_id long, turn long, intent string, text string")
    clues = spark.createDataFrame([(1, 0, "type", "notes"), (1, 1, "look", "handwritten"), (1, 2, "type", "error"), (2, 3, "type", "b")], "conv_id long, turn long, slot string, value string")
    rows = tables.stage(live.said_turns(said, clues))
    rnd = random.Random(2)
    order = [(c, t) for c, t, _, _ in turns]
    rnd.shuffle(order)
    order.sort(key=lambda o: o == (1, 2))  # a search that comes last of all
    for a in range(0, len(order), 3):
        part = " OR ".join(f"(conv_id = {c} AND turn = {t})" for c, t in order[a : a + 3])
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = live.stream_answers(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        out = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
        out.outputMode("append").format("parquet").start(f"{base}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    changes = spark.read.parquet(f"{base}/out")
    assert changes.filter("change = -1").count() > 0
    got = {(r["conv_id"], r["turn"], r["part"], r["name"], r["value"]) for r in live.settled(changes).collect()}
    want = set()
    for conv in (1, 2):
        terms, state = set(), {}
        for c, t, intent, text in turns:
            if c != conv:
                continue
            if intent == "search":
                terms, state = set(), {}
            if intent != "why":
                terms |= set(text.split())
                want |= {(c, t, "term", "", w) for w in terms}
            state |= {r["slot"]: r["value"] for r in clues.filter(f"conv_id = {c} AND turn = {t}").collect()}
            want |= {(c, t, "clue", s, v) for s, v in state.items()}
    assert got == want


def test_ended_conversations_are_forgotten(spark):
    """State goes once a conversation was idle; one that went on keeps its own."""
    base = f"{tables.shared_dir(spark)}/ended-{uuid.uuid4().hex}"
    schema = "conv_id long, turn long, intent string, part string, name string, value string"
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {key: spark.conf.get(key) for key in settings}
    drops = [[(1, 0, "search", "term", "", "old"), (1, 0, "search", "clue", "type", "notes")], [(2, 0, "search", "term", "", "other")], [(1, 1, "refine", "term", "", "new")]]
    got = {}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for idle in (1, 10**9):
            for drop in drops:
                spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(f"{base}/in-{idle}")
                stream = live.stream_answers(spark.readStream.schema(schema).parquet(f"{base}/in-{idle}"), idle)
                out = stream.writeStream.option("checkpointLocation", f"{base}/ckpt-{idle}").trigger(availableNow=True)
                assert out.outputMode("append").format("parquet").start(f"{base}/out-{idle}").awaitTermination(120)
            rows = spark.read.parquet(f"{base}/out-{idle}").filter("conv_id = 1 AND turn = 1")
            got[idle] = sorted((r["part"], r["value"], r["change"]) for r in rows.collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got[1] == [("term", "new", 1)]
    assert got[10**9] == [("clue", "notes", 1), ("term", "new", 1), ("term", "old", 1)]
