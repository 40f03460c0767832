from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.functions import bounds, running, text as tx, vectors as vx
from recollect.plans import index


def test_tokens_and_runs(spark):
    row = (
        spark.createDataFrame([("Où est l'OSI-Model?",)], "text string")
        .select(tx.tokens("text").alias("w"))
        .select("w", tx.word_runs(F.col("w"), [1, 2]).alias("r"))
        .first()
    )
    assert row["w"] == ["où", "est", "l", "osi", "model"]
    assert {"osi model", "est l", "model"} <= set(row["r"])


def test_one_edit_keys_meet_for_every_near_pair(spark):
    pairs = [("großer", "grosser"), ("cat", "cart"), ("cat", "cut"), ("abc", "abc"), ("abc", "xyz")]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        F.arrays_overlap(tx.one_edit_keys("a"), tx.one_edit_keys("b")).alias("meet"),
        (F.levenshtein("a", "b") <= 1).alias("near"),
    ).collect()
    assert all(r["meet"] for r in got if r["near"])
    assert not got[-1]["meet"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_beyond_the_limit_with_a_hot_key(spark, monkeypatch, how):
    monkeypatch.setattr(bounds, "MAX_HOT_KEYS", 5)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    table = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    got = bounds.lookup(rows, table, "k", how, limit=0)
    want = rows.join(table, "k", how)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_blocks_cover_the_side(spark):
    side = spark.range(500).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("term"))
    seen = bounds.in_blocks(side, "query_id", lambda block: block, limit=2000)
    assert seen.exceptAll(side).count() == 0 and side.exceptAll(seen).count() == 0


def test_running_values_match_brute_force_across_blocks(spark):
    rnd = random.Random(3)
    data = {(k, t): (rnd.randint(1, 9) if rnd.random() < 0.4 else None) for k in range(3) for t in range(40)}
    df = spark.createDataFrame([(k, t, v) for (k, t), v in data.items()], "k int, t int, v int")
    block = running.blocks_of("t", 7)
    total = running.running_sum(df, ["k"], ["t"], F.coalesce("v", F.lit(0)), "s", block)
    last = running.running_last(total, ["k"], ["t"], F.col("v"), "at", block)
    both = running.running_last(last, ["k"], ["t"], F.col("v"), "before", block, include_row=False)
    rows = both.collect()
    assert len(rows) == len(data)
    for r in rows:
        said = [data[r["k"], t] for t in range(r["t"] + 1)]
        known = [v for v in said if v is not None]
        earlier = [v for v in said[:-1] if v is not None]
        assert r["s"] == sum(known)
        assert r["at"] == (known[-1] if known else None)
        assert r["before"] == (earlier[-1] if earlier else None)


def test_ties_do_not_leave_the_kernel():
    queries = pd.DataFrame({"query_id": range(50), "unit": [[1.0, 0.0]] * 50})
    items = pd.DataFrame({"image_id": np.arange(5000)[::-1], "unit": [[1.0, 0.0]] * 5000})
    got = vx.best_in_block(10)(queries, items)
    assert len(got) == 500 and set(got["image_id"]) == set(range(10))


def test_bucket_count_stays_below_what_spark_takes(spark, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_BYTES", 0.0001)
    items = spark.createDataFrame([(1, "x" * 1000)], "image_id long, text string")
    assert index.bucket_count(items) == index.MOST_BUCKETS


def test_other_entries_on_a_board_move_no_weights():
    """Entries of vectors have lists in some columns only, and may stand before those of terms."""
    import numpy as np
    import pyarrow as pa

    from recollect.functions import boards

    def entry(kind, **given):
        return {n: None for n in ("key", "ids", "at", "v1", "v2", "qb", "qn", "f1", "f2")} | {"kind": kind, "qb": 0} | given

    held = [entry(boards.TERM, key="a", at=[0, 2], v1=[1.0, 2.0], v2=[3.0, 4.0]), entry(boards.IDS, ids=[5, 6, 7])]
    asked = [entry(boards.TERM, key="a", qn=[1], f1=[10.0], f2=[100.0]), entry(boards.TERM, key="b", qn=[0], f1=[1.0], f2=[1.0])]
    vectors = [entry(boards.VECTORS, at=[1], v1=[1.0, 0.0])], [entry(boards.VECTORS, qn=[0], f1=[0.0, 1.0])]
    kinds = {"kind": pa.int32(), "key": pa.string(), "qb": pa.int64(), "ids": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "qn": pa.list_(pa.int32())}
    kinds |= {n: pa.list_(pa.float64()) for n in ("v1", "v2", "f1", "f2")}
    for left, right in ((vectors[0] + held, vectors[1] + asked), (held + vectors[0], asked + vectors[1])):
        row = {"shelf": 1, "chunk": 0, "held": left, "asked": right}
        struct = pa.list_(pa.struct(list(kinds.items())))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([row["held"]], struct), pa.array([row["asked"]], struct)], names=["shelf", "chunk", "held", "asked"])
        (board,) = boards._boards([batch])
        assert np.array_equal(board.terms("v1", "f1"), [[0, 0, 0], [10, 0, 20]])
        assert np.array_equal(board.terms("v2", "f2"), [[0, 0, 0], [300, 0, 400]])
        (top,) = boards.best_by_sum(1, "v1", "f1")([batch])
        assert top.to_pylist() == [{"qb": 0, "qn": 1, "image_id": 7, "score": 20.0}]


def test_best_of_many_shelves_are_those_of_all():
    import numpy as np

    from recollect.functions import boards

    rnd = np.random.default_rng(3)
    for k in (1, 4, 30):
        kept, every = boards._Kept(5, k), []
        for shelf in range(6):
            ids = np.sort(rnd.choice(1000, 12, replace=False) * 6 + shelf)
            scores, found = rnd.integers(0, 6, (5, 12)) / 2.0, rnd.random((5, 12)) < 0.7
            kept.add(ids, scores, found)
            every += [(q, -scores[q, i], ids[i]) for q, i in zip(*np.nonzero(found))]
        want = [x for q in range(5) for x in sorted(e for e in every if e[0] == q)[:k]]
        assert [(q, -s, i) for q, s, i in zip(kept.q, kept.scores, kept.ids)] == want


def clued(spark):
    from recollect.schemas import ITEMS

    texts = ["osi notes", "osi", "notes", "milk"]
    rows = [(i, None, None, None, None, None, texts[i % 4], None) for i in range(80)]
    return spark.createDataFrame(rows, ITEMS)


def test_clue_sets_meet_groups_of_items(spark, monkeypatch):
    """Before, every set of clues met every item."""
    from recollect.operators import retrieval as rt

    hits = [("osi", i) for i in range(80) if i % 4 < 2] + [("notes", i) for i in range(80) if i % 4 in (0, 2)]
    asked = spark.createDataFrame([(1, "text", "osi"), (1, "topic", "notes"), (2, "text", "notes"), (3, "text", "bread")], "query_id long, slot string, value string")
    scored, top_k = [], rt.top_k
    monkeypatch.setattr(rt, "top_k", lambda df, *a, **b: scored.append(df.count()) or top_k(df, *a, **b))
    found = rt.clue_top(asked, spark.createDataFrame(hits, "value string, image_id long"), 22).collect()
    got = {q: [(r["image_id"], r["score"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == q] for q in (1, 2, 3)}
    both, osi, notes = ([i for i in range(80) if i % 4 == n] for n in (0, 1, 2))
    assert got == {1: [(i, 1.0) for i in both] + [(i, 0.5) for i in sorted(osi + notes)[:2]], 2: [(i, 1.0) for i in sorted(both + notes)[:22]], 3: []}
    monkeypatch.undo()
    scored.clear()
    monkeypatch.setattr(rt, "top_k", lambda df, *a, **b: scored.append(df.count()) or top_k(df, *a, **b))
    rt.clue_top(asked, spark.createDataFrame(hits, "value string, image_id long"), 3).collect()
    assert scored == [15]  # of two sets and their groups, 3 and 2, the three lowest ids


def test_postings_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    from recollect.operators import signals as sg

    plain = sg.postings(clued(spark))
    monkeypatch.setattr(sg, "TASK_BYTES", 10)
    cut = sg.postings(clued(spark))
    assert cut.rdd.getNumPartitions() == 42  # 420 bytes of text
    assert sorted(cut.collect()) == sorted(plain.collect())


def test_tfidf_splits_texts_once(spark, archive):
    """The weights are read from written rows: texts are not split again for the lengths."""
    from recollect.operators import signals

    post = signals.postings(archive, 2)
    _, terms = signals.corpus_stats(post)
    plan = signals.tfidf(post, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_a_turn_is_one_entry_of_the_live_state():
    """Each entry read or written is a call to the state server, so that a turn of many terms must not be many."""
    from recollect.streaming import live

    class Entries(dict):
        written = 0

        def updateValue(self, key, value):
            self.written += 1
            self[key] = value

        def iterator(self):
            return iter(list(self.items()))

    maps = []
    handle = type("Handle", (), {"getMapState": lambda self, *a: maps.append(Entries()) or maps[-1]})()
    state = live.LiveContext()
    state.init(handle)
    rows = [(t, "refine", "term", "", f"t{t}-{i}") for t in range(3) for i in range(10)]
    changes = [c for part in (rows[:10], rows[10:]) for c in state.handleInputRows((7,), iter([pd.DataFrame(part, columns=["turn", "intent", "part", "name", "value"])]), None)]
    assert sum(len(c) for c in changes) == 10 + 20 + 30 and sum(m.written for m in maps) == 3


def test_corpus_stats_of_texts_need_no_postings(spark, archive, monkeypatch):
    """The same as from postings; texts are not shuffled by their ids, and are split once."""
    from recollect.operators import signals

    made = []
    monkeypatch.setattr(signals, "stage", lambda df, *a: made.append(df) or df)
    corpus, terms = signals.text_stats(archive)
    want_corpus, want = signals.corpus_stats(signals.postings(archive, 2))
    assert sorted(terms.collect()) == sorted(want.collect())
    assert corpus.collect() == want_corpus.collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "hashpartitioning(term" in plan and "hashpartitioning(image_id" not in plan


def test_a_conversation_is_one_entry_of_the_clue_state():
    """One read and one write of the state for all turns of a conversation in a batch, none if nothing new was said."""
    from recollect.streaming import live

    class Entry:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    entry = Entry()
    state = live.ClueState()
    state.init(type("Handle", (), {"getValueState": lambda self, *a: entry})())

    def arrive(*rows):
        frames = [pd.DataFrame([row], columns=["turn", "intent", "slot", "value"]) for row in rows]
        return [tuple(r) for part in state.handleInputRows((7,), iter(frames), None) for r in part.itertuples(index=False)]

    assert arrive((0, "search", "type", "notes"), (3, "refine", "topic", "b"), (3, "refine", "look", "dark")) == [
        (7, 0, 1, "type", "notes"),
        *[(7, 3, 1, *said) for said in (("type", "notes"), ("look", "dark"), ("topic", "b"))],
    ]
    assert entry.calls == 2
    assert arrive((2, "search", None, None), (4, "why", None, None)) == [(7, 4, 2, "look", "dark"), (7, 4, 2, "topic", "b")]
    assert arrive((1, "why", None, None)) == [(7, 1, 1, "type", "notes")] and entry.calls == 5


def _found_items(spark):
    """An index of texts of few words, many of them of equal weight, and what queries found in it, some of it twice."""
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rnd = random.Random(7)
    texts = {i: " ".join(rnd.choices([f"w{n:02}" for n in range(70)], k=rnd.randint(1, 30))) for i in range(1, 41)}
    rows = [(i, f"s{i % 2}", None, None, None, None, text, None) for i, text in texts.items()]
    pairs = [(q, i) for q in range(100, 130) for i in rnd.choices(list(texts), k=4)]
    return build_index(spark.createDataFrame(rows, ITEMS), dim=4, buckets=2), spark.createDataFrame(pairs, "query_id long, image_id long")


def test_roadmap_shuffles_no_terms_of_pairs(spark, monkeypatch):
    import re

    from recollect.operators import actions as ac, retrieval as rt, shelves

    index, found = _found_items(spark)
    monkeypatch.setattr(shelves, "FOUND_PAIRS", 40)  # several blocks of queries
    plan = ac.roadmap(found, index)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, (term|topic)#", plan._jdf.queryExecution().executedPlan().toString())
    sums, weight = {}, {}
    for r in rt.weights_of(found, index).collect():
        weight.setdefault(r["image_id"], []).append((r["term"], r["w"]))
    for q, i in found.collect():
        for term, w in weight[i]:
            sums[q, term] = sums.get((q, term), 0.0) + w
    want = {}
    for q in {q for q, _ in sums}:
        heavy = sorted((-round(w, 6), term) for (p, term), w in sums.items() if p == q)[:5]
        want |= {(q, n + 1): (term, -w) for n, (w, term) in enumerate(heavy)}
    got = {(r["query_id"], r["step"]): (r["topic"], r["weight"]) for r in plan.collect()}
    assert got == want and len(want) > 100


def test_found_items_come_to_a_task_once(spark, monkeypatch):
    """Before, all that queries found came with each part of the postings."""
    import pyarrow as pa

    from recollect.functions import boards
    from recollect.operators import shelves

    index, found = _found_items(spark)

    def counted(k):
        def run(batches):
            rows = [(batch.column(n).null_count, batch.num_rows) for batch in batches for n in ("held", "asked")]
            held, asked = (sum(n - none for none, n in rows[i::2]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([asked], pa.int32()), pa.array([str(held)]), pa.array([0.0])], names=["qb", "qn", "term", "weight"])

        return run

    monkeypatch.setattr(boards, "heaviest_terms", counted)
    monkeypatch.setattr(shelves, "named", lambda rows, numbers: rows)
    tasks = [(int(r["term"]), r["qn"]) for r in shelves.heaviest_terms(found, index, 2).collect()]
    assert sum(held for held, _ in tasks) > 12 and all(asked == 1 for held, asked in tasks if held)


def test_topics_are_the_same_in_pieces(monkeypatch):
    """However few pairs are added up at once, and however the terms are dealt to rows."""
    import pyarrow as pa

    from recollect.functions import boards

    rnd = random.Random(3)
    held = [{"term": f"t{t}", "idf": 1.0 + t % 3, "shelf": s, "at": (at := sorted(rnd.sample(range(20), 6))), "ltf": [rnd.choice((0.25, 0.5)) for _ in at]} for t in range(60) for s in (-5, 9)]
    asked = [{"shelf": s, "at": at, "qn": sorted(rnd.choices(range(8), k=3))} for s in (-5, 9, 11) for at in range(0, 20, 2)]
    sums = {}
    for h in held:
        for a in asked:
            if a["shelf"] == h["shelf"] and a["at"] in h["at"]:
                for q in a["qn"]:
                    sums[q, h["term"]] = sums.get((q, h["term"]), 0.0) + h["ltf"][h["at"].index(a["at"])] * h["idf"]
    k = 2 + boards.SPARE
    want = {q: sorted((-w, t) for (p, t), w in sums.items() if p == q)[:k] for q in range(8)}
    entry = pa.list_(pa.struct([("term", pa.string()), ("idf", pa.float64()), ("shelf", pa.int64()), ("at", pa.list_(pa.int32())), ("ltf", pa.list_(pa.float64()))]))
    found = pa.list_(pa.struct([("shelf", pa.int64()), ("at", pa.int32()), ("qn", pa.list_(pa.int32()))]))
    rnd.shuffle(held)
    parts = [[h for h in held if int(h["term"][1:]) % 4 == p] for p in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(parts, entry), pa.array([6] * 4), pa.array([asked] * 4, found)], names=["held", "qb", "asked"])
    for most in (1, 50, 1_000_000):
        monkeypatch.setattr(boards, "LIGHT_AT_ONCE", most)
        got = {}
        for out in boards.heaviest_terms(2)([batch]):
            for r in out.to_pylist():
                assert r["qb"] == 6
                got.setdefault(r["qn"], []).append((-r["weight"], r["term"]))
        assert {q: sorted(rows) for q, rows in got.items()} == want


def test_signals_in_another_order_rank_the_same(spark, index, monkeypatch):
    """Entries of a board may come in any order: results, explanations and places of targets are the same."""
    from recollect.operators import evaluation as ev, ranking as rk, together

    terms = spark.createDataFrame([(1, "osi", 1), (1, "model", 1), (2, "python", 1), (2, "error", 2)], "query_id long, term string, tf long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0, 0.5, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "query_id long, query_vec array<double>")
    filters = spark.createDataFrame([(1, "source", "phone"), (2, "lang", "en")], "query_id long, field string, value string")
    clues = spark.createDataFrame([(1, "topic", "networks"), (2, "topic", "login")], "query_id long, slot string, value string")
    queries = rk.QuerySet(terms, vecs, filters, clues)
    truth = spark.createDataFrame([(1, 2), (2, 3)], "query_id long, image_id long")
    made = together.signal_rows

    def results():
        prepared = rk.prepare(queries, index)
        ranked = sorted(map(tuple, rk.hybrid_search(prepared, index).collect()), key=str)
        return ranked, sorted(map(tuple, ev.ablate(prepared, index, truth).collect()), key=str)

    want = results()
    monkeypatch.setattr(together, "signal_rows", lambda *a: tuple(side[::-1] for side in made(*a)))
    assert results() == want and want[0]
