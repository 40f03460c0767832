from __future__ import annotations

import math
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import spark_queries
from recollect.functions import text as tx
from recollect.operators import ranking as rk, retrieval as rt, signals as sg


def terms_of(spark, said: dict):
    rows = spark.createDataFrame(list(said.items()), "query_id long, text string")
    words = rows.select("query_id", F.explode(tx.tokens("text")).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def hits(df):
    return {(r["query_id"], r["image_id"]): (r["score"], r["rank"]) for r in df.collect()}


def test_bm25_by_hand(spark, index):
    got = hits(rt.text_search(terms_of(spark, {1: "osi python"}), index, 10))
    n, avg = 7, index.corpus.first()["avg_dl"]
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    dl = {r["image_id"]: r["dl"] for r in index.docs.collect()}
    for (_, image), (score, _) in got.items():
        assert score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl[image] / avg)), abs=1e-6)
    assert {i for _, i in got} == {1, 2, 3, 4}


def test_blocks_of_queries_change_nothing(spark, index):
    asked = terms_of(spark, {i: t for i, t in enumerate(["osi notes", "python error", "notes keys", "milk"])})
    for search in (rt.text_search, rt.semantic_search):
        assert hits(search(asked, index, 3)) == hits(search(asked, index, 3, limit=60))


def test_pruning_changes_nothing(spark, monkeypatch):
    """Half the items are copies, every item has the frequent words, and ties are common."""
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rnd = random.Random(9)
    words = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25))) for _ in range(60)]
    texts += [texts[0]] * 60
    rows = [(i, None, None, None, None, None, "the of " + t, None) for i, t in enumerate(texts)]
    ix = build_index(spark.createDataFrame(rows, ITEMS), 4, 2)
    said = {i: "the of and " + " ".join(rnd.choice(words) for _ in range(6)) for i in range(12)}
    asked = terms_of(spark, said)
    for search in (rt.text_search, rt.semantic_search):
        for k in (2, 10, 100):
            monkeypatch.setattr(rt, "SUM_ROWS", 50_000_000)
            plain = hits(search(asked, ix, k))
            monkeypatch.setattr(rt, "SUM_ROWS", 0)
            assert hits(search(asked, ix, k)) == plain


def test_tfidf_vectors_have_unit_length(spark, archive):
    post = sg.postings(archive)
    _, terms = sg.corpus_stats(post)
    for limit in (None, 0):
        weights = sg.tfidf(post, terms, limit)
        lengths = [r[0] for r in weights.groupBy("image_id").agg(F.sum(F.col("w") * F.col("w"))).select("sum((w * w))").collect()]
        assert len(lengths) == 7 and all(abs(x - 1) < 1e-9 for x in lengths)


def test_phrases_short_and_long(spark, index):
    asked = spark.createDataFrame(
        [(1, "OSI model"), (2, "model OSI"), (3, "seven layers of computer networks"), (4, "seven layers of computer keys"), (5, "notes")],
        "query_id long, phrase string",
    )
    got = {(r["query_id"], r["image_id"]) for r in rt.phrase_match(asked, index).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (5, 1), (5, 6)}


def test_long_phrase_needs_its_order(spark):
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    text = "b c d e and a b c d"  # all runs of "a b c d e" but not in one piece
    ix = build_index(spark.createDataFrame([(1, None, None, None, None, None, text, None)], ITEMS), 4, 1)
    asked = spark.createDataFrame([(1, "a b c d e"), (2, "A b, c d"), (3, "b c d e and a b c d"), (4, "d e b"), (5, "..."), (6, None)], "query_id long, phrase string")
    assert sorted(r["query_id"] for r in rt.phrase_match(asked, ix).collect()) == [2, 3]


def test_fuzzy_terms_match_brute_force(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(2, 6))) for _ in range(120)}
    df = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["query_term"], r["term"]) for r in rt.fuzzy_terms(df, df, limit=0).collect()}
    stored = rt.fuzzy_terms(df, df.limit(0), stored=rt.neighbour_keys(df)).collect()
    assert {(r["query_term"], r["term"]) for r in stored} == got

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        s, l = sorted((a, b), key=len)
        return len(l) - len(s) == 1 and any(l[:i] + l[i + 1 :] == s for i in range(len(l)))

    def grams(a):
        return {a[i : i + 3] for i in range(len(a) - 2)}

    want = {(a, b) for a in words for b in words if near(a, b) and grams(a) & grams(b)}
    assert got == want


def vectors(spark, n, dim=8, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # a third are copies of one vector
    return spark.createDataFrame(rows, "image_id long, embedding array<float>")


def test_vector_search_in_blocks_matches_brute_force(spark, monkeypatch):
    raw = vectors(spark, 120)
    units = sg.prepare_vectors(raw, 8)
    asked = raw.filter("image_id < 20").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 25)
    monkeypatch.setattr(rt, "QUERY_BLOCK", 6)
    got = hits(rt.vector_search(asked, units, 5))
    vecs = {r["image_id"]: r["unit"] for r in units.collect()}
    for q in range(20):
        scores = sorted((-round(sum(a * b for a, b in zip(vecs[q], v)), 6), i) for i, v in vecs.items())[:5]
        assert [(q, i) in got for _, i in scores] == [True] * 5


def test_all_cells_equal_the_exact_search_and_fewer_lose_little(spark, monkeypatch):
    raw = vectors(spark, 200, seed=2)
    units = sg.prepare_vectors(raw, 8)
    asked = raw.filter("image_id < 30").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = hits(rt.vector_search(asked, units, 10))
    centroids, cells = rt.fit_cells(units, 8)
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 20)
    recall = []
    for nprobe in (1, 4, 8):
        got = hits(rt.vector_search_ann(asked, centroids, cells, 10, nprobe))
        recall.append(len(set(got) & set(exact)) / len(exact))
    assert recall[2] == 1.0 and recall[0] <= recall[1] <= 1.0 and recall[1] > 0.6
    assert hits(rt.vector_search_ann(asked, centroids, cells, 10, 8)) == exact


def test_registered_approximate_search_finds_nine_of_ten(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [{(r["query_id"], r["image_id"]) for r in q(spark, sf).collect()} for q in (spark_queries.rt6, spark_queries.rt7)]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0])


def test_measured_recall_is_that_of_the_search(spark):
    raw = vectors(spark, 200, seed=2)
    units = sg.prepare_vectors(raw, 8)
    asked = raw.filter("image_id < 30").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = set(hits(rt.vector_search(asked, units, 10)))
    centroids, cells = rt.fit_cells(units, 8)
    recall = rt.measured_recall(asked, centroids, cells, 10)
    for nprobe in (1, 3, 8):
        got = set(hits(rt.vector_search_ann(asked, centroids, cells, 10, nprobe)))
        assert len(got & exact) / len(exact) == pytest.approx(recall[nprobe - 1])


def test_unknown_metadata_passes_no_filter_and_scores_null(spark, index):
    pairs = spark.createDataFrame([(1, i) for i in (1, 3, 8)], "query_id long, image_id long")
    asked = spark.createDataFrame([(1, "source", "phone"), (1, "lang", "en")], "query_id long, field string, value string")
    scores = {r["image_id"]: r["score"] for r in rt.metadata_score(pairs, asked, index.items).collect()}
    assert scores == {1: 1.0, 3: 0.5, 8: None}
    assert [r["image_id"] for r in rt.passing_pairs(pairs, asked, index.items).collect()] == [1]
    assert {r["image_id"] for r in rt.metadata_filter(index.items, {"source": "phone"}).collect()} == {1, 2, 6}
    top = {r["image_id"]: r["score"] for r in rt.metadata_top(asked, index.items, 4).collect()}
    assert top == {1: 1.0, 2: 1.0, 6: 1.0, 3: 0.5}
    for n in (1, 3, 4, 8):
        ways = (rt.metadata_top(asked, index.items, n), rt.metadata_best(asked, index, n))
        assert hits(ways[0]) == hits(ways[1])


def test_a_tuned_target_far_down_is_counted(spark):
    """The target comes after some hundred items; its place is that in the whole corpus."""
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rows = [(i, None, None, None, None, None, "osi " * (1 + i % 5) + "notes " * (i % 3) + f"w{i}", None) for i in range(300)]
    ix = build_index(spark.createDataFrame(rows, ITEMS), 4, 2)
    asked = rk.QuerySet(terms_of(spark, {1: "osi notes"}))
    ranked = {r["image_id"]: r["rank"] for r in rk.hybrid_search(asked, ix, k=300).collect()}
    for target in (299, 150, 5):
        truth = spark.createDataFrame([(1, target)], "query_id long, image_id long")
        got = rk.tune_weights(asked, ix, truth, [rk.EQUAL_WEIGHTS, {"visual": 1.0}]).orderBy("setting").collect()
        assert got[0]["mrr"] == pytest.approx(1 / ranked[target], abs=1e-6)
        assert got[1]["mrr"] == pytest.approx(1 / (target + 1), abs=1e-6)
    assert max(ranked[t] for t in (299, 150, 5)) > 100


def test_codes_find_nine_of_ten_and_read_little(spark):
    raw = vectors(spark, 400, dim=16, seed=3)
    units = sg.prepare_vectors(raw, 16)
    asked = raw.filter("image_id < 30").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    blocks = rt.vector_blocks(units)
    coded = rt.fit_codes(blocks, units, parts=4, entries=32)
    exact = set(hits(rt.search_vector_blocks(asked, blocks, 5)))
    got = set(hits(rt.search_codes(asked, coded, units, 5)))
    assert len(got & exact) >= 0.9 * len(exact)
    assert sum(len(r["codes"]) for r in coded.codes.collect()) == 4 * units.count()


def test_pruned_search_makes_no_pairs_of_queries_and_items(spark, monkeypatch):
    """The same results as by all terms, from boards; weak terms are there, and are added to a part of the queries only."""
    import numpy as np

    from recollect.functions import boards
    from recollect.operators import shelves
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rnd = random.Random(3)
    words = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25))) for _ in range(60)]
    rows = [(i, None, None, None, None, None, "the of " + t, None) for i, t in enumerate(texts + texts)]
    ix = build_index(spark.createDataFrame(rows, ITEMS), 4, 2)
    asked = terms_of(spark, {i: "the of and " + " ".join(rnd.choice(words) for _ in range(6)) for i in range(12)} | {99: "nothing"})
    weighed = rt.stage(rt.weigh_terms(asked, ix))
    monkeypatch.setattr(rt, "_sums", None)
    best_above, marked = shelves.best_above, []
    monkeypatch.setattr(shelves, "best_above", lambda df, *a: marked.append(df) or best_above(df, *a))
    for signal, search in ((rt.TEXT, rt.text_search), (rt.SEMANTIC, rt.semantic_search)):
        for k, limit in ((2, None), (10, 60), (200, None)):
            assert hits(rt.best_by_terms(weighed, ix, signal, k, limit, sum_rows=0)) == hits(search(asked, ix, k))
    assert marked[0].filter("_weak").count() and not marked[2].filter("_weak").count()

    pa = boards.pa
    longs, ints, doubles = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64())
    held = pa.struct([("kind", pa.int32()), ("key", pa.string()), ("ids", longs), ("at", ints), ("v1", doubles), ("v2", doubles)])
    asks = pa.struct([("qb", pa.int64()), ("kind", pa.int32()), ("key", pa.string()), ("qn", ints), ("f1", doubles), ("f2", doubles), ("ids", longs)])
    shelf = [{"kind": boards.IDS, "ids": [4, 9]}, {"kind": boards.TERM, "key": "x", "at": [1], "v1": [1.0]}]
    block = [
        {"qb": 0, "kind": boards.LIMIT, "qn": [0, 1], "f1": [5.0, 5.0], "f2": [2.0, 2.0]},
        {"qb": 0, "kind": boards.WEAK, "key": "x", "qn": [0, 1, 2], "f1": [1.0, 1.0, 1.0]},
        {"qb": 0, "kind": boards.TERM, "key": "x", "qn": [0, 1, 2], "f1": [3.0, 2.0, 1.0]},
    ]
    batch = pa.RecordBatch.from_arrays([pa.array([shelf], pa.list_(held)), pa.array([0]), pa.array([block], pa.list_(asks))], names=["held", "chunk", "asked"])
    (board,) = boards._boards(iter([batch]))
    assert np.array_equal(board.weak_terms("v1", np.array([True, False, True])), [[0, 1], [0, 0], [0, 1]])
    (out,) = boards.best_above(3, "v1")(iter([batch]))
    assert out.to_pydict() == {"qb": [0, 0], "qn": [0, 2], "image_id": [9, 9], "score": [4.0, 1.0]}


def test_one_query_reads_the_folders_of_its_terms(spark):
    """Folders of other terms are pruned in the plan."""
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rows = [(i, None, None, None, None, None, f"w{i} w{i + 1} common", None) for i in range(200)]
    ix = build_index(spark.createDataFrame(rows, ITEMS), 4, 2)
    asked = terms_of(spark, {1: "w7"})
    weighed = rt.stage(rt.weigh_terms(asked, ix), "weighed")
    from recollect.operators import shelves

    placed = weighed.select(F.lit(0).cast("long").alias("qb"), F.lit(0).alias("qn"), "term", F.col("bm_idf").alias("f1"), F.col("q").alias("f2"))
    made = shelves.term_rows(placed, ix)
    assert made.count() == 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot#\d+ (=|IN|INSET)", plan)
    assert {(r["query_id"], r["image_id"]) for r in rt.text_search(asked, ix).collect()} == {(1, 6), (1, 7)}


def queries(spark):
    return rk.QuerySet(
        terms=terms_of(spark, {1: "notes about osi", 2: "python login error"}),
        vecs=spark.createDataFrame([(1, [1.0, 0.0, 0.5, 0.0])], "query_id long, query_vec array<float>"),
        filters=spark.createDataFrame([(1, "source", "phone")], "query_id long, field string, value string"),
        clues=spark.createDataFrame([(1, "visual", "diagram"), (2, "source", "Laptop")], "query_id long, slot string, value string"),
    )


def test_hybrid_signals_and_zero_weight(spark, index):
    found = rk.hybrid_search(queries(spark), index, k=8)
    by = {(r["query_id"], r["image_id"]): r for r in found.collect()}
    assert by[(1, 2)]["rank"] == 1 and by[(1, 2)]["clue"] == 1.0 and by[(2, 3)]["rank"] == 1
    assert by[(2, 3)]["visual"] is None and by[(2, 3)]["clue"] == 1.0 and by[(2, 3)]["metadata"] is None
    without = rk.hybrid_search(replace(queries(spark), vecs=None), index, k=8)
    zero = rk.hybrid_search(queries(spark), index, {**rk.EQUAL_WEIGHTS, "visual": 0.0}, k=8).filter("final > 0")
    assert {(r["query_id"], r["image_id"], r["rank"]) for r in without.collect()} == {
        (r["query_id"], r["image_id"], r["rank"]) for r in zero.collect()
    }


def test_rerank_stays_within_the_previous_results(spark, index):
    first = rk.hybrid_search(queries(spark), index, k=3)
    again = rk.refine(queries(spark), index, first, "rerank")
    pairs = {(r["query_id"], r["image_id"]) for r in first.collect()}
    assert {(r["query_id"], r["image_id"]) for r in again.collect()} == pairs
    with pytest.raises(ValueError):
        rk.refine(queries(spark), index, None, "rerank")


def test_search_of_vectors_writes_no_postings(spark, archive):
    from recollect.plans.index import build_index

    ix = build_index(archive, dim=4, buckets=2)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.1, 0.0]), (2, [0.0, 0.0, 0.0, 2.0])], "query_id long, query_vec array<double>")
    got = hits(rt.search_vector_blocks(asked, ix.facing, 2))
    assert got[1, 1] == (1.0, 1) and got[2, 5][1] == 1 and len(got) == 4
    assert not {"postings", "counted", "items", "blocks", "spots"} & set(vars(ix))


def test_best_vectors_of_a_task_are_kept_over_its_shelves():
    """Ten shelves in one task hand on k rows a query, not k for each shelf."""
    import pyarrow as pa

    from recollect.functions import boards

    none = pa.list_(pa.float64())
    kinds = {"kind": pa.int32(), "key": pa.string(), "ids": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "v1": none, "v2": none}
    wants = {"qb": pa.int64(), "kind": pa.int32(), "key": pa.string(), "qn": pa.list_(pa.int32()), "f1": none, "f2": none, "ids": pa.list_(pa.int64())}
    asked = [{"qb": 0, "kind": boards.VECTORS, "qn": [0], "f1": [1.0, 0.0]}]
    rows = []
    for s in range(10):
        held = [{"kind": boards.IDS, "ids": [2 * s, 2 * s + 1]}, {"kind": boards.VECTORS, "at": [0, 1], "v1": [s / 10, 0.0, -1.0, 0.0]}]
        rows.append({"shelf": s, "held": held, "chunk": 0, "asked": asked})
    kind = pa.schema({"shelf": pa.int64(), "held": pa.list_(pa.struct(kinds)), "chunk": pa.int32(), "asked": pa.list_(pa.struct(wants))})
    made = pa.Table.from_batches(boards.best_by_vectors(3)(iter([pa.RecordBatch.from_pylist(rows, kind)])))
    assert made.column("image_id").to_pylist() == [18, 16, 14] and made.column("score").to_pylist() == [0.9, 0.8, 0.7]


def test_queries_come_to_a_task_once(spark, monkeypatch):
    """Before, every shelf was one row, and all queries came with each of them."""
    import pyarrow as pa

    from recollect.operators import shelves
    from recollect.plans import index as plan
    from recollect.schemas import ITEMS

    monkeypatch.setattr(plan, "SHELF", 4)
    rnd = random.Random(5)
    rows = [(i, f"s{i % 3}", None, None, None, None, " ".join(rnd.choice("abcdefgh") for _ in range(5)), None) for i in range(60)]
    ix = plan.build_index(spark.createDataFrame(rows, ITEMS), 4, 2)
    asked = spark.createDataFrame([(q, "abcdefgh"[q % (3 + n)], 1) for q in range(2100) for n in (0, 5)], "query_id long, term string, tf long")
    weighed = rt.stage(rt.weigh_terms(asked, ix))

    def counted(batches):
        pieces, entries, most = [], 0, 0
        for batch in batches:
            pieces += [c for c, a in zip(batch.column("chunk").to_pylist(), batch.column("asked").to_pylist()) if a is not None]
            sizes = [len(x) for x in batch.column("held").to_pylist() if x is not None]
            entries, most = entries + len(sizes), max([most, *sizes])
        yield pa.RecordBatch.from_pylist([{"pieces": len(pieces), "distinct": len(set(pieces)), "entries": entries, "most": most}])

    terms = weighed.join(shelves.numbered(weighed), "query_id").selectExpr("qb", "qn", "term", "bm_idf f1", "q f2")
    side = [shelves.shelf_rows(ix), shelves.term_rows(weighed, ix)], [shelves.asked_terms(terms)]
    tasks = shelves.score(*side, counted, "pieces long, distinct long, entries long, most long", lambda some: some).collect()
    assert all(t["pieces"] == t["distinct"] for t in tasks) and max(t["entries"] for t in tasks) > 9 and {t["most"] for t in tasks} <= {0, 1}

    want = hits(rt.text_search(asked, ix, 3))
    setting = spark.conf.get(shelves.BATCH_SETTING)
    rounds, stage = [], shelves.stage
    monkeypatch.setattr(shelves, "stage", lambda df, name, **more: rounds.append(name) or stage(df, name, **more))
    monkeypatch.setattr(shelves, "SENT_BYTES", 500)
    assert hits(rt.text_search(asked, ix, 3)) == want and len(want) > 6000
    assert rounds.count("found") == 3 and spark.conf.get(shelves.BATCH_SETTING) == setting


def test_clues_alone_write_no_postings(spark):
    """Before, looking up a few clues wrote the postings of all terms."""
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    texts = ["OSI notes", "osi", "notes of OSI, osi notes", None, "phone", "notes"]
    rows = [(i, "Phone" if i % 2 else None, None, None, None, {"lang": "osi"} if i == 4 else None, text, None) for i, text in enumerate(texts)]
    items = spark.createDataFrame([*rows, rows[1]], ITEMS)
    clues = spark.createDataFrame([(1, "topic", "osi notes"), (1, "type", "phone"), (2, "topic", "OSI"), (3, "text", "..."), (3, "text", None)], "query_id long, slot string, value string")
    fresh, whole = build_index(items, 4, 2), build_index(items, 4, 2)
    assert whole.blocks.count()
    pairs = [sorted((r["value"], r["image_id"]) for r in rt.clue_hits(clues, ix).collect()) for ix in (fresh, whole)]
    assert pairs[0] == pairs[1] == [("OSI", 0), ("OSI", 1), ("OSI", 2), ("OSI", 4), ("osi notes", 0), ("osi notes", 2), ("phone", 1), ("phone", 3), ("phone", 4), ("phone", 5)]
    assert not {"counted", "postings", "blocks", "places"} & set(vars(fresh))


def test_places_of_phrases_are_shuffled_once(spark, monkeypatch):
    """Before, the places of a term were shuffled once for every block of phrases that has it."""
    from recollect.operators import shelves
    from recollect.plans.index import build_index
    from recollect.schemas import ITEMS

    rnd = random.Random(8)
    texts = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(30)]
    ix = build_index(spark.createDataFrame([(i, None, None, None, None, None, " ".join(t), None) for i, t in enumerate(texts)], ITEMS), 4, 2)
    said = [(q, " ".join(rnd.choice("abcde") for _ in range(1 + q % 4))) for q in range(60)]
    asked = spark.createDataFrame([*said, said[0], (99, " ... ")], "query_id long, phrase string")
    inside = lambda words, text: any(text[i : i + len(words)] == words for i in range(len(text) - len(words) + 1))
    want = sorted((q, i, p) for q, p in said for i, t in enumerate(texts) if inside(p.split(), t))
    monkeypatch.setattr(rt, "PHRASE_BLOCK", 5)
    for size, most in ((shelves.SENT_BYTES, 8), (1500, 8), (1500, 1)):
        monkeypatch.setattr(shelves, "SENT_BYTES", size)
        monkeypatch.setattr(rt, "MOST_ROUNDS", most, raising=False)
        found = rt.phrase_match(asked, ix)
        assert "qb" not in "".join(re.findall(r"hashpartitioning\([^)]*", found._jdf.queryExecution().executedPlan().toString()))
        assert sorted((r["query_id"], r["image_id"], r["phrase"]) for r in found.collect()) == want and len(want) > 300
