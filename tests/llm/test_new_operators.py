"""Spelling variants, rule cascade and vector codes against brute force, and the registered queries as they are registered."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import codes, decontam, language, mixing, quality, registry, rules, similar, simhash, spelling
from tests.llm import brute
from tests.llm.test_operators import pairs

SF = "/root/testdata/sf0.001"


def made_words(seed: int = 6) -> list[tuple]:
    """Texts whose words are near each other in all ways: by each kind of edit, at each place, with long and repeated letters."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(7, 11))) for _ in range(25)] + ["x" * 300, "ab" * 9, "aaaaaaa", "Straßenbahn", "\u00d7" * 8]
    texts = []
    for i in range(260):
        words = rng.choices(base[:8], k=12)
        for w in rng.choices(base, k=4):
            at = rng.randrange(len(w))
            words += [w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]]
        texts.append((i if i % 40 else None, " ".join(words).upper() if i % 9 == 0 else ", ".join(words)))
    return texts + [(900, None), (901, ""), (902, "kurz 123"), texts[3], texts[3]]


def test_spellings(spark, nothing):
    rows = made_words()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(docs).collect()}
    want = brute.spellings(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert spelling.group_spellings(nothing).count() == 0


def test_chains_of_forms_are_followed_to_the_end(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w9" for w, _ in forms}


@pytest.mark.parametrize("weights, places, want", [([5, 1, 1, 9, 2], [0, 1, 2, 4], (1, 4)), ([1, 1, 1], [0, 1, 2], (0, 2)), ([3, 3, 3, 3], [0, 1, 2, 3], (0, 2))])
def test_pivots_are_the_lightest_pair_apart(weights, places, want):
    assert spelling.pivots(places, weights) == want


def test_measures_and_verdicts(spark, messy, nothing):
    rows, docs = messy
    extra = ["word " * 9, "a b c d e " * 3, "same line here\nsame line here\nsame  line here\n \n \nsame line here", "#*$%&|<> " * 12, "x\u3000y z " * 5, "LOUD WORDS " * 8, "one " * 4 + "two three four five six seven eight nine ten"]
    table = docs.select("doc_id", "text", F.lit(1).alias("kept"), F.lit("q").alias("_words"), F.lit("w").alias("n_words"))
    table = table.unionByName(spark.createDataFrame([(5000 + i, t, 1, "q", "w") for i, t in enumerate(extra)], table.schema))
    got = rules.with_verdict(table).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = collections.Counter((r[0], *brute.measures(r[1])) for r in [*rows, *((5000 + i, t) for i, t in enumerate(extra))])
    assert pairs(got, "doc_id", *names) == want
    assert not any(r.kept for r in got if r.base_failed) and {r._words for r in got} == {"q"}
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[5003] and not kept[5005] and kept[0] == (not [r for r in got if r.doc_id == 0][0].base_failed)
    assert rules.with_verdict(nothing).count() == 0


def test_order_is_by_rejections_per_cost_of_what_is_left():
    cost = {"a": 1.0, "b": 1.0, "c": 10.0, "d": 1.0}
    rejected = {frozenset("ab"): 50, frozenset("b"): 10, frozenset("c"): 100, frozenset(): 500, frozenset("d"): 5}
    assert rules.ordered(cost, rejected) == ["b", "c", "d", "a"]


def test_later_rules_are_not_looked_at(spark):
    fails = F.raise_error(F.lit("looked at")).cast("boolean")
    df = spark.range(3).withColumn("by", rules.cascade({"dear": fails, "cheap": F.col("id") >= 0}, ["cheap", "dear"]))
    assert {r.by for r in df.collect()} == {"cheap"}


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, (rng.standard_normal(12) * 10 ** rng.integers(0, 4)).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    vecs += [(7, vecs[3][1], 1), (None, vecs[4][1], 2), vecs[9]]
    odd = [(800, None, 1), (801, [1.0, None] + [0.0] * 10, 1), (802, [float("nan")] * 12, 1), (803, [float("inf")] + [0.0] * 11, 1), (804, [1.0, 2.0], None)]
    df = spark.createDataFrame([(*v, "c", 1) for v in vecs + odd], "vec_id long, embedding array<double>, label int, code string, v int").repartition(3)
    coded, books = codes.encode_vectors(df, parts=4, entries=8)
    got = codes.with_label_error(coded).collect()
    good = [(i, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v, _ in vecs]
    want, want_books = brute.codes(good, 4, 8, 2)
    assert pairs([r for r in got if r.vec_id != 804], "vec_id", "code", "error") == collections.Counter(want)
    assert [(r.code, r.error) for r in got if r.vec_id == 804] == [(None, None)]
    assert [[tuple(e) for e in b] for b in books.tolist()] == want_books
    sums = collections.Counter()
    for (_, _, label), (_, _, error) in zip(vecs, want):
        sums[label] += error
    by_row = collections.Counter((r.vec_id, r.label_error) for r in got if r.vec_id != 804)
    assert by_row == collections.Counter((v[0], sums[v[2]]) for v in vecs)
    assert codes.text_of(books).count(",") == 4 * 8 * 3 - 1
    empty, none = codes.encode_vectors(df.limit(0))
    assert empty.count() == 0 and codes.text_of(none) == "" and codes.with_label_error(empty).count() == 0
    with pytest.raises(ValueError):
        codes.encode_vectors(df, parts=5)


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (3, 2**20, 2**28):
        a, b = rng.integers(-most, most, (9, 7)), rng.integers(-most, most, (5, 7))
        assert codes.exact_products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


# Every name that the code gives to a column of its own.
NAMES = (
    "id mark row n at hash uid key rest taken spans size document familiar lang_pred score _letter _has_letter _copy_mark _mix_uid _mix_spans "
    "_mix_taken _mix_size _near_row _near_n _familiar _at _place _part _words n_words word form root shard slot _id _size item_id component_id fp"
).split()


def test_columns_of_any_name_come_back_as_they_were(spark, tmp_path):
    texts = [("eine kleine Nachtmusik spielt heute im Garten der Stadt " * 4 + str(i), "de") for i in range(6)]
    texts += [("the quick brown fox jumps over the lazy dog near the river bank " * 4 + str(i * 7), "en") for i in range(6)]
    rows = [(i, t, lang, f"s{i % 2}", len(t), *[f"{n}{i}" for n in NAMES]) for i, (t, lang) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "no such words anywhere in it at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    by_id = {r[0]: r for r in rows}
    results = {name: step(spark, docs, str(tmp_path)) for name, step in corpus_pipeline.STAGES[:4]}
    results["without_copies"] = decontam.without_copies(docs, bench)
    results["simhash"] = simhash.one_of_each_group(docs)
    results["similar"] = similar.one_of_each_group(docs)
    for name, made in results.items():
        assert made.columns == docs.columns, name
        got = made.collect()
        assert got, name
        for r in got:
            assert all(r[c] == by_id[r.doc_id][docs.columns.index(c)] for c in docs.columns if name != "mixing" or c not in ("text", "n_chars")), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op8", "op9", "op10", "op11", "op12", "op13"])
def test_registered_queries(spark, name):
    """Each with its registered parameters over the whole of the smallest tables."""
    query = next(q for n, q in registry.QUERIES.items() if n.split("_")[0] == name)
    got = query(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    if name == "op1":
        assert pairs(got, "doc_id", "size", "text_crc32") == collections.Counter((i, len(t.encode()) + 1, brute.crc(t)) for i, t in docs)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.law for r in got} == {"rows"}
    elif name == "op2":
        pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
        assert pairs(got, "page_id", "payload_bytes") == collections.Counter((p.page_id, len((p.html or "").encode())) for p in pages)
    elif name == "op5":
        vecs = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
        want = {}
        for q in vecs:
            if q % 50 == 0:
                scores = sorted((-int(vecs[q] @ v), i) for i, v in vecs.items() if i != q)[:5]
                want |= {(q, n): (i, -s) for n, (s, i) in enumerate(scores, 1)}
        assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want
    elif name == "op8":
        fps = {i: brute.simhash(t) for i, t in docs}
        roots = brute.groups(fps)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", roots[i]) for i, f in fps.items()}
    elif name == "op9":
        want = brute.repeated_strings([(i, t.encode()) for i, t in docs], 200)
        assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter(want)
    elif name == "op10":
        want = brute.repeated_windows(sorted(docs), 20)
        assert pairs(got, "doc_id", "n_words", "n_removed", "kept_sha256") == collections.Counter(want)
    elif name == "op11":
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute.spellings(docs)
    elif name == "op12":
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert pairs(got, "doc_id", *names) == collections.Counter((i, *brute.measures(t)) for i, t in docs)
        good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
        assert all(r.kept or r.base_failed for r in got if r.doc_id in good)
    else:
        rows = [(r.vec_id, tuple(int(np.floor(256.0 * float(x))) for x in r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        want, books = brute.codes(rows, 16, 64, 2)
        assert pairs(got, "vec_id", "code", "error") == collections.Counter(want)
        text = ",".join(str(x) for b in books for e in b for x in e)
        assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_network_against_plain_loops():
    net = quality.Network.fresh(3)
    rng = np.random.default_rng(2)
    chunks = rng.integers(1, 255, (3, quality.CHUNK)).astype(np.uint8)
    chunks[2, 100:] = 0
    filled = np.array([1.0, 1.0, 100 / quality.CHUNK])
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    w["bytes"][0] = 0
    want = []
    for c, f in zip(chunks, filled):
        pooled = np.full(quality.FILTERS, -np.inf)
        for i in range(quality.WINDOWS):
            window = w["bytes"][c[i * quality.STEP : i * quality.STEP + quality.WIDTH]].ravel()
            pooled = np.maximum(pooled, window @ w["filters"])
        joined = np.append(np.maximum(pooled + w["filter_bias"], 0), f)
        want.append(float(np.maximum(joined @ w["mix"] + w["mix_bias"], 0) @ w["out"][:, 0] + w["out_bias"][0]))
    assert net.forward(chunks, filled) == pytest.approx(want, abs=1e-3)
    labels = np.array([1.0, 0.0, 1.0], np.float32)

    def loss() -> float:
        p = 1 / (1 + np.exp(-net.forward(chunks, filled).astype(np.float64)))
        return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    slopes = net.gradients(chunks, filled, labels)
    for name in ("mix", "out", "out_bias", "mix_bias"):
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        old = net.weights[name][at]
        both = []
        for step in (1e-2, -1e-2):
            net.weights[name][at] = old + step
            both.append(loss())
        net.weights[name][at] = old
        assert (both[0] - both[1]) / 2e-2 == pytest.approx(float(slopes[name][at]), rel=0.1, abs=1e-3)


def test_a_rare_language_is_learnt(spark):
    rare = [(i, "ðæþ ƿæs gód cyning on þām dagum " * 3, "ang") for i in range(4)]
    common_ = [(100 + i, f"the river runs by the old house number {i} " * 3, "en") for i in range(900)]
    docs = spark.createDataFrame(rare + common_, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True), sample=60)
    assert sorted(model.languages) == ["ang", "en"]
    got = {r.doc_id: r.lang_pred for r in language.with_language(docs, model).filter("doc_id < 110").collect()}
    assert {got[i] for i in range(4)} == {"ang"} and got[105] == "en"
