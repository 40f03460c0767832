"""Each operator against brute force, on documents with everything that can be wrong with them."""

from __future__ import annotations

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import decontam, language, mixing, quality, sharding, simhash, substrings, suffixes, topk, warc
from tests.llm import brute


def pairs(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_shards_are_even_gapless_and_ignore_other_columns(spark, messy, nothing):
    rows, docs = messy
    got = sharding.assign_shards(docs, 8).collect()
    assert pairs(got, "doc_id", "size", "text_crc32") == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 1, brute.crc(r[1])) for r in rows
    )
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    counts = [len(by_shard[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.assign_shards(nothing, 8).count() == 0


def test_ring_moves_few_keys_and_hot_keys_are_split(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old, new = ({r.doc_id: r.shard for r in sharding.assign_shards(docs, n, slack=0.25).collect()} for n in (8, 9))
    moved = [k for k in old if old[k] != new[k]]
    assert len(moved) / len(old) < 0.25
    hot = spark.range(900).select(F.lit(7).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    assert sorted(r["count"] for r in sharding.assign_shards(hot, 7).groupBy("shard").count().collect()) == [128] * 3 + [129] * 4


def test_spread_serves_home_first_and_goes_on_clockwise():
    # Two arcs of shard 0 hold 6 rows, shard 1 has room for them; ranks say which go.
    assert sharding.spread([4, 1, 2], [0, 1, 0], [3, 4]) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (2, 0, 1, 0, 2), (0, 2, 2, 1, 1), (2, 1, 1, 1, 3)]


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c\r\nX: y", None), (4, "http://d", ""), (None, "http://e", "<p>é</p>")]
    pages += [(5, "http://f", "a\r\n\r\nb"), (5, "http://f", "a\r\n\r\nb"), (None, None, "only")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, uid int")
    path = str(tmp_path / "archive")
    warc.write_archive(df.repartition(2), path)
    records = warc.read_records(spark, path)
    got = warc.parse_records(records).collect()
    assert all(r.intact for r in got)
    assert pairs(got, "page_id", "payload") == collections.Counter((p[0], (p[2] or "").encode()) for p in pages)
    largest = {}
    for page, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    for r in got:
        html = bytes(r.payload).decode()
        assert r.payload_bytes == len(r.payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        assert r.refers_to == (largest[html] if r.record_type == "revisit" else None)
    for html in largest:
        assert sum(r.record_type == "response" for r in got if bytes(r.payload).decode() == html) == 1
    heads = [bytes(r.header).decode() for r in records.collect()]
    assert all(h.startswith("WARC/1.1\r\n") and h.count("\r\n\r\n") == 2 for h in heads)
    assert spark.read.parquet(f"{path}/payloads").count() == len(largest)


def test_damaged_payload_fails_the_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("other").cast("binary")).write.parquet(f"{path}/bad")
    (tmp_path / "archive" / "payloads").rename(tmp_path / "archive" / "good")
    (tmp_path / "archive" / "bad").rename(tmp_path / "archive" / "payloads")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_records(spark, path).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.parse_records(warc.read_records(spark, str(tmp_path / "a"))).count() == 0


def test_decontamination_finds_what_brute_force_finds(spark, messy, nothing):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("klmnopqrst", k=4)) for _ in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((1, 3, 5, 15, 30, 30, 59, 8))] + [(20, None), (21, "..."), (22, None)]
    docs = [(r[0], r[1]) for r in messy[0] if r[0] is not None]
    docs = list({d[0]: d for d in docs}.values())
    for k in range(60):
        w = rng.choice(items[:8])[1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice((0, 1))] = [rng.choice(vocabulary)] * rng.choice((0, 1))
        body = rng.choices(vocabulary, k=rng.randint(0, 40)) + w + rng.choices(vocabulary, k=rng.randint(0, 40))
        docs.append((1000 + k, " ".join(body).upper() if k % 4 else ", ".join(body)))
    docs.append((2000, " ".join([items[4][1]] * 7)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, key int, mark string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontam.contaminations(table.repartition(3), bench).collect()}
    want = brute.copies(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    # Of equally similar windows the operator names one that starts at a shared shingle.
    assert all(got[k][0] >= want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    bad = {k[0] for k in want}
    kept = decontam.without_copies(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in bad)
    assert decontam.contaminations(nothing, bench).count() == 0
    assert decontam.without_copies(messy[1], bench.limit(0)).count() == len(messy[0])


def test_mix_meets_targets_and_repeats_itself(spark, messy, nothing):
    rows, docs = messy
    documents, pieces = mixing.mix_sources(docs, block_words=16)
    parts = pieces.collect()
    got = {r.uid: r for r in documents.collect()}
    assert collections.Counter((r.doc_id, r.size) for r in got.values()) == collections.Counter((r[0], len(brute.words(r[1]))) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute.targets(sizes)
    assert sorted(round(t, 6) for t in {r.target for r in got.values()}) == sorted({round(t, 6) for t in want.values()})
    taken = collections.Counter()
    for p in parts:
        taken[p.uid] += p.words
        assert 0 <= p.first_word and p.first_word + p.words <= got[p.uid].size and 0 <= p.shard < 8
    assert all(taken[u] <= 2 * r.size for u, r in got.items())
    by_target = collections.Counter()
    for u, r in got.items():
        by_target[r.target, r.source_size] += taken[u]
    assert all(abs(n - t) <= 1 for (t, _), n in by_target.items())
    assert len({p.shard for p in parts}) == 8
    again = mixing.mix_sources(docs.repartition(5), block_words=16)
    doc = {r.uid: (r.doc_id, r.size) for r in again[0].collect()}
    assert pairs(parts, "shard", "slot", "epoch", "first_word", "words") == pairs(again[1].collect(), "shard", "slot", "epoch", "first_word", "words")
    assert len(doc) == len(rows)
    assert mixing.mix_sources(nothing)[1].count() == 0
    whole = mixing.mixed_documents(docs, block_words=16)
    assert whole.columns == docs.columns
    assert sum(len(brute.words(r.text)) for r in whole.collect()) == sum(taken.values())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 12345)) == list(range(n))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    vectors = [(i, (centres[i % 6] + 0.1 * rng.standard_normal(8)).tolist()) for i in range(700)]
    vectors += [(700 + i, vectors[i % 7][1]) for i in range(40)] + [(50, vectors[3][1]), (None, vectors[0][1])]
    odd = [(900, None), (950, [1.0, None]), (901, [float("nan")] * 8), (902, [float("inf")] + [0.0] * 7), (903, []), (904, [0.5] * 3)]
    df = spark.createDataFrame([(*v, 1) for v in vectors + odd], "vec_id long, embedding array<float>, uid int").repartition(3)
    got = topk.top_inner_products(df, F.col("id") % 50 == 0, k=5, block=64, chunk=4).collect()
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors + odd[-2:]]
    want = collections.Counter()
    for n, (q, v) in enumerate(good):
        if q is None or q % 50:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(good) if m != n]
        for rank, (s, none, i) in enumerate(sorted(found)[:5], 1):
            want[q, rank, None if none else i, -s] += 1
    assert pairs(got, "query_id", "rank", "vec_id", "score") == want
    assert topk.top_inner_products(df.limit(0), F.col("id") % 50 == 0).count() == 0
    alone = topk.top_inner_products(df.filter("vec_id in (100, 7)"), F.col("id") % 50 == 0)
    assert [(r.query_id, r.vec_id) for r in alone.collect()] == [(100, 7)]


@pytest.mark.parametrize("n, dim, spread", [(1, 3, 9), (2, 3, 9), (300, 2, 200), (400, 5, 3), (300, 24, 90)])
def test_cover_tree(n, dim, spread):
    """Levels are apart and cover all points, parents cover their children, and nodes part the points under them."""
    x = np.random.default_rng(n).integers(-spread, spread, (n, dim))
    x[n // 2 : n // 2 + n // 10] = x[0]
    order, level, parent = topk.cover_levels(x.astype(float))
    assert sorted(order) == list(range(n)) and (parent >= 0).sum() == n - 1
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for lev in set(level[level > topk.NO_LEVEL]):
        net = np.flatnonzero(level >= lev)
        between = far[np.ix_(net, net)][~np.eye(len(net), dtype=bool)]
        if n > 1:
            assert between.min(initial=np.inf) > topk.BASE ** float(lev) or lev == level.max()
            assert far[:, net].min(1).max() <= topk.BASE ** float(lev)
    for c in np.flatnonzero(parent >= 0):
        if level[c] == topk.NO_LEVEL:
            assert far[c, parent[c]] == 0
        else:
            assert level[parent[c]] > level[c] and far[c, parent[c]] <= topk.BASE ** float(level[c] + 1)
    tree = topk.Tree.build(np.arange(n), np.arange(n), x)
    assert sorted(tree.uid) == list(range(n)) and (tree.vec == x[tree.uid]).all()
    for node in range(len(tree.start)):
        a, b, kids = tree.start[node], tree.end[node], range(tree.child[node], tree.child[node] + tree.children[node])
        assert far[tree.uid[tree.centre[node]], tree.uid[a:b]].max() == tree.radius[node]
        if kids:
            assert [tree.start[k] for k in kids] + [b] == [a] + [tree.end[k] for k in kids]
    assert n < 200 or tree.children.max() > 0


def test_large_products_are_whole_numbers():
    a = np.array([[2**31 - 1, 3]], np.int64)
    assert topk.products(a, a)[0, 0] == (2**31 - 1) ** 2 + 9


def test_fingerprints_and_groups(spark, messy, nothing):
    rows, docs = messy
    got = simhash.near_duplicates(docs).collect()
    fp = {r[1]: brute.simhash(r[1]) for r in rows}
    assert pairs(got, "doc_id", "fp") == collections.Counter((r[0], int(np.uint64(fp[r[1]]).view(np.int64))) for r in rows)
    roots = brute.groups(dict(enumerate(fp.values())))
    number = {t: i for i, t in enumerate(fp)}
    least: dict = {}
    for r in rows:
        if r[0] is not None:
            k = roots[number[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    want = collections.Counter((r[0], least.get(roots[number[r[1]]])) for r in rows)
    assert pairs(got, "doc_id", "component_id") == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots.values()))
    assert {r.doc_id for r in kept.collect()} - {None} == set(least.values())


@pytest.mark.parametrize("crowd", [256, 4])
def test_links_lose_no_component_in_crowds(spark, crowd):
    rng = random.Random(1)
    fps = {0}
    while len(fps) < 250:  # a crowd around few centres, and strangers
        base = rng.choice((0, 2**63 + 12345, rng.getrandbits(64)))
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        fps.add(base)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    edges = simhash.links(df, 2, crowd)
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    want = brute.groups({f: f & (2**64 - 1) for f in signed})
    assert {f: roots.get(f, f) for f in signed} == want


def test_every_word_is_near_an_anchor():
    code = simhash.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    near = code.nearest(words)
    assert np.bitwise_count(near ^ words).max() == 3
    assert (code.nearest(near) == near).all()


@pytest.mark.parametrize("length", [16, 40])
def test_repeated_strings(spark, messy, nothing, length):
    rows, docs = messy
    rng = random.Random(4)
    base = "".join(rng.choices("ab", k=500))
    more = [(3000 + i, "é" * rng.randint(0, 3) + base[(a := rng.randrange(400)) : a + rng.randint(0, 150)]) for i in range(40)]
    table = docs.select("doc_id", "text", "uid", "hash").unionByName(
        spark.createDataFrame([(*m, 1, "") for m in more], "doc_id long, text string, uid long, hash string")
    )
    got = suffixes.repeated_strings(table, length, with_text=True).collect()
    want = brute.repeated_strings([(r[0], (r[1] or "").encode()) for r in [*rows, *more]], length)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)
    assert suffixes.repeated_strings(nothing, length).count() == 0


def test_repeated_windows(spark, messy, nothing, monkeypatch):
    rows, docs = messy
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)  # many chunks
    got = substrings.repeated_windows(docs, 5, with_text=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    known = brute.repeated_windows([(r[0], r[1]) for r in order if r[0] is not None], 5)
    assert pairs([r for r in got if r.doc_id is not None], "doc_id", "n_words", "n_removed", "kept_sha256") == collections.Counter(known)
    assert len(got) == len(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.repeated_windows(nothing, 5).count() == 0


def _speech(rng: random.Random, syllables: list[str], n: int) -> str:
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark, nothing):
    rng = random.Random(8)
    tongues = {"aa": ["tion", "the", "er", "wh"], "bb": ["ung", "sch", "ei", "ü"], "cc": ["que", "eau", "é", "la"]}
    rows = [(i, _speech(rng, tongues[k], rng.randint(3, 60)), k if i % 7 else None) for i, k in enumerate(sorted(tongues) * 60)]
    rows += [(500, None, "aa"), (501, "123 ... 4", "bb"), (502, "", None), (503, "the wher tion " * 3000, None)]
    docs = spark.createDataFrame([(*r, 9.0, True) for r in rows], "doc_id long, text string, lang string, score double, _letter boolean")
    model = language.train(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language.with_language(docs, model).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und"] * 3 + ["aa"]
    held = [r for i, r in enumerate(rows[:180]) if i % 4 == 2]
    assert sum(got[r[0]].lang_pred == sorted(tongues)[r[0] % 3] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.with_language(docs, none).collect()} == {"und"}
    assert language.with_language(nothing, model).count() == 0


def test_quality_of_held_out_texts(spark, nothing):
    rng = random.Random(9)
    prose = [_speech(rng, ["tion", "the", "er", "wh", "in"], rng.randint(10, 200)) for _ in range(240)]
    rows = [(i, t if i % 3 else " ".join(w + "###" for w in t.split())) for i, t in enumerate(prose)]
    labels = [(i, int(i % 3 > 0)) for i in range(240)] + [(999, 1), (None, 0), (5, None)]
    rows += [(240, None), (241, ""), (None, "the tion"), (5, prose[5])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    net = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 5 != 0)
    got = quality.with_quality(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 5 == 0]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert quality.with_quality(nothing, net).count() == 0
    blank = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.with_quality(docs, blank).count() == len(rows)


def test_chunks_cover_whole_texts():
    texts = [b"", b"ab", bytes(range(1, 256)) * 5, b"x" * quality.CHUNK]
    chunks, filled, docs = quality.chunk_matrix(texts)
    for d, t in enumerate(texts):
        assert all(t[i : i + 20] in b"|".join(c.tobytes() for c in chunks[docs == d]) for i in range(0, len(t), 7))
    assert filled[docs == 0].tolist() == [0]
