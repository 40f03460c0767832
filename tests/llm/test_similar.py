"""Groups of similar texts against all pairs of shingle sets."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from recollect.llm import similar
from tests.llm import brute


def near_copies(seed: int) -> list[str]:
    """Texts with copies of all degrees, a passage that many share, and a crowd of copies of one text."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]

    def prose(n: int) -> str:
        return " ".join(rng.choices(words, k=n))

    def edited(text: str, n: int) -> str:
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    passage, texts = prose(150), [prose(rng.randint(1, 300)) for _ in range(60)]
    texts += [edited(texts[i], rng.randint(1, 9)) for i in range(60)]
    texts += [prose(40) + " " + passage + " " + prose(rng.randint(20, 80)) for _ in range(80)]
    crowd = prose(200)
    texts += [edited(crowd, rng.randint(0, 3)) for _ in range(120)]
    return [*texts, texts[0].upper(), texts[1].replace(" ", "\n ")]


@pytest.mark.parametrize("part", [2048, 8])
def test_groups_of_similar_texts(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    texts = near_copies(11)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, None, None), (901, " \n", "", 2), (7, texts[7], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, root int").repartition(4)
    got = {(r.doc_id, r.component_id) for r in similar.similar_groups(docs).collect()}
    want = brute.similar_groups([(r[0], r[1]) for r in rows])
    assert got == set(want.items())
    assert len(set(want.values())) < 230
    kept = similar.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark, messy, nothing):
    rows, docs = messy
    got = similar.similar_groups(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    named = {r[0]: r[1] for r in rows if r[0] is not None}
    want = brute.similar_groups(list(named.items()))
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert similar.similar_groups(nothing).count() == 0
    assert similar.one_of_each_group(nothing).columns == nothing.columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 60, 3000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
        changed = list(words)
        for at in rng.integers(0, len(words), max(1, n // 60)):
            changed[at] = "other"
        texts = [" ".join(w).encode() for w in (words, changed)]
        _, keys, sketches = similar.signatures(texts)
        a, b = (brute.five_words(t.decode()) for t in texts)
        if len(a & b) / len(a | b) >= 0.8:
            assert (keys[0] == keys[1]).any()
            assert similar._unlike(*sketches.view(np.uint64)) <= similar.MOST_UNLIKE
    assert not similar.signatures([b""])[1].any()


def test_leaders_meet_every_text_of_their_key():
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 1 << 63, (40, 4), np.uint64)
    sketch[10:30] = sketch[0]
    a, b, leaders = similar._compared(np.arange(40), sketch)
    assert set(zip(a, b)) == {(0, i) for i in range(10, 30)}
    assert sorted(leaders) == [*range(10), *range(30, 40)]


@pytest.mark.parametrize("part, centres", [(2048, 64), (2048, 1), (8, 64)])
def test_copies_like_their_original_but_not_like_each_other(spark, monkeypatch, part, centres):
    """Two originals of 250 words; each copy has four words replaced, far from each other."""
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "CENTRES", centres, raising=False)
    rng, texts = random.Random(8), []
    for name in "uv":
        original = [f"{name}{rng.randrange(10**6)}" for _ in range(250)]
        for i in range(40):
            copy = list(original)
            for k in range(4 if i else 0):
                copy[60 * k + rng.randrange(10, 50)] = f"x{i}y{k}{name}"
            texts.append(" ".join(copy))
    sets = [brute.five_words(t) for t in texts[:40]]
    alike = [len(a & b) / len(a | b) for a in sets for b in sets if a is not b]
    assert all(len(sets[0] & b) >= 0.8 * len(sets[0] | b) for b in sets) and sum(x < 0.8 for x in alike) > 0.9 * len(alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == brute.similar_groups(list(enumerate(texts)))
    assert set(got.values()) == {0, 40}
