"""The pipeline stage by stage."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import registry
from recollect.sources.tables import stage
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(21)
    tongues = {"aa": ["tion", "the", "er", "wh"], "bb": ["ung", "sch", "ei", "ü"]}

    def speech(lang: str, n: int) -> str:
        return " ".join("".join(rng.choices(tongues[lang], k=rng.randint(1, 4))) for _ in range(n))

    items = [(i, speech("aa", 30)) for i in range(3)]
    rows = []
    for i in range(90):
        lang = "aa" if i % 2 else "bb"
        text = speech(lang, rng.randint(20, 200))
        if i % 10 == 3:
            text += " " + items[i % 3][1] + " " + speech(lang, 5)
        if i % 10 == 4:
            text = rows[-4][1]
        rows.append((i, text, lang if i % 6 else None, f"s{i % 4}" if i % 5 else None, len(text)))
    rows += [(90, None, "aa", "s0", None), (91, "", "bb", "s1", 0), (92, "1 2 3", None, None, 5), rows[7], (None, speech("bb", 40), "bb", "s1", 9)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = made_documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    want = collections.Counter(rows)
    results = []
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, str(tmp_path)), f"test-{name}")
        results.append(docs.collect())
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, dedup, clean, mixed, shards = results
    want = collections.Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert collections.Counter(map(tuple, language)) == want
    kept = list(want)
    groups = brute.similar_groups([(i, r[1]) for i, r in enumerate(kept)])
    assert len(dedup) == len(set(groups.values())) < len(kept)
    assert len({groups[kept.index(tuple(r))] for r in dedup}) == len(dedup)
    copied = {k[0] for k in brute.copies([(i, r.text) for i, r in enumerate(dedup)], items)}
    assert copied and sorted(r.text for r in clean) == sorted(r.text for i, r in enumerate(dedup) if i not in copied)
    sizes = collections.Counter()
    for r in clean:
        sizes[r.source] += len(brute.words(r.text))
    got = collections.Counter()
    for r in mixed:
        got[r.source] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(got[s] - t) <= 1 for s, t in brute.targets(sizes).items())
    assert collections.Counter((r.doc_id, r.text_crc32) for r in shards) == collections.Counter((r.doc_id, brute.crc(r.text)) for r in mixed)
    counts = collections.Counter(r.shard for r in shards)
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1


UNKNOWN = [
    "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike. Sokan beszélik.",
    "Türkçe, Güneydoğu Avrupa ve Batı Asya'da konuşulan, Türk dilleri dil ailesine ait sondan eklemeli bir dildir.",
    "Język polski należy do grupy języków zachodniosłowiańskich. Posługuje się nim wiele milionów ludzi na świecie.",
    "Русский язык является одним из восточнославянских языков, национальный язык русского народа.",
    "中文是世界上使用人数最多的语言之一，主要在中国大陆、台湾、新加坡等地使用。",
    "日本語は、主に日本国内や日本人同士の間で使われている言語である。",
]


def test_texts_in_no_language_of_the_labels_go(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    key = 'token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add" '
    keyed = given.filter("length(text) > 300").orderBy("doc_id").limit(5).select(
        F.col("doc_id") + 2_000_000, F.concat(F.lit(key), F.substring("text", 1, 60)), F.lit(None), "source", F.lit(0)
    )
    foreign = spark.createDataFrame([(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(UNKNOWN)], COLUMNS)
    docs = stage(given.union(keyed).union(foreign), "test-foreign")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    own = {r.doc_id for r in docs.filter(r"text rlike '\\p{L}'").collect()} - {1_000_000 + i for i in range(len(UNKNOWN))}
    assert kept == own


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_thirteen_queries_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
