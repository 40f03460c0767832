"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (one to three bytes, all lengths blended) that
occur in both, over the geometric mean of the numbers that occur in either. Landmarks stand for
the training texts (Nyström), and one-versus-rest ridge regression on the kernels with them
gives a value for each language. Texts are scored in batches: presence of n-grams times
landmarks, times coefficients.

The values only tell languages apart: a text in none of them can have a value as high as any. What falls for it is
the share of its n-grams that the kernel knows. How low that may be is taken from labelled texts that were held
out when the known n-grams were chosen, for each language and size of text (``limits_of``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from recollect.llm.common import free_name

SAMPLE = 2400  # texts from which the model is learnt
LEAST_EACH = 20  # of them of each language
LANDMARKS = 128
GRAMS = 8192  # n-grams that the kernel knows: those in most of the sampled texts
RIDGE = 1e-3
BATCH = 256
UNDETERMINED = "und"
FOLDS = 5  # each labelled text is held out once
STRAYS = 0.001  # share of the held-out texts of a language and size that may lie under the limit, before SLACK
SLACK = 0.02  # and the root of 1 / n for texts of n n-grams, as the share of known ones varies with few
FEW = 20  # held-out texts that a limit stands on, if the language has as many
WITH_DIGIT = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")  # numbers and keys, which are in no language
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
SIZES = 20  # limits for texts of 2**i n-grams or more
CODES = (1 << 8) + (1 << 16) + (1 << 18)  # one byte, two bytes, three bytes hashed


def present(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that occur in a text, A-Z taken as a-z; ``seen`` is an all-false array of CODES that is left so."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    pairs = b[:-1] << np.uint32(8) | b[1:]
    triples = (pairs[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(14)
    seen[b] = True
    seen[pairs + np.uint32(1 << 8)] = True
    seen[triples + np.uint32((1 << 8) + (1 << 16))] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    place: np.ndarray = field(default_factory=lambda: np.full(CODES, -1, np.int16))  # column of each code
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))  # grams x landmarks
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # landmarks x languages
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZES)))  # least share of known n-grams, languages x sizes

    def kernels(self, codes: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        matrix = np.zeros((len(codes), len(self.landmarks)), np.float32)
        for i, c in enumerate(codes):
            at = self.place[c]
            matrix[i, at[at >= 0]] = 1
        matrix /= np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))
        return matrix @ self.landmarks

    def values(self, codes: list[np.ndarray]) -> np.ndarray:
        return self.kernels(codes) @ self.coefficients

    def familiar(self, codes: list[np.ndarray], languages: np.ndarray) -> np.ndarray:
        """Whether the texts have as many known n-grams as texts of these languages (numbers) have."""
        share = np.array([(self.place[c] >= 0).mean() for c in codes])
        return share >= self.limits[languages, _size_class(codes)]


def _size_class(codes: list[np.ndarray]) -> np.ndarray:
    return np.minimum(np.log2([max(len(c), 1) for c in codes]).astype(int), SIZES - 1)


def _known(codes: list[np.ndarray], grams: int) -> np.ndarray:
    """The n-grams that occur in most texts, in order."""
    frequency = np.zeros(CODES, np.int64)
    for c in codes:
        frequency[c] += 1
    known = np.sort(np.argsort(-frequency, kind="stable")[:grams])
    return known[frequency[known] > 0]


def limits_of(codes: list[np.ndarray], labels: list[str], grams: int = GRAMS) -> np.ndarray:
    """Least share of known n-grams by language and size; 0 if there are too few texts to hold any out.

    A limit stands on the held-out texts of at least half the size, or the FEW largest.
    """
    languages = sorted(set(labels))
    limits = np.zeros((len(languages), SIZES))
    if len(codes) < FOLDS:
        return limits
    share = np.zeros(len(codes))
    for fold in range(FOLDS):
        known = np.zeros(CODES, bool)
        known[_known([c for i, c in enumerate(codes) if i % FOLDS != fold], grams)] = True
        for i in range(fold, len(codes), FOLDS):
            share[i] = known[codes[i]].mean()
    size, label = np.array([len(c) for c in codes]), np.array(labels)
    for k, name in enumerate(languages):
        own = np.flatnonzero(label == name)
        own = own[np.argsort(-size[own], kind="stable")]
        for i in range(SIZES):
            least = max(FEW, int((size[own] >= 2**i / 2).sum()))
            limits[k, i] = max(np.quantile(share[own[:least]], STRAYS) - SLACK - 2 ** (-i / 2), 0)
    return limits


def learnt(codes: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, grams: int = GRAMS) -> Model:
    """Ridge regression on kernels with landmarks taken in turn from the languages."""
    languages = sorted(set(labels))
    known = _known(codes, grams)
    place = np.full(CODES, -1, np.int16)
    place[known] = np.arange(len(known))
    model = Model(languages, place, limits=limits_of(codes, labels, grams))
    y = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    matrix = np.zeros((len(chosen), len(known)), np.float32)
    for i, j in enumerate(chosen):
        at = place[codes[j]]
        matrix[i, at[at >= 0]] = 1
    model.landmarks = (matrix / np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))).T
    k = np.concatenate([model.kernels(codes[a : a + BATCH]) for a in range(0, len(codes), BATCH)]).astype(np.float64)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language has the same weight, however many texts it has.
    weight = (1 / np.bincount(y))[y][:, None] * len(y) / len(languages)
    own = k[chosen]
    model.coefficients = np.linalg.lstsq(
        k.T @ (weight * k) + RIDGE * len(y) * (own + own.T) / 2 + 1e-9 * np.eye(len(chosen)), k.T @ (weight * target), rcond=None
    )[0].astype(np.float32)
    return model


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model learnt from text and language of the rows where ``usable`` holds and neither is NULL.

    Up to ``sample`` rows, dealt evenly to the languages (LEAST_EACH for each, if there are very many): of each the first by
    a hash of the row. So a language is learnt however rare it is. What comes to the driver is the codes of
    their n-grams, of which a text has no more than CODES. Without such rows the model knows no language.
    """
    named = docs.filter(usable & F.col(f"`{lang_col}`").isNotNull())
    at = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    named = named.filter(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    rows = named.select(at.alias("at"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = {r["lang"]: r["count"] for r in named.groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang")).count().collect()}  # one row a language
    each = max(sample // max(len(counts), 1), LEAST_EACH)
    # About twice as many as are taken, by a threshold for each language; then the first of those.
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2.0 * each / n) * 2**31) + 1)]) if counts else F.lit(None).cast("map<string,int>")
    low = rows.filter(F.shiftrightunsigned("at", 33) < F.try_element_at(shares, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("text")))
    picked = low.withColumn("nth", nth).filter(F.col("nth") <= each)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CODES, bool)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            codes = pa.array([present(t.as_py(), seen).astype(np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], names=["lang", "codes"])

    got = picked.select("lang", "text").mapInArrow(coded, "lang string, codes array<int>").toArrow()
    if not got.num_rows:
        return Model()
    labels = got.column("lang").to_pylist()
    return learnt([c.values.to_numpy() for c in got.column("codes")], labels)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", familiar_col: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, higher: surer), from the whole text and nothing else.

    Texts that are NULL or have no letter are undetermined ("und", score 0), and so is every text where
    the model knows no language. All other columns and rows stay as they are; columns of these two names are
    replaced. ``familiar_col`` adds a column that is true where the text has as many known n-grams as texts of
    that language have (as a whole, or without words that hold digits), which one in a language that the model
    does not know has not.
    """
    docs = docs.drop("lang_pred", "score", *([familiar_col] if familiar_col else []))
    has_letter = free_name(docs, "_has_letter")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CODES, bool)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            letters = batch.column(batch.schema.get_field_index(has_letter)).to_pylist()
            langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            familiar = np.zeros(batch.num_rows, bool)
            rows = [i for i, ok in enumerate(letters) if ok and model.languages]
            for a in range(0, len(rows), BATCH):
                part = rows[a : a + BATCH]
                codes = [present(texts[i].as_py(), seen) for i in part]
                values = model.values(codes)
                best = values.argmax(1)
                if familiar_col:
                    familiar[part] = model.familiar(codes, best)
                    for i, k in zip(part, best):
                        rest = b"" if familiar[i] else WITH_DIGIT.sub(b" ", texts[i].as_py())
                        if LETTER.search(rest):
                            familiar[i] = model.familiar([present(rest, seen)], [k])[0]
                scores[part] = np.clip((values[np.arange(len(part)), best] + 1) / 2, 0, 1)
                for i, k in zip(part, best):
                    langs[i] = model.languages[k]
            kept = batch.drop_columns([has_letter])
            kept = kept.append_column("lang_pred", pa.array(langs)).append_column("score", pa.array(scores, pa.float64()))
            yield kept.append_column(familiar_col, pa.array(familiar)) if familiar_col else kept

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if familiar_col:
        fields.append(T.StructField(familiar_col, T.BooleanType()))
    marked = docs.withColumn(has_letter, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(score, T.StructType(fields))
