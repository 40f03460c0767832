"""A quality classifier: a convolutional network over bytes, in NumPy.

A text is cut into overlapping chunks that cover all of it. In each chunk every filter is laid
over windows of embedded bytes, and the largest answer is kept; a small network turns the
largest answers into the chunk's logit. The mean logit of its chunks is the document's, so that a
long text is judged by all it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

CHUNK = 256  # bytes
OVERLAP = 32
WIDTH, STEP = 12, 4  # of the filters' windows
EMBED, FILTERS, HIDDEN = 6, 48, 24
SAMPLE = 2000  # labelled documents of each class from which the network is learnt
CHUNKS_EACH = 4  # chunks of a sampled document
EPOCHS, BATCH, RATE = 8, 64, 4e-3
AT_ONCE = 256  # chunks scored together
WINDOWS = (CHUNK - WIDTH) // STEP + 1


@dataclass
class Network:
    """Weights; ``prior`` moves the balanced logit to the share of classes among the labels."""

    weights: dict[str, np.ndarray]
    prior: float = 0.0

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            {
                "bytes": normal(256, EMBED, scale=0.5),
                "filters": normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
                "filter_bias": np.zeros(FILTERS, np.float32),
                "mix": normal(FILTERS + 1, HIDDEN, scale=(2 / FILTERS) ** 0.5),
                "mix_bias": np.zeros(HIDDEN, np.float32),
                "out": normal(HIDDEN, 1, scale=(1 / HIDDEN) ** 0.5),
                "out_bias": np.zeros(1, np.float32),
            }
        )

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, windows, width * embed): what the filters are laid over. Byte 0, the filling, embeds as zeros."""
        table = self.weights["bytes"].copy()
        table[0] = 0
        flat = table[chunks].reshape(len(chunks), CHUNK * EMBED)
        strided = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)
        return strided[:, :: STEP * EMBED][:, :WINDOWS]

    def forward(self, chunks: np.ndarray, filled: np.ndarray, keep: bool = False):
        """Logits of chunks; ``filled`` is the share of bytes that are text."""
        w = self.weights
        windows = self.windows(chunks)
        answers = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ w["filters"]
        answers = answers.reshape(len(chunks), WINDOWS, FILTERS)
        top = answers.argmax(axis=1) if keep else None
        pooled = np.maximum(answers.max(axis=1) + w["filter_bias"], 0)
        joined = np.concatenate([pooled, filled[:, None].astype(np.float32)], axis=1)
        hidden = np.maximum(joined @ w["mix"] + w["mix_bias"], 0)
        logit = (hidden @ w["out"])[:, 0] + w["out_bias"][0]
        return (logit, windows, top, joined, hidden) if keep else logit

    def gradients(self, chunks: np.ndarray, filled: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        logit, windows, top, joined, hidden = self.forward(chunks, filled, keep=True)
        slope = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)[:, None]
        to_hidden = (slope @ w["out"].T) * (hidden > 0)
        to_pooled = (to_hidden @ w["mix"].T)[:, :FILTERS] * (joined[:, :FILTERS] > 0)
        # Only the window with the largest answer of each filter has a share in it.
        rows = np.arange(len(chunks))[:, None]
        best = windows[rows, top]
        to_best = to_pooled[:, :, None] * w["filters"].T
        at = (top * STEP)[:, :, None] + np.arange(WIDTH)
        symbols = chunks[rows[:, :, None], at]
        to_bytes = np.zeros_like(w["bytes"])
        np.add.at(to_bytes, symbols.ravel(), to_best.reshape(-1, EMBED))
        to_bytes[0] = 0
        return {
            "bytes": to_bytes,
            "filters": np.einsum("bfw,bf->wf", best, to_pooled),
            "filter_bias": to_pooled.sum(0),
            "mix": joined.T @ to_hidden,
            "mix_bias": to_hidden.sum(0),
            "out": hidden.T @ slope,
            "out_bias": slope.sum(0),
        }


def learnt(chunks: np.ndarray, filled: np.ndarray, labels: np.ndarray, prior: float, seed: int = 7) -> Network:
    """A network fitted by Adam to chunks and their documents' labels."""
    net = Network.fresh(seed)
    net.prior = prior
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    total = max(1, EPOCHS * ((len(labels) + BATCH - 1) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in net.gradients(chunks[part], filled[part], labels[part]).items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                fix = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                net.weights[name] = (net.weights[name] - fix * mean[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)
    return net


def chunk_matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, share filled, document of each chunk). The last chunk of a text ends where the text ends."""
    places, docs, filled = [], [], []
    at = 0
    for d, t in enumerate(texts):
        last = max(0, len(t) - CHUNK)
        starts = np.append(np.arange(0, last, CHUNK - OVERLAP), last)
        places.append(starts + at)
        docs.append(np.full(len(starts), d))
        filled.append(np.full(len(starts), min(len(t), CHUNK) / CHUNK))
        at += max(len(t), CHUNK)
    if not texts:
        return np.empty((0, CHUNK), np.uint8), np.empty(0), np.empty(0, np.int64)
    data = np.frombuffer(b"".join(t.ljust(CHUNK, b"\0") for t in texts), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(data, CHUNK)
    return view[np.concatenate(places)], np.concatenate(filled), np.concatenate(docs)


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; an empty text is one chunk of filling."""
    chunks, filled, docs = chunk_matrix(texts)
    logits = [net.forward(chunks[a : a + AT_ONCE], filled[a : a + AT_ONCE]) for a in range(0, len(chunks), AT_ONCE)]
    sums = np.bincount(docs, np.concatenate([np.empty(0), *logits]), minlength=len(texts))
    mean = sums / np.maximum(np.bincount(docs, minlength=len(texts)), 1)
    return 1 / (1 + np.exp(-(mean + net.prior)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Network:
    """The network for ``labels`` (doc_id, quality 0 or 1) of the documents where ``usable`` holds for the doc_id.

    It is learnt from up to ``sample`` documents of each class, the first by a hash of the id, and
    CHUNKS_EACH chunks of each from places found by the same hash; chunks, not texts, come to
    the driver. NULL labels and NULL ids are left out. Without labels of both classes, scores
    say nothing and lie near the middle.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1]).distinct()  # 2 * sample rows at most
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    numbers = F.sequence(F.lit(0), F.lit(CHUNKS_EACH - 1))
    cut = docs.join(F.broadcast(picked), "doc_id").select("label", "doc_id", body.alias("body"), F.explode(numbers).alias("i"))
    room = F.greatest(F.octet_length("body") - CHUNK, F.lit(0)) + 1
    cut = cut.withColumn("start", F.pmod(F.xxhash64("doc_id", "i"), room).cast("int"))
    # A repeated id can bring any number of rows: as many as there should be are taken.
    rows = (
        cut.select("label", "doc_id", "i", "start", F.substring(F.col("body"), F.col("start") + 1, F.lit(CHUNK)).alias("bytes"))
        .orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i", "bytes")
        .limit(2 * sample * CHUNKS_EACH)
        .collect()
    )
    if not rows or len(counts) < 2:
        return Network.fresh(7)
    texts = [bytes(r["bytes"]) for r in rows]
    chunks = np.frombuffer(b"".join(t.ljust(CHUNK, b"\0") for t in texts), np.uint8).reshape(-1, CHUNK)
    y = np.array([r["label"] for r in rows], np.float32)
    # The sample has as many of both classes as there are, up to its bound; the labels have their own shares.
    prior = np.log(counts[1] / counts[0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return learnt(chunks, np.array([len(t) / CHUNK for t in texts]), y, float(prior))


def with_quality(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1, from the whole text and nothing else.

    NULL texts count as empty. All other columns and rows stay as they are; a column of that name is replaced.
    """
    docs = docs.drop(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            scores, some, size = [np.empty(0)], [], 0
            for t in column:
                some.append(t.as_py() or b"")
                size += len(some[-1])
                if size >= 1 << 20:
                    scores.append(score_texts(net, some))
                    some, size = [], 0
            scores.append(score_texts(net, some))
            yield batch.append_column(out, pa.array(np.concatenate(scores), pa.float64()))

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
