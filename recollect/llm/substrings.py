"""Substring dedup by Rabin-Karp hashes of every window of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm import exchange as ex

WINDOW = 20
CHUNK_BYTES = 8 << 20
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last, first byte, last): documents taken together up to ``most`` bytes, one at least."""
    ends = np.cumsum(sizes)
    a = at = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, at + most, side="right")))
        yield a, b, at, int(ends[b - 1])
        a, at = b, int(ends[b - 1])


def word_hashes(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each document)."""
    value = ex.byte_values()
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(sizes), np.int64)
    for a, b, at, end in slices(sizes):
        chars = np.frombuffer(data, np.uint8, count=end - at, offset=at)
        if not len(chars):
            continue
        edge = np.cumsum(sizes[a:b])  # a document's end is the end of a word
        space = _SPACE[chars]
        starts_doc = np.zeros(len(chars) + 1, bool)
        starts_doc[np.concatenate([[0], edge])] = True
        before = np.concatenate([[True], space[:-1]]) | starts_doc[:-1]
        after = np.concatenate([space[1:], [True]]) | starts_doc[1:]
        start, stop = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        rolling = ex.Rolling(value[chars])
        hashes.append(ex.mixed(rolling.of(start, stop) + (stop - start).astype(np.uint64)))
        counts[a:b] = np.diff(np.searchsorted(start, np.concatenate([[0], edge])))
    return np.concatenate(hashes), counts


def window_starts(counts: np.ndarray, window: int) -> np.ndarray:
    """Word positions in the chunk at which a window of one document starts."""
    n = np.maximum(counts - window + 1, 0)
    first = np.cumsum(counts) - counts
    ends = np.cumsum(n)
    return np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(first, n)


def windows(data: bytes, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, their first words in the chunk, words of each document)."""
    words, counts = word_hashes(data, sizes)
    start = window_starts(counts, window)
    return ex.Rolling(words).windows(window)[start], start, counts


def repeated_windows(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept_sha256[, kept]): what is left of each document.

    A word goes if a window of ``window`` words of its document that holds it starts earlier as
    well: in a document of smaller id (NULL last; equal ids by a hash of their texts) or
    earlier in the same. Windows are judged on the input. spans: [first word, word after the last] of
    the maximal removed intervals. Kept words are joined by one blank. NULL, empty and short
    texts have no windows and lose nothing. Extra columns are ignored; no rows give no rows.
    """
    chunks = ex.make_chunks(docs, CHUNK_BYTES, True, id_col, text_col)
    bits = ex.part_bits(ex.total_bytes(chunks) // 6)
    flags = ex.counted(ex.state_all(chunks, lambda data, sizes: windows(data, sizes, window)[0], bits), 1)
    kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "kept_sha256": pa.string()}
    schema = "id long, n_words long, n_removed long, spans array<array<bigint>>, kept_sha256 string"
    if with_text:
        kinds["kept"], schema = pa.string(), schema + ", kept string"

    def remove(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, data = ex.opened(chunk)
        hashes, start, counts = windows(data, sizes, window)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        earlier, _ = ex.answered(answers, 1)
        again = earlier[which] | (first[which] != np.arange(len(hashes))) if len(hashes) else np.empty(0, bool)
        depth = np.zeros(int(counts.sum()) + 1, np.int32)
        np.add.at(depth, start[again], 1)
        np.add.at(depth, start[again] + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        out: dict[str, list] = {name: [] for name in kinds}
        at = word = 0
        for i, size, n in zip(ids, sizes.tolist(), counts.tolist()):
            mask = gone[word : word + n]
            words = data[at : at + size].split()
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            kept = b" ".join(compress(words, (~mask).tolist()) if len(turns) else words)
            out["id"].append(i)
            out["n_words"].append(n)
            out["n_removed"].append(int(mask.sum()))
            out["spans"].append(turns.reshape(-1, 2).tolist())
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept.decode())
            at, word = at + size, word + n
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return (
        chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)
    )
