"""Repeated byte strings by prefix doubling over a sparse suffix array.

The rank of a position stands for the bytes that follow it. Doubling starts from ranks of a short length, Rabin-Karp
fingerprints. The rank of twice the length is made of a pair: the rank of a position and that of
the position one length further on. In each round Spark deals the ranks to ranges, each range is sorted, and
positions whose rank is unique drop out before the next round, until the threshold is passed. For
200 bytes the offsets are 25, 50 and 100. Three things keep what is sorted small:

* All rounds but the last are at anchors only: the smallest hashed byte string within each half-threshold of
  text. Equal strings of the full threshold hold an anchor at the same place, followed by half a threshold
  of equal text.
* An anchor whose whole surroundings are repeated settles all strings around it at once; one of
  those equal surroundings goes on, to be met by others.
* Ranks are 64-bit numbers that are not made dense, positions stay with their text, and answers come as bits (see
  ``exchange``): a rank is unique or not, which is all that the next round asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm import exchange as ex
from recollect.llm.substrings import slices

LENGTH = 200
CHUNK_BYTES = 4 << 20
GRAM = 8  # bytes hashed to choose anchors
_U = np.uint64


def lengths(length: int) -> list[int]:
    """The lengths of ranks: halves of ``length``, down to an eighth if it divides evenly."""
    out = [length]
    while len(out) < 4 and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    return out


class Slice:
    """Anchors and ranks of some documents of a chunk."""

    def __init__(self, data: bytes, sizes: np.ndarray, at: int, end: int, length: int) -> None:
        self.length, self.half = length, length // 2
        chars = np.frombuffer(data, np.uint8, count=end - at, offset=at)
        self.at, n = at, len(chars)
        ends = np.cumsum(sizes)
        many = np.maximum(sizes - length + 1, 0)
        # Starts of strings of the full length, which all lie within one document.
        done = np.cumsum(many)
        self.starts = np.arange(many.sum()) - np.repeat(done - many, many) + np.repeat(ends - sizes, many)
        if not len(self.starts):
            return
        self.ranked: tuple[int, np.ndarray] | None = None
        self.rolling = ex.Rolling(ex.byte_values()[chars])
        padded = np.concatenate([chars, np.zeros(GRAM, np.uint8)])
        grams = np.ndarray((n,), "<u8", padded, strides=(1,))
        place = np.arange(n, dtype=np.uint64)
        least = (ex.mixed(grams * _U(ex.BASE)) & ~_U(0xFFFFFFFF)) | place if n < 1 << 32 else None
        least = self._least(least, self.half)
        anchor = (least[self.starts] & _U(0xFFFFFFFF)).astype(np.int64)
        # Documents are not mixed up: a string starts and ends within one, and so does its anchor.
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]]) | np.concatenate([[True], np.diff(self.starts) != 1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, len(anchor)))
        self.anchor, self.first = anchor[first], first
        lo, hi = self.starts[first], self.starts[first] + self.count - 1
        where = (self.anchor - lo).astype(np.uint64) << _U(32) | self.count.astype(np.uint64)
        self.around_rank = ex.mixed(self.rolling.of(lo, hi + length) ^ ex.mixed(where + _U(1)))

    @staticmethod
    def _least(values: np.ndarray, width: int) -> np.ndarray:
        """Least of each ``width`` values, by start, with shorter stretches at the end."""
        out, have = values, 1
        while have < width:
            step = min(have, width - have)
            out = np.concatenate([np.minimum(out[: len(out) - step], out[step:]), out[len(out) - step :]])
            have += step
        return out

    def ranks(self, length: int) -> np.ndarray:
        """Ranks of ``length`` (of ``lengths``) by position: of the shortest as fingerprints, of others as pairs of ranks of half of it."""
        if self.ranked is None or self.ranked[0] > length:
            shortest = lengths(self.length)[0]
            self.ranked = shortest, self.rolling.windows(shortest)
        while self.ranked[0] < length:  # rounds ask for growing lengths: each goes on from the one before
            half, rank = self.ranked
            left, right = rank[: len(rank) - half], rank[half:]
            self.ranked = 2 * half, ex.mixed(left * _U(3) + ((right << _U(31)) | (right >> _U(33))))
        return self.ranked[1]


def _slices(data: bytes, sizes: np.ndarray, length: int) -> Iterator[Slice]:
    for a, b, at, end in slices(sizes):
        part = Slice(data, sizes[a:b], at, end, length)
        if len(part.starts):
            yield part


class Judged:
    """What the answers so far say about a chunk: the anchors still open, and strings that are repeated for sure.

    Rounds are numbered from 1; round r asks about the r-th of ``lengths`` after the first, those before
    the last at anchors, that before the last about the surroundings of anchors, too.
    """

    def __init__(self, data: bytes, sizes: np.ndarray, answers: pa.Table | None, length: int, rounds: int) -> None:
        """``rounds``: how many rounds at anchors have been answered."""
        self.parts = list(_slices(data, sizes, length))
        self.length, self.steps = length, anchor_steps(length)
        self.open = [np.ones(len(s.anchor), bool) for s in self.parts]
        self.sure: list[np.ndarray] = []  # byte positions in the chunk
        for r, step in enumerate(self.steps[:rounds], 1):
            self._answer(answers, r, step)

    def asked(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of open anchors, of their surroundings or nothing) in the order of the parts."""
        none = np.empty(0, np.uint64)
        ranks = [s.ranks(step)[s.anchor[o]] for s, o in zip(self.parts, self.open) if o.any()]
        around = [s.around_rank[o] for s, o in zip(self.parts, self.open)] if step == self.steps[-1] else []
        return np.concatenate([none, *ranks]), np.concatenate([none, *around])

    def _answer(self, answers: pa.Table, round_: int, step: int) -> None:
        rank, around = self.asked(step)
        values, counts = np.unique(np.concatenate([rank, around]), return_counts=True)
        earlier, elsewhere = ex.answered(answers, round_)
        again = elsewhere | (counts > 1)
        goes_on = again[np.searchsorted(values, rank)]
        if step == self.steps[-1]:
            spot = np.searchsorted(values, around)
            around_again = again[spot]
            # One of equal surroundings is the first of all: it stands for them in the last round.
            first = np.zeros(len(around), bool)
            first[np.unique(around, return_index=True)[1]] = True
            first &= ~earlier[spot] if len(spot) else first
            goes_on &= ~around_again | first
        a = 0
        for n, (s, o) in enumerate(zip(self.parts, self.open)):
            at = np.flatnonzero(o)
            b = a + len(at)
            if step == self.steps[-1]:
                whole = np.zeros(len(o), bool)
                whole[at] = around_again[a:b]
                self.sure.append(s.starts[np.repeat(whole, s.count)] + s.at)
            o[at] = goes_on[a:b]
            a = b

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte positions, ranks of the full length) of the strings that open anchors stand for."""
        at, ranks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for s, o in zip(self.parts, self.open):
            if o.any():
                start = s.starts[np.repeat(o, s.count)]
                at.append(start + s.at)
                ranks.append(s.ranks(self.length)[start])
        return np.concatenate(at), np.concatenate(ranks)


def anchor_steps(length: int) -> list[int]:
    """Lengths of the rounds at anchors."""
    return lengths(length)[1:-1] or lengths(length)[:1]


def _next(length: int, rounds: int, step: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """States the ranks of ``step`` of what is open after ``rounds`` rounds."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        _, sizes, data = ex.opened(chunk)
        judged = Judged(data, sizes, answers, length, rounds)
        ranks = judged.strings()[1] if step == length else np.concatenate(judged.asked(step))
        return ex.stated(chunk.column("chunk")[0].as_py(), ex.distinct(ranks), bits)

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept]): what is left of each document's UTF-8 bytes.

    A byte goes if a string of ``length`` (even) bytes of its document that holds it also starts anywhere
    else, in the same document or another; occurrences may overlap and are judged on the
    input. spans: [first byte, byte after the last] of the maximal removed runs. NULL, empty and
    short texts lose nothing. Repeated rows are documents of their own, so that equal long texts lose all.
    Extra columns are ignored; no rows give no rows.
    """
    if length % 2 or length < 2 * GRAM:
        raise ValueError(f"length must be even and {2 * GRAM} at least")
    chunks = ex.make_chunks(docs, CHUNK_BYTES, False, id_col, text_col)
    total = ex.total_bytes(chunks)
    by_chunk = chunks.groupBy("chunk")
    steps = anchor_steps(length)
    bits = ex.part_bits(8 * total // length)  # anchors come about twice in each half-length
    flags: DataFrame | None = None
    for round_, step in enumerate(steps, 1):
        if flags is None:
            stated = ex.state_all(chunks, lambda data, sizes, step=step: np.concatenate(Judged(data, sizes, None, length, 0).asked(step)), bits)
        else:
            stated = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(_next(length, round_ - 1, step, bits), ex.PARTS)
        answers = ex.counted(stated, round_)
        flags = answers if flags is None else flags.unionByName(answers)
    last = len(steps) + 1
    stated = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(_next(length, len(steps), length, ex.part_bits(total // 4)), ex.PARTS)
    flags = flags.unionByName(ex.counted(stated, last))
    kinds = {
        "id": pa.int64(),
        "n_bytes": pa.int64(),
        "n_removed": pa.int64(),
        "n_spans": pa.int64(),
        "spans": pa.list_(pa.list_(pa.int64())),
        "kept_sha256": pa.string(),
    }
    schema = "id long, n_bytes long, n_removed long, n_spans long, spans array<array<bigint>>, kept_sha256 string"
    if with_text:
        kinds["kept"], schema = pa.binary(), schema + ", kept binary"

    def remove(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, data = ex.opened(chunk)
        judged = Judged(data, sizes, answers, length, len(steps))
        at, ranks = judged.strings()
        _, which, counts = np.unique(ranks, return_inverse=True, return_counts=True)
        _, elsewhere = ex.answered(answers, last)
        again = (elsewhere | (counts > 1))[which] if len(ranks) else np.empty(0, bool)
        depth = np.zeros(len(data) + 1, np.int32)
        for start in (*judged.sure, at[again]):
            depth[start] = 1
        # A byte is covered if a repeated string started among the last ``length`` bytes of its document;
        # no string crosses into the next.
        ends = np.zeros(len(data) + 1, np.int32)
        hit = np.flatnonzero(depth[: len(data)])
        ends[hit + length] = 1
        gone = np.cumsum(depth[:-1] - ends[:-1]) > 0
        out: dict[str, list] = {name: [] for name in kinds}
        at = 0
        for i, size in zip(ids, sizes.tolist()):
            mask = gone[at : at + size]
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            edges = [0, *turns.ravel().tolist(), size]
            kept = b"".join(data[at + a : at + b] for a, b in zip(edges[::2], edges[1::2]))
            out["id"].append(i)
            out["n_bytes"].append(size)
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(len(turns))
            out["spans"].append(turns.tolist())
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
            at += size
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return (
        by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)
    )
