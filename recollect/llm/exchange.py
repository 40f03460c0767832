"""Where else does a fingerprint occur? Counting over all documents with few bytes shuffled.

Documents are gathered into chunks of some megabytes, stored compressed, one row for each. A
chunk states the distinct 64-bit fingerprints of what it holds, sorted and cut by their leading
bits; Spark brings the parts with equal leading bits together, where they are counted. Each part
gets two bits a fingerprint back: does it occur in an earlier chunk, and in any other. A chunk finds
its own positions again by making the same fingerprints from the same text, so that no
position ever travels. A fingerprint in a third of all places is one entry for each chunk.

Different strings of equal fingerprint would count as equal. Among n of them that is expected for
n * n / 2**65 pairs: less than one in a thousand for 10**8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recollect.sources.tables import stage

PART = 1_500_000  # fingerprints counted together, about 100 MB of memory
FLAGS = "round int, chunk long, part long, n int, earlier binary, elsewhere binary"
PARTS = "part long, chunk long, n int, data binary"


def make_chunks(docs: DataFrame, chunk_bytes: int, ordered: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, ids, sizes, data): documents one after the other, NULL texts as empty ones.

    ``ordered``: chunk numbers, and documents within a chunk, go up with the id (NULL last). A
    document is never divided; one that is longer than ``chunk_bytes`` has a chunk of its own.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.column(1).cast(pa.binary()))
            packed = pa.array([press.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([press.compress(b"".join(texts))], pa.binary()),
                ],
                names=["chunk", "ids", "sizes", "data"],
            )

        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                text = t.as_py() or b""
                text = open_.decompress(text) if ordered else text
                if texts and held + len(text) > chunk_bytes:
                    yield closed()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield closed()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if ordered:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col("id").asc_nulls_last(), F.xxhash64("data")]  # short: samples of it go to the driver
        rows = rows.mapInArrow(squeeze, "id long, data binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = rows.mapInArrow(gather, "chunk long, ids array<bigint>, sizes array<bigint>, data binary")
    return stage(made, "chunks")


def opened(row: pa.Table) -> tuple[list, np.ndarray, bytes]:
    """(ids, sizes, all bytes) of a one-row table of chunks."""
    data = zstandard.ZstdDecompressor().decompress(row.column("data")[0].as_py())
    return row.column("ids")[0].as_py(), np.array(row.column("sizes")[0].as_py(), np.int64), data


def total_bytes(chunks: DataFrame) -> int:
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return chunks.agg(F.sum(size)).first()[0] or 0


def part_bits(expected: int) -> int:
    """Leading bits that part the fingerprints, so that about PART of them are counted together."""
    return max(0, (max(expected, 1) // PART).bit_length())


def _packed(sorted_: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, in as few bytes each as the largest one needs."""
    steps = np.diff(sorted_, prepend=np.uint64(0))
    steps[0] = 0
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return int(sorted_[0]).to_bytes(8, "little") + planes.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : len(planes)] = planes.T
    out = steps.view(np.uint64).ravel()
    out[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(out, dtype=np.uint64)


def _cuts(distinct: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(part numbers, first positions) of sorted fingerprints."""
    parts = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
    first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.empty(0, np.int64)
    return parts[first], first


def stated(chunk: int, distinct: np.ndarray, bits: int) -> pa.Table:
    """The rows (PARTS) by which a chunk states its sorted distinct fingerprints."""
    parts, first = _cuts(distinct, bits)
    ends = np.append(first[1:], len(distinct))
    return pa.table(
        {
            "part": pa.array(parts, pa.int64()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            "n": pa.array(ends - first, pa.int32()),
            "data": pa.array([_packed(distinct[a:b]) for a, b in zip(first, ends)], pa.binary()),
        }
    )


def counted(statements: DataFrame, round_: int) -> DataFrame:
    """FLAGS for every statement, as a written table."""

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sizes = table.column("n").to_numpy()
        joined = np.concatenate([_unpacked(d.as_py(), n) for d, n in zip(table.column("data"), sizes)])
        order = np.argsort(joined, kind="stable")
        joined = joined[order]
        same = joined[1:] == joined[:-1]
        earlier, elsewhere = np.zeros(len(order), bool), np.zeros(len(order), bool)
        earlier[order[1:]] = same
        elsewhere[order[1:]] = same
        elsewhere[order[:-1]] |= same
        ends = np.cumsum(sizes)
        spans = list(zip(ends - sizes, ends))
        return pa.table(
            {
                "round": pa.array([round_] * len(spans), pa.int32()),
                "chunk": table.column("chunk"),
                "part": table.column("part"),
                "n": table.column("n"),
                "earlier": pa.array([np.packbits(earlier[a:b]).tobytes() for a, b in spans], pa.binary()),
                "elsewhere": pa.array([np.packbits(elsewhere[a:b]).tobytes() for a, b in spans], pa.binary()),
            }
        )

    return stage(statements.groupBy("part").applyInArrow(count, FLAGS), "flags")


def answered(flags: pa.Table, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, elsewhere) for the sorted distinct fingerprints that a chunk stated in a round."""
    rows = [r for r in flags.to_pylist() if r["round"] == round_]
    rows.sort(key=lambda r: r["part"])
    none = np.empty(0, bool)

    def bits(name: str) -> np.ndarray:
        return np.concatenate([none, *[np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["n"]).astype(bool) for r in rows]])

    return bits("earlier"), bits("elsewhere")


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def state_all(chunks: DataFrame, make: Callable[[bytes, np.ndarray], np.ndarray], bits: int) -> DataFrame:
    """PARTS of every chunk; ``make`` gives the fingerprints of (bytes, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                _, sizes, data = opened(row)
                chunk = row.column("chunk")[0].as_py()
                yield from stated(chunk, distinct(make(data, sizes)), bits).to_batches()

    return chunks.mapInArrow(run, PARTS)


# Rolling hashes. Sums of powers modulo 2**64 can only meet for strings much longer than the
# windows here when these are made to meet; a final mix spreads them over all bits.
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def byte_values() -> np.ndarray:
    """A pseudorandom 64-bit value for each byte."""
    return mixed((np.arange(256, dtype=np.uint64) + _U(1)) * _U(BASE))


INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Rabin-Karp hashes of ranges of a sequence of 64-bit values, the same wherever a range stands."""

    def __init__(self, values: np.ndarray) -> None:
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=self.sums[1:])
        self.shift = powers(INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]."""
        return mixed((self.sums[end] - self.sums[start]) * self.shift[start])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:-length]) * self.shift[:n])
