"""SimHash fingerprints and near-duplicate groups by anchor points.

The anchors are the words of a covering code: two binary Golay codes of length 23 side by side,
on 46 of the 64 bits. Each has covering radius 3, so every fingerprint has an anchor within 6.
Fingerprints that differ in ``reach`` bits or fewer on both sides of a midpoint meet at the
midpoint's anchor, which is within the covering radius plus that reach of both. Each fingerprint
is copied to every such anchor and compared there with the others. Where a region is so crowded
that an anchor holds many fingerprints, those go to the anchors of the finest code, the midpoints
themselves, where at most 65 can meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from recollect.llm.common import free_name
from recollect.llm.components import connected_components
from recollect.sources.tables import stage

# The constants of XXH64 and the generator polynomial of the Golay code.
P1, P2, P3, P4, P5 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
GOLAY = 0b110001110101
SEED = 42
SHINGLE = 3
CROWD = 256  # fingerprints compared pair by pair at one anchor
SLICE = 1 << 20  # bytes of text hashed at a time

_SPACES = b" \t\n\v\f\r"
_PLAIN = bytes(ord(" ") if c in _SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain(text: bytes) -> bytes:
    """A-Z lower-cased, words joined by single blanks."""
    out = text.translate(_PLAIN).strip(b" ")
    return b" ".join(out.split()) if b"  " in out else out


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[starts[i]:ends[i]], worked out for all strings of one length together."""
    u = np.uint64
    out = np.empty(len(starts), np.uint64)
    padded = np.frombuffer(buf + bytes(8), np.uint8)
    wide = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(np.minimum(lengths, 32)[order], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            which = order[cuts[n] : cuts[n + 1]]
            if not len(which):
                continue
            at = starts[which]
            h = np.full(len(which), (seed + P5 + n) & ((1 << 64) - 1), np.uint64)
            left = n
            while left >= 8:
                h ^= _rotated(wide[at] * u(P2), 31) * u(P1)
                h = _rotated(h, 27) * u(P1) + u(P4)
                at, left = at + 8, left - 8
            if left >= 4:
                h ^= (wide[at] & u(0xFFFFFFFF)) * u(P1)
                h = _rotated(h, 23) * u(P2) + u(P3)
                at, left = at + 4, left - 4
            while left:
                h ^= padded[at].astype(np.uint64) * u(P5)
                h = _rotated(h, 11) * u(P1)
                at, left = at + 1, left - 1
            h = (h ^ (h >> u(33))) * u(P2)
            h = (h ^ (h >> u(29))) * u(P3)
            out[which] = h ^ (h >> u(32))
    for i in order[cuts[32] :]:
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]], seed)
    return out


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as a signed 64-bit integer; 0 for texts without a word."""
    out = np.zeros(len(texts), np.int64)
    clean = [plain(t) if t else b"" for t in texts]
    full = [i for i, t in enumerate(clean) if t]
    first = 0
    while first < len(full):
        last, size = first, 0
        while last < len(full) and (size == 0 or size + len(clean[full[last]]) <= SLICE):
            size += len(clean[full[last]])
            last += 1
        chosen = full[first:last]
        out[chosen] = majority(*shingle_hashes([clean[i] for i in chosen], shingle))
        first = last
    return out


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the shingles of plain texts that are not empty; of fewer words, the whole sequence."""
    buf = b"\n".join(texts)
    chars = np.frombuffer(buf, np.uint8)
    gaps = np.flatnonzero((chars == 32) | (chars == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    doc = np.concatenate([[0], np.cumsum(chars[gaps] == 10)])
    words = np.bincount(doc, minlength=len(texts))
    lead = np.concatenate([[0], np.cumsum(words)])[:-1]
    span = np.minimum(words, shingle)
    counts = words - span + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - lead, counts)
    return xxh64(buf, starts[begin], ends[begin + np.repeat(span, counts) - 1]), offsets


def majority(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash, as a signed integer, of the hashes of each text."""
    # Bits are added up in pieces, which keeps a very long text within bounds.
    totals = np.zeros((len(offsets) - 1, 64), np.int64)
    step = 1 << 16
    for a in range(0, len(h), step):
        part = h[a : a + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(offsets, [a, a + len(part) - 1], side="right") - 1
        edges = np.maximum(offsets[lo : hi + 1] - a, 0)
        totals[lo : hi + 1] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    bits = totals * 2 > np.diff(offsets)[:, None]
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp LONG) for each row; a NULL text has fingerprint 0, like one without words."""

    def made(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if batch.num_rows else batch.column(1)
            fps, some, size = [], [], 0
            for t in texts:
                some.append(t.as_py())
                size += len(some[-1] or b"")
                if size >= 4 * SLICE:
                    fps.append(fingerprints(some, shingle))
                    some, size = [], 0
            fps.append(fingerprints(some, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps), pa.int64())], names=["id", "fp"])

    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(made, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


class Golay:
    """Nearest code word of 23-bit words, by syndrome; the code is perfect, so it is unique."""

    def __init__(self) -> None:
        one = [_remainder(1 << i) for i in range(23)]
        self.part = np.zeros((3, 256), np.int64)
        for byte in range(3):
            for v in range(256):
                for bit in range(8):
                    if v >> bit & 1 and byte * 8 + bit < 23:
                        self.part[byte, v] ^= one[byte * 8 + bit]
        self.error = np.zeros(2048, np.int64)
        for a in range(23):
            self.error[one[a]] = 1 << a
            for b in range(a):
                self.error[one[a] ^ one[b]] = 1 << a | 1 << b
                for c in range(b):
                    self.error[one[a] ^ one[b] ^ one[c]] = 1 << a | 1 << b | 1 << c

    def nearest(self, words: np.ndarray) -> np.ndarray:
        syndrome = self.part[0][words & 255] ^ self.part[1][words >> 8 & 255] ^ self.part[2][words >> 16 & 255]
        return words ^ self.error[syndrome]


def anchors(fps: np.ndarray, reach: int, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors of words within ``reach`` bits of each fingerprint."""
    bits = fps.view(np.uint64)
    low = (bits & np.uint64((1 << 23) - 1)).astype(np.int64)
    high = (bits >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)

    # Rings of words at 0, 1, ... reach flipped bits in each half, shared between the halves.
    def rings(word: np.ndarray) -> list[np.ndarray]:
        flips, out = [0], [code.nearest(word)[:, None]]
        for _ in range(reach):
            flips = sorted({f | 1 << b for f in flips for b in range(23) if not f >> b & 1})
            out.append(code.nearest(word[:, None] ^ np.array(flips, np.int64)))
        return out

    lows, highs = rings(low), rings(high)
    columns = []
    for a in range(reach + 1):
        for b in range(reach + 1 - a):
            pairs = lows[a][:, :, None] | highs[b][:, None, :] << 23
            columns.append(pairs.reshape(len(fps), -1))
    all_of = np.sort(np.concatenate(columns, axis=1), axis=1)
    new = np.ones(all_of.shape, bool)
    new[:, 1:] = all_of[:, 1:] != all_of[:, :-1]
    return np.nonzero(new)[0], all_of[new]


def _pairs_in_runs(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that share a key (sorted runs) and differ in ``most`` bits or fewer."""
    left, right = [], []
    at = np.arange(len(key) - 1)
    shift = 1
    while len(at):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        hit = np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + shift].view(np.uint64)) <= most
        left.append(fp[at[hit]])
        right.append(fp[at[hit] + shift])
        shift += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, most: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) of which the groups are the components.

    Every two fingerprints that differ in ``most`` bits or fewer are connected by links, though
    in crowded regions not always by one of their own: there each midpoint links its neighbours
    in a chain, which for an even ``most`` gives no link between others.
    """
    if most % 2:
        raise ValueError("an even number of bits is needed")
    reach = most // 2

    def replicate(batches):
        code = Golay()
        for batch in batches:
            for a in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy()[a : a + 4096]
                row, anchor = anchors(fp, reach, code)
                yield pd.DataFrame({"anchor": anchor, "fp": fp[row]})

    def compare(batches):
        key, fp, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

        def found(a, b, hot):
            return pd.DataFrame({"a": a, "b": b, "crowded": hot})

        for batch in batches:
            key = np.concatenate([key, batch["anchor"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy()])
            if not len(key):
                continue
            open_from = int(np.searchsorted(key, key[-1]))
            yield from settle(key[:open_from], fp[:open_from], crowded, found)
            key, fp = key[open_from:], fp[open_from:]
            if len(key) > crowd or crowded == key[0]:
                crowded = key[0]
                yield found(fp, fp, True)
                key, fp = key[:0], fp[:0]
        yield from settle(key, fp, crowded, found)

    def settle(key, fp, crowded, found):
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        hot = np.repeat((size > crowd) | (key[first] == crowded if crowded is not None else False), size)
        yield found(fp[hot], fp[hot], True)
        keep = ~hot & np.repeat(size > 1, size)
        a, b = _pairs_in_runs(key[keep], fp[keep], most)
        yield found(a, b, False)

    met = (
        fps.select("fp")
        .mapInPandas(replicate, "anchor long, fp long")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "fp")
        .mapInPandas(compare, "a long, b long, crowded boolean")
        .distinct()
    )
    met = stage(met, "anchor-links")

    def midpoints(batches):
        flips = [0]
        for _ in range(reach):
            flips = sorted({f ^ 1 << b for f in flips for b in range(64)} | set(flips))
        flips = np.array(flips, np.uint64).view(np.int64)
        for batch in batches:
            for a in range(0, len(batch), 4096):
                fp = batch["a"].to_numpy()[a : a + 4096]
                yield pd.DataFrame({"z": (fp[:, None] ^ flips).ravel(), "fp": np.repeat(fp, len(flips))})

    around = met.filter("crowded").select("a").mapInPandas(midpoints, "z long, fp long")
    chain = around.select(F.lag("fp").over(Window.partitionBy("z").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return met.filter("not crowded").select("a", "b").unionByName(chain.filter("a IS NOT NULL").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """(id_col, fp, component_id): one row for each row of ``docs``.

    component_id is the smallest id among the documents that links lead to, the document itself included.
    Equal texts have equal fingerprints and so one component; texts without a word (NULL, empty, blank) form
    one as well, with fingerprint 0. NULL ids never name a component, unless it has no other. Links are sought
    between distinct fingerprints only. Extra columns are ignored; no rows give no rows.
    """
    marked = stage(with_fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stage(marked.groupBy("fp").agg(F.min(F.col(id_col)).alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(fps, most))
    of_fp = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_fp = stage(of_fp, "fingerprint-roots")
    ids = of_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_fp.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def one_of_each_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates,
) -> DataFrame:
    """One row of ``docs`` for each group that ``find`` gives: that of the smallest id, NULL last.

    Among rows of that id the choice is by a hash of the row; of rows that are equal in all columns one stays.
    """
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    row, n = free_name(docs, "_near_row"), free_name(docs, "_near_n")
    keyed = docs.withColumn(row, F.xxhash64(others, F.col(f"`{text_col}`")))
    counted = keyed.groupBy(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    texts = keyed.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    groups = find(texts, "row", "text").select("row", "component_id").distinct()
    members = groups.join(stage(counted, "distinct-rows"), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row", "n"))
    kept = members.groupBy("component_id").agg(first.alias("first")).select(
        F.col("first.row").alias(row), F.col("first.n").alias(n)
    )
    # By sorting at every size: most rows are kept, so that what a small input would broadcast grows with it.
    found = keyed.join(stage(kept, "kept-rows").hint("merge"), row)
    # Rows repeated in every column are few; only those are brought together.
    once = found.filter(F.col(n) == 1)
    again = found.filter(F.col(n) > 1).dropDuplicates([row])
    return once.unionByName(again).select(*[f"`{c}`" for c in docs.columns])
