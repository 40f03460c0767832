"""Vector codes: each part of a vector by its nearest codebook entry, in exact whole numbers.

Components become integers. Squared distances come from inner products, |x|^2 - 2 x.c + |c|^2, and
inner products from float64 matrix products that are exact: integers are cut into limbs so short
that no sum of products of limbs reaches 2**53; the products of limbs are put together again in
int64. The first smallest distance names the entry.

Spark reads the vectors once a round. A task hands on one row of counts and sums for each
(part, entry) it has met, so that what is shuffled and what comes to the driver is bounded by the
codebooks, parts * entries * components, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.bounds import lookup
from recollect.sources.tables import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
# Components beyond this could lead to distances beyond int64.
MOST = 1 << 28
AT_ONCE = 8192  # vectors worked on together


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Summands of ``a``: limb i times 2**(i * bits). All but the last are in [0, 2**bits), the last has the sign."""
    out = []
    while int(np.abs(a).max(initial=0)) >= 1 << bits:
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` for int64 matrices, exact wherever the result itself is within int64."""
    width = a.shape[1]
    # width products of two limbs stay below 2**53.
    bits = (53 - max(width, 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    low = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(low):
            out += (x @ y.T).astype(np.int64) << ((i + j) * bits)
    return out


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part: vectors (n, parts, width), books (parts, entries, width)."""
    n, parts, _ = vectors.shape
    entries, distances = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for p in range(parts):
        x, c = vectors[:, p], books[p]
        d = (x * x).sum(1)[:, None] - 2 * exact_products(x, c) + (c * c).sum(1)[None, :]
        entries[:, p] = d.argmin(1)  # the first of equal ones
        distances[:, p] = d[np.arange(n), entries[:, p]]
    return entries, distances


def whole_numbers(vectors: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v): components as floor(scale * x), for vectors without NULL or non-finite components."""
    v = F.col(f"`{vec_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(v.isNotNull() & finite)
    big = F.exists(v, lambda x: F.abs(x.cast("double") * scale) >= float(MOST))
    error = F.raise_error(F.lit(f"a component times {scale:g} is beyond {MOST}, for which distances are not exact"))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.when(big, error.cast("array<bigint>")).otherwise(ints).alias("v")
    )


def _matrix(column: pa.ChunkedArray | pa.Array, parts: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), parts, -1)


def _batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            yield some, _matrix(some.column("v"), parts)


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and componentwise sums of the parts nearest to each entry, one row for each that a task has met."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for _, vectors in _batches(batches, parts):
            entries, _ = nearest(vectors, books)
            for p in range(parts):
                np.add.at(count[p], entries[:, p], 1)
                np.add.at(total[p], entries[:, p], vectors[:, p])
        p, e = np.nonzero(count)
        rows = {"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e])}
        rows["sums"] = pa.array(list(total[p, e]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(rows)

    return run


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry moved to floor(sum / count) of the parts nearest to it; unused entries stay."""
    met = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<bigint>")
    width = books.shape[2]
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (NULL last), equal ids in the order of their components."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    vectors = np.array([r["v"] for r in first], np.int64)
    return np.ascontiguousarray(vectors.reshape(len(first), parts, -1).transpose(1, 0, 2))


def text_of(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode_vectors(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, code, error), codebooks (parts, entries, width)).

    ``code``: the nearest entry of each part, two hex digits each; ``error``: the squared distances added up. Rows
    whose vector is NULL or holds NULL or non-finite components are left out. All vectors count
    that have the most frequent length (of equally frequent ones the greatest); vectors of another
    length come back with code and error NULL. That length must be a multiple of ``parts``, and no
    component may be beyond MOST; anything else raises. Rows of one id are coded each by itself,
    NULL ids are ids. With fewer vectors than ``entries`` the codebooks are shorter. Other columns are
    ignored. An empty table gives no rows and codebooks without entries.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = vectors.sparkSession
    rows = stage(whole_numbers(vectors, scale, id_col, vec_col, label_col), "whole-numbers")
    kinds = rows.groupBy(F.size("v").alias("length")).count()
    most = kinds.orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components do not divide into {parts} parts")
    usual = rows.filter(F.size("v") == length)
    books = first_codebooks(usual, parts, entries) if most else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if most else 0):
        books = improved(usual, books)
    digits = np.array([f"{i:02x}" for i in range(entries)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _batches(batches, parts):
            entry, distance = nearest(found, books)
            codes = pa.array(["".join(row) for row in digits[entry]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(distance.sum(1))], names=[id_col, label_col, "code", "error"])

    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"`{id_col}` {id_type}, `{label_col}` {label_type}, code string, error long"
    if not most:
        return spark.createDataFrame([], schema), books
    odd = rows.filter(F.size("v") != length).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    return usual.mapInArrow(code, schema).unionByName(odd), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: ``error`` summed over the rows of equal label, NULL labels together."""
    coded = stage(coded.withColumn("_label", F.to_json(F.struct(F.col(f"`{label_col}`").alias("l")))), "codes")
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup(coded, sums, "_label").drop("_label")


def digest(books: np.ndarray) -> Column:
    """SHA-256 of all components, by part, entry and place."""
    return F.lit(hashlib.sha256(text_of(books).encode()).hexdigest())
