"""Vector expressions and the block kernel of nearest-vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

PLACES = 6  # scores are compared after rounding
CHUNK = 4096


def norm(vec: Column) -> Column:
    squares = F.aggregate(
        vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def scaled(vec: Column, length: Column) -> Column:
    """The vector divided by its length; NULL when the length is 0."""
    return F.when(length > 0, F.transform(vec, lambda x: x.cast("double") / length))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def parts_of(vec: str, parts: int) -> Column:
    """The vector cut into ``parts`` pieces of equal length."""
    size = F.floor(F.size(vec) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vec, i * size + 1, size))


def best_in_block(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Kernel for ``cogroup().applyInPandas``: the k best items for each query of a block pair.

    Scores are rounded here, so that equal ones go to the lowest ids and no more than k go on,
    however many items tie. Works through the items in chunks of CHUNK.
    """

    def best(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> np.ndarray:
        order = np.lexsort((i, -s, q))
        q = q[order]
        first = np.searchsorted(q, q, side="left")
        return order[np.arange(len(q)) - first < k]

    def kernel(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or items.empty:
            return pd.DataFrame({"query_id": queries["query_id"].iloc[:0], "image_id": [], "score": []})
        left = np.vstack(queries["unit"].to_numpy()).astype(np.float64)
        ids = items["image_id"].to_numpy()
        units = items["unit"].to_numpy()
        floor = np.full(len(left), -np.inf)
        q, i, s = np.empty(0, np.int64), ids[:0], np.empty(0)
        for start in range(0, len(ids), CHUNK):
            right = np.vstack(units[start : start + CHUNK]).astype(np.float64)
            scores = np.round(left @ right.T, PLACES)
            new_q, new_i = np.nonzero(scores >= floor[:, None])
            q = np.concatenate([q, new_q])
            i = np.concatenate([i, ids[start + new_i]])
            s = np.concatenate([s, scores[new_q, new_i]])
            kept = best(q, i, s)
            q, i, s = q[kept], i[kept], s[kept]
            full = np.bincount(q, minlength=len(left)) == k
            lowest = np.full(len(left), np.inf)
            np.minimum.at(lowest, q, s)
            floor[full] = lowest[full]
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "image_id": i, "score": s})

    return kernel
