"""Exact k best inner products by dual-tree search over cover trees.

Vectors are dealt into blocks of near ones and each block becomes a cover tree: the points of level i are more than
BASE^i apart and have all points of the block within BASE^i, those of a level are also on the levels below, and the
parent of a point is one of the level above within BASE^(i+1). Each node knows the exact radius of the points
under it. Queries become trees in the same way. A pair of nodes is passed over when no
inner product between points of the two balls can reach the worst k-th score held by a query
of the group. The query set meets all rows in chunks of bounded size, each chunk against every
block, by a Spark join; no query comes to the driver.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from recollect.llm.common import about
from recollect.sources.tables import stage

PIVOTS = 64
SAMPLE = 2048  # rows from which the pivots and the first bounds are taken
BLOCK = 2048  # rows of a tree of data
CHUNK = 8192  # queries that meet the blocks at once
BASE = 1.3  # of the distances of levels
LEAF = 48  # points that are scored at once
EXACT = 2**53
NO_ID = np.iinfo(np.int64).max  # a NULL id comes after all others
NO_LEVEL = np.iinfo(np.int64).min


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(uid, id, vec): components floor(scale * x) of vectors without NULL or non-finite components."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(x.isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c * scale)).alias("vec"),
    )


def matrix(vectors, dim: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    dim = max([len(v) for v in vectors], default=0) if dim is None else dim
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where they hold every sum, else as 64-bit integers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (row numbers) picked farthest first until half the first radius is covered, and each row's nearest."""
    centres, nearest = [0], np.zeros(len(x), np.int64)
    dist = ((x - x[0]) ** 2).sum(1)
    half = dist.max(initial=0.0) / 4
    while len(centres) < most and dist.max() > half:
        c = int(dist.argmax())
        d = ((x - x[c]) ** 2).sum(1)
        closer = d < dist
        nearest[closer], dist[closer] = len(centres), d[closer]
        centres.append(c)
    return np.array(centres), nearest


def cover_levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, level, parent) of the points: the highest level of each, and its parent, which is on the next level.

    Points enter farthest first. One that is ``d`` away from all before it enters at the highest level with BASE^level < d,
    so that points of a level are apart, and once no point is further away than that the level covers all. The parent is the nearest point of the
    level above, or -1. Points that equal an earlier one have level NO_LEVEL and come last.
    """
    n = len(x)
    order, level, parent = np.zeros(n, np.int64), np.full(n, NO_LEVEL, np.int64), np.full(n, -1, np.int64)
    if not n:
        return order, level, parent
    near, owner = np.sqrt(((x - x[0]) ** 2).sum(1)), np.zeros(n, np.int64)
    above, now, entered = owner.copy(), None, np.zeros(n, bool)
    entered[0] = True
    for i in range(1, n):
        c = int(near.argmax())
        if near[c] == 0:
            rest = np.flatnonzero(~entered)
            order[i:], parent[rest] = rest, owner[rest]
            break
        here = math.ceil(math.log(near[c], BASE)) - 1
        while BASE**here >= near[c]:
            here -= 1
        while BASE ** (here + 1) < near[c]:
            here += 1
        if here != now:
            now, above = here, owner.copy()
        order[i], level[c], parent[c], entered[c] = c, here, above[c], True
        d = np.sqrt(((x - x[c]) ** 2).sum(1))
        closer = d < near
        near[closer], owner[closer] = d[closer], c
    level[0] = level[order[1]] + 1 if n > 1 and level[order[1]] != NO_LEVEL else 0
    return order, level, parent


def _under(p: int, mine: list[int], kids: list[list[int]]) -> list[int]:
    """``p`` and all points under its children ``mine``."""
    out, todo = [p], list(mine)
    while todo:
        c = todo.pop()
        out.append(c)
        todo += kids[c]
    return out


def _near_ones(x: np.ndarray, points: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Points dealt into groups of near ones that hold about LEAF points with those under them."""
    while len(points):
        near = np.argsort(((x[points] - x[points[0]]) ** 2).sum(1), kind="stable")
        take = max(int(np.searchsorted(np.cumsum(size[points[near]]), LEAF, side="right")), 1)
        yield points[near[:take]]
        points = points[np.sort(near[take:])]


class Tree:
    """Nodes as arrays: the range of points, the children, the centre point and the covering radius."""

    FIELDS = ("uid", "id", "vec", "start", "end", "child", "children", "centre", "radius")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.points = self.vec.astype(np.float64)
        self.length = np.sqrt((self.points[self.centre] ** 2).sum(1))

    @classmethod
    def build(cls, uid: np.ndarray, ids: np.ndarray, vec: np.ndarray) -> Tree:
        """The cover tree of the points. Nodes of LEAF points at most have no children.

        A level at which a point has no children but itself is left out. The children of a node that hold few points are scored
        together: near ones lie side by side and are one leaf.
        """
        points = vec.astype(np.float64)
        order, level, parent = cover_levels(points)
        kids: list[list[int]] = [[] for _ in range(len(vec))]
        size = np.ones(len(vec), np.int64)
        for c in order[1:]:
            kids[parent[c]].append(int(c))
        for c in order[:0:-1]:
            size[parent[c]] += size[c]
        # start, end, first child, number of children, centre, radius
        nodes: list[list[float]] = [[0, len(vec), 0, 0, 0, 0.0]]
        at = np.zeros(len(vec), np.int64)  # the point at each place
        if len(vec):
            at[0] = order[0]
        todo = [(0, 0)] if len(vec) else []  # node, how many children of its centre lie above
        while todo:
            me, above = todo.pop()
            start, end = int(nodes[me][0]), int(nodes[me][1])
            p = int(at[start])
            mine = kids[p][above:]
            if end - start <= LEAF or not mine or level[mine[0]] == NO_LEVEL:
                at[start:end] = _under(p, mine, kids)
                continue
            now = [c for c in mine if level[c] == level[mine[0]]]
            own = end - start - int(size[now].sum())
            place = start + own
            nodes[me][2] = len(nodes)
            todo.append((len(nodes), above + len(now)))
            nodes.append([start, place, 0, 0, start, 0.0])
            for c in now:
                if size[c] > LEAF // 2:
                    at[place] = c
                    todo.append((len(nodes), 0))
                    nodes.append([place, place + size[c], 0, 0, place, 0.0])
                    place += int(size[c])
            for together in _near_ones(points, np.array([c for c in now if size[c] <= LEAF // 2], np.int64), size):
                begin = place
                for c in together:
                    at[place : place + size[c]] = _under(int(c), kids[c], kids)
                    place += int(size[c])
                nodes.append([begin, place, 0, 0, begin, 0.0])
            nodes[me][3] = len(nodes) - nodes[me][2]
        for node in nodes:
            x = points[at[int(node[0]) : int(node[1])]]
            node[5] = float(np.sqrt(((x - x[:1]) ** 2).sum(1).max(initial=0.0)))
        n = np.array(nodes, np.float64).reshape(-1, 6)
        start, end, child, children, centre = (n[:, i].astype(np.int64) for i in range(5))
        return cls(uid=uid[at], id=ids[at], vec=vec[at], start=start, end=end, child=child, children=children, centre=centre, radius=n[:, 5])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**dict(arrays))


class Best:
    """The k best (score, id, uid) of each query so far. Order: score down, id up."""

    def __init__(self, uid: np.ndarray, k: int) -> None:
        self.uid, self.k = uid, k
        self.score = np.full((len(uid), k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((len(uid), k), NO_ID, np.int64)
        self.hit = np.full((len(uid), k), -1, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Scores (rows x candidates) of candidates that were not offered before."""
        for i, q in enumerate(rows):
            at = np.flatnonzero((scores[i] >= self.score[q, -1]) & (uids != self.uid[q]))
            if not len(at):
                continue
            s = np.concatenate([self.score[q], scores[i][at]])
            d = np.concatenate([self.id[q], ids[at]])
            h = np.concatenate([self.hit[q], uids[at]])
            best = np.lexsort((h < 0, d, -s.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < EXACT else -s))[: self.k]
            self.score[q], self.id[q], self.hit[q] = s[best], d[best], h[best]


def dual_search(queries: Tree, data: Tree, best: Best, floor: np.ndarray) -> None:
    """Offer to ``best`` (rows as in ``queries``) every point of ``data`` that can be among the k best.

    ``floor``: scores that k candidates of each query are known to reach.
    """
    if not len(data.id) or not len(queries.id):
        return

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        dim = min(queries.points.shape[1], data.points.shape[1])
        dots = data.points[data.centre[nodes], :dim] @ queries.points[queries.centre[q], :dim]
        r, s = queries.radius[q], data.radius[nodes]
        most = dots + queries.length[q] * s + data.length[nodes] * r + r * s
        return most * (1 + 1e-9 * np.sign(most)) + 1e-6

    def worst(q: int) -> float:
        a, b = queries.start[q], queries.end[q]
        return float(np.maximum(best.score[a:b, -1], floor[a:b]).min())

    root = np.zeros(1, np.int64)
    stack = [(0, 0, float(bounds(0, root)[0]))]
    while stack:
        q, d, most = stack.pop()
        if most < worst(q):
            continue
        if data.children[d] and (data.radius[d] >= queries.radius[q] or not queries.children[q]):
            nodes = np.arange(data.child[d], data.child[d] + data.children[d])
            upper = bounds(q, nodes)
            stack += [(q, int(nodes[i]), float(upper[i])) for i in np.argsort(upper)]  # the best comes last and is taken first
        elif queries.children[q]:
            for c in range(queries.child[q], queries.child[q] + queries.children[q]):
                stack.append((c, d, float(bounds(c, np.array([d]))[0])))
        else:
            rows = np.arange(queries.start[q], queries.end[q])
            a, b = data.start[d], data.end[d]
            scores = products(queries.vec[rows], data.vec[a:b])
            able = scores.max(axis=1) >= np.maximum(best.score[rows, -1], floor[rows])
            best.offer(rows[able], scores[able], data.id[a:b], data.uid[a:b])


def _trees(rows: DataFrame, pivots: np.ndarray, block: int, name: str) -> DataFrame:
    """One tree, as bytes, for each block of rows that are nearest to one pivot."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots.astype(np.float64) ** 2).sum(1) / 2
        for batch in batches:
            x = _fit(batch["vec"].to_list(), pivots.shape[1])
            yield batch.assign(pivot=(x.astype(np.float64) @ pivots.T.astype(np.float64) - half).argmax(1))

    placed = stage(rows.mapInPandas(nearest, "uid long, id long, vec array<bigint>, pivot long"), name)
    parts = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # at most PIVOTS rows
    dealt = placed.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        tree = Tree.build(group["uid"].to_numpy(np.int64), ids, matrix(group["vec"].to_list()))
        return pd.DataFrame({"n": [len(group)], "tree": [tree.dump()]})

    return stage(dealt.groupBy("pivot", "part").applyInPandas(build, "n long, tree binary"), f"{name}-trees")


def _fit(vectors, dim: int) -> np.ndarray:
    """Rows of exactly ``dim`` components, for finding the nearest pivot only."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(dim, len(v))] = v[:dim]
    return out


def top_inner_products(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query; all, if there are fewer.

    ``is_query``: a condition on the column ``id``. Candidates are all rows but the query's own;
    a repeated row is a candidate for its twin, and repeated queries are answered one by one.
    Ties go to the smaller id, a NULL id last. Vectors that are NULL or hold NULL or non-finite
    components take no part; shorter vectors count as filled up with zeros. Scores must fit 64
    bits. No queries or no candidates give no rows.
    """
    rows = stage(integers(vectors, id_col, vec_col, scale), "vectors")
    low = rows.withColumn("at", F.xxhash64("uid")).filter(about(F.xxhash64("uid"), SAMPLE, rows.count()))
    sample = low.orderBy("at").limit(SAMPLE).collect()  # fits the pivots; the search covers all rows
    seen = matrix([r["vec"] for r in sample])
    seen_uid = np.array([r["uid"] for r in sample], np.int64)
    pivots = seen[farthest_first(seen.astype(np.float64), PIVOTS)[0]] if len(seen) else np.zeros((1, 1), np.int64)
    data = _trees(rows, pivots, block, "data")
    asked = _trees(rows.filter(is_query), pivots, 512, "queries")
    n = max(math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / chunk), 1)
    dealt = asked.groupBy(F.pmod(F.xxhash64("tree"), F.lit(n)).cast("int").alias("chunk"))
    chunks = stage(dealt.agg(F.collect_list("tree").alias("trees")), "query-chunks")
    found = _search(data, chunks, n, seen, seen_uid, k)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search(data: DataFrame, chunks: DataFrame, n: int, seen: np.ndarray, seen_uid: np.ndarray, k: int) -> DataFrame:
    """The k best of each partition for every chunk (chunk, trees) of queries.

    Each tree of data meets each of the ``n`` chunks by a join on the chunk's number. A task goes through the pairs
    chunk by chunk and holds the trees and the k best of one chunk.
    """
    sent = data.sparkSession.sparkContext.broadcast((seen, seen_uid))  # SAMPLE rows
    wide = max(data.sparkSession.sparkContext.defaultParallelism, 1)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long")))
    dealt = data.select("tree", numbers.alias("chunk")).withColumn("lane", F.pmod(F.xxhash64("tree"), F.lit(wide)))
    # In a lane the chunk comes first, then the trees of data that it meets.
    rows = dealt.select("lane", "chunk", F.lit(1).alias("kind"), F.array("tree").alias("trees"))
    rows = rows.unionByName(chunks.select(lanes.alias("lane"), "chunk", F.lit(0).alias("kind"), "trees"))
    rows = rows.repartition(wide, "lane").sortWithinPartitions("lane", "chunk", "kind")

    def opened(packed) -> list:
        groups = []
        sample, sample_uid = sent.value
        for q in map(Tree.load, packed):
            scores = products(q.vec, sample)
            scores[q.uid[:, None] == sample_uid] = np.iinfo(np.int64).min
            floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q.uid), np.iinfo(np.int64).min)
            groups.append((q, Best(q.uid, k), floor))
        return groups

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, of = [], None
        for batch in batches:
            for here, kind, trees in zip(zip(batch["lane"], batch["chunk"]), batch["kind"], batch["trees"]):
                if kind == 0:
                    yield from closed(groups)
                    groups, of = opened(trees), here
                elif here == of:  # a chunk can be without queries
                    d = Tree.load(trees[0])
                    for q, best, floor in groups:
                        dual_search(q, d, best, floor)
        yield from closed(groups)

    def closed(groups: list) -> Iterator[pd.DataFrame]:
        for q, best, floor in groups:
            i, j = np.nonzero((best.hit >= 0) & (best.score >= floor[:, None]))
            if not len(i):
                continue
            vec_id = pd.array(best.id[i, j], "Int64")
            vec_id[best.id[i, j] == NO_ID] = pd.NA
            yield pd.DataFrame(
                {"query_uid": q.uid[i], "query_id": q.id[i], "vec_id": vec_id, "score": best.score[i, j], "uid": best.hit[i, j]}
            )

    return rows.mapInPandas(run, "query_uid long, query_id long, vec_id long, score long, uid long")
