"""Scores of a block of queries against a shelf of items, as dense matrices in one task.

Everything a query and an item can share adds up: a term adds the item's weight times the query's
factor, a clue its share, a vector a product. Rows bring entries of a shelf (``held``) and of blocks of queries (``asked``), in
pieces; those of equal ``kind`` and ``key`` belong together. A task gets its queries once, and then shelf after shelf, so that
no row is larger than an entry and only one shelf is in memory. The scores of a block on a shelf fill one matrix
for each signal, bounded by the sizes of block and shelf. A task keeps the best of each query, or counts, over all
its shelves, and only they go on.

kind     held: entries of a shelf                                asked: entries of a block of queries
IDS      ``ids`` of its items, ascending; others name them by place
TERM     items ``at`` with weights ``v1`` (text), ``v2`` (wording)   queries ``qn`` with factors ``f1`` and ``f2``
VECTORS  items ``at`` with unit vectors ``v1``, one after the other  queries ``qn`` with unit vectors ``f1``
FIELDS   items ``at`` of a metadata profile                          queries ``qn`` of metadata score ``f1``
CLUE     items ``at`` that have a clue                               it makes up ``f1`` of the clues of queries ``qn``
CHAIN                                                                queries ``qn``, in order; one with the same number in ``f1`` as the one before has all that one's terms too
GOAL                                                                 queries ``qn`` with their target's id ``ids`` and its final scores ``f1``, one for each weighting
WEAK     (meets TERM)                                            queries ``qn`` with factors ``f1`` of terms that count only where an item can still be among the best
LIMIT                                                                queries ``qn`` with a score ``f1`` that k items reach and the most ``f2`` that weak terms can add
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IDS, TERM, VECTORS, FIELDS, CLUE, CHAIN, GOAL, WEAK, LIMIT = range(9)
TOP = "qb long, qn int, image_id long, score double"
PLACES = 6
# Terms of fewer pairs than this are added pair by pair, others by matrix products.
DENSE, AT_ONCE = 2048, 256
# Pairs that are added one by one at a time.
LIGHT_AT_ONCE = 250_000
# Rows beyond k that go on, so that a last digit rounded otherwise elsewhere loses no item.
SPARE = 8
SIGNALS = ("text", "semantic", "visual", "metadata", "clue")


class _Lists:
    """A column of lists as values and offsets."""

    def __init__(self, table: pa.Table | pa.StructArray, name: str) -> None:
        column = table.field(name) if isinstance(table, pa.StructArray) else table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        sizes = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
        self.sizes = sizes
        self.first = np.cumsum(sizes) - sizes
        self.values = column.flatten().to_numpy(zero_copy_only=False)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i] + self.sizes[i]]

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the values of lists ``rows`` stand."""
        return _spread(self.first[rows], self.sizes[rows], np.ones(len(rows), np.int64))

    def only(self, places: np.ndarray) -> _Lists:
        """The same lists with the values at ``places`` only."""
        kept = np.zeros(len(self.values), bool)
        kept[places] = True
        before = np.concatenate([[0], np.cumsum(kept)])
        made = object.__new__(_Lists)
        made.first, made.values = before[self.first], self.values[kept]
        made.sizes = before[self.first + self.sizes] - made.first
        return made


def _spread(first: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Places of each list (first, size), ``times`` over for each of them in turn: 0 1 0 1 for size 2, times 2."""
    lengths = np.repeat(sizes, times)
    starts = np.repeat(first, times)
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(before - starts, lengths)


def _add_products(out: np.ndarray, held: np.ndarray, asked: np.ndarray, at: _Lists, value: _Lists, qn: _Lists, factor: _Lists) -> None:
    """out[q, i] += factor * value for every query and item of each pair of a ``held`` and an ``asked`` entry."""
    work = at.sizes[held] * qn.sizes[asked]
    heavy, light = work >= DENSE, (work > 0) & (work < DENSE)
    queries, items = out.shape
    h, a = held[heavy], asked[heavy]
    for start in range(0, len(h), AT_ONCE):
        some = range(start, min(start + AT_ONCE, len(h)))
        left, right = np.zeros((len(some), queries)), np.zeros((len(some), items))
        for n, r in enumerate(some):
            left[n, qn.of(a[r])] = factor.of(a[r])
            right[n, at.of(h[r])] = value.of(h[r])
        out += left.T @ right
    h, a = held[light], asked[light]
    # In pieces of bounded size: each query of an entry meets all the entry's items.
    ends = np.cumsum(work[light])
    piece = (ends - 1) // LIGHT_AT_ONCE if len(ends) else ends
    for start, stop in zip(*_runs(piece)):
        hs, qs = h[start:stop], a[start:stop]
        q = _spread(qn.first[qs], qn.sizes[qs], np.ones(len(qs), np.int64))
        whose = np.repeat(hs, qn.sizes[qs])
        i = _spread(at.first[whose], at.sizes[whose], np.ones(len(whose), np.int64))
        # Entries of other kinds have lists in one column and none in another: each column has its own offsets.
        f = np.repeat(q + np.repeat(factor.first[qs] - qn.first[qs], qn.sizes[qs]), at.sizes[whose])
        v = i + np.repeat(value.first[whose] - at.first[whose], at.sizes[whose])
        flat = qn.values[np.repeat(q, at.sizes[whose])].astype(np.int64) * items + at.values[i]
        out += np.bincount(flat, factor.values[f] * value.values[v], minlength=out.size).reshape(out.shape)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of equal keys."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


class _Side:
    """The entries of a shelf, or of some blocks of queries."""

    def __init__(self, entries: pa.StructArray, names: Sequence[str]) -> None:
        self.kind = entries.field("kind").to_numpy(zero_copy_only=False)
        self.key = entries.field("key")
        self.lists = {n: _Lists(entries, n) for n in names}

    def rows(self, kind: int) -> np.ndarray:
        return np.flatnonzero(self.kind == kind)


class _Asked(_Side):
    """Blocks of queries; ``where`` has the entries of each block, ``queries`` how many queries it has."""

    def __init__(self, entries: pa.StructArray) -> None:
        super().__init__(entries, ("qn", "f1", "f2", "ids"))
        qb = entries.field("qb").to_numpy(zero_copy_only=False)
        order = np.argsort(qb, kind="stable")
        self.where = {int(qb[order[a]]): order[a:b] for a, b in zip(*_runs(qb[order]))}
        qn = self.lists["qn"]
        most, some = np.full(len(qb), -1), np.flatnonzero(qn.sizes)
        if len(some):
            most[some] = np.maximum.reduceat(qn.values, qn.first[some])
        self.queries = {b: int(most[rows].max(initial=-1)) + 1 for b, rows in self.where.items()}


class Board:
    """The scores of one block of queries on one shelf. ``meets`` has for each entry of the block that of the shelf, or -1."""

    def __init__(self, held: _Side, asked: _Asked, qb: int, meets: np.ndarray) -> None:
        self.qb, self.mine, self.meets = qb, asked.where[qb], meets
        self.kind = asked.kind[self.mine]
        self.held, self.asked = held, asked
        ids = held.rows(IDS)
        self.ids = held.lists["ids"].of(ids[0]) if len(ids) else np.empty(0, np.int64)
        self.queries = asked.queries[qb]

    def blank(self) -> np.ndarray:
        return np.zeros((self.queries, len(self.ids)))

    def rows(self, kind: int) -> np.ndarray:
        return self.mine[self.kind == kind]

    def pairs(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(held, asked): entries that meet."""
        asked = self.rows(kind)
        held = self.meets[asked]
        return held[held >= 0], asked[held >= 0]

    def terms(self, v: str, f: str) -> np.ndarray:
        out, h, a = self.blank(), self.held.lists, self.asked.lists
        _add_products(out, *self.pairs(TERM), h["at"], h[v], a["qn"], a[f])
        for r in self.rows(CHAIN):
            chain = a["f1"].of(r)
            order = a["qn"].of(r)
            for n in range(1, len(order)):
                if chain[n] == chain[n - 1]:
                    out[order[n]] += out[order[n - 1]]
        return out

    def weak_terms(self, v: str, wanted: np.ndarray) -> np.ndarray:
        """Sums over weak terms, for the queries that ``wanted`` marks."""
        out, h, a = self.blank(), self.held.lists, self.asked.lists
        rows = self.rows(WEAK)
        kept = wanted[a["qn"].values[a["qn"].places(rows)].astype(np.int64)]
        qn, factor = (a[n].only(a[n].places(rows)[kept]) for n in ("qn", "f1"))
        _add_products(out, *self.pairs(WEAK), h["at"], h[v], qn, factor)
        return out

    def visual(self) -> np.ndarray:
        out, h, a = self.blank(), self.held.lists, self.asked.lists
        for v in self.held.rows(VECTORS):
            at = h["at"].of(v)
            units = h["v1"].of(v).reshape(len(at), -1)
            for r in self.rows(VECTORS):
                qn = a["qn"].of(r)
                out[np.ix_(qn, at)] = a["f1"].of(r).reshape(len(qn), -1) @ units.T
        return out

    def shares(self, kind: int) -> np.ndarray:
        out, h, a = self.blank(), self.held.lists, self.asked.lists
        for s, r in zip(*self.pairs(kind)):
            out[np.ix_(a["qn"].of(r), h["at"].of(s))] += a["f1"].of(r)[:, None]
        return out

    def signals(self, names: Sequence[str]) -> Iterator[np.ndarray]:
        """Rounded signals, one after the other, cosines cut to [0, 1]; 0 where one is not available."""
        made = {
            "text": lambda: self.terms("v1", "f1"),
            "semantic": lambda: self.terms("v2", "f2"),
            "visual": self.visual,
            "metadata": lambda: self.shares(FIELDS),
            "clue": lambda: self.shares(CLUE),
        }
        for n in names:
            signal = made[n]()
            if n in ("semantic", "visual"):
                np.clip(signal, 0, 1, out=signal)
            yield np.round(signal, PLACES, out=signal)


def _boards(batches: Iterator[pa.RecordBatch]) -> Iterator[Board]:
    """A board for every block of queries and shelf of rows (shelf, held, chunk, asked).

    ``held`` is a piece of a shelf and ``asked`` one of the queries, as lists or packed; either may be NULL. The pieces of a shelf
    are neighbours; those of the queries come before the first shelf ends. A piece of the queries, numbered by ``chunk``, that
    comes again is passed over.
    """
    sides, of = None, None
    for shelf, asked in _gathered(batches):
        if asked is not of:
            sides, of = _Asked(asked), asked
        yield from _meet(_Side(shelf, ("ids", "at", "v1", "v2")), sides)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    """Every shelf with all queries, the same object as long as no more came."""
    shelves, pieces, taken = _Shelves(), [], set()

    def met(ended: Iterator[tuple[int, pa.StructArray]]) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
        for _, shelf in ended:
            if len(pieces) > 1:
                pieces[:] = [pa.concat_arrays(pieces)]
            if pieces:
                yield shelf, pieces[0]

    for batch in batches:
        pieces += _not_taken(batch.column("asked"), batch.column("chunk"), taken)
        yield from met(shelves.add(batch))
    yield from met(shelves.rest())


def _not_taken(asked: pa.Array, chunk: pa.Array, taken: set[int]) -> list[pa.StructArray]:
    """The pieces of queries whose numbers were not ``taken`` yet."""
    rows = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return []
    chunks, first = np.unique(chunk.take(pa.array(rows)).to_numpy(zero_copy_only=False), return_index=True)
    rows = rows[first[[c not in taken for c in chunks.tolist()]]]
    taken.update(chunks.tolist())
    return _unpacked(asked, rows)


class _Shelves:
    """Shelves from the pieces of rows (shelf, held), those of a shelf are neighbours."""

    def __init__(self) -> None:
        self.number, self.parts, self.ended = None, [], set()

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
        """Numbers and entries of the shelves that ended."""
        held = batch.column("held")
        rows = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        shelves = batch.column("shelf").to_numpy()[rows] if "shelf" in batch.schema.names else np.zeros(len(rows), np.int64)
        for start, stop in zip(*_runs(shelves)):
            if self.number != shelves[start]:
                yield from self.rest()
            self.number = int(shelves[start])
            if self.number in self.ended:
                raise ValueError(f"the pieces of shelf {self.number} are not neighbours")
            self.parts += _unpacked(held, rows[start:stop])

    def rest(self) -> Iterator[tuple[int, pa.StructArray]]:
        if self.parts:
            entries, self.parts = pa.concat_arrays(self.parts), []
            self.ended.add(self.number)
            yield self.number, entries


def _packed(entries: pa.StructArray) -> bytes:
    """Entries as bytes, since lists of numbers take long from row to row between Spark and here."""
    batch, sink = pa.RecordBatch.from_struct_array(entries), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(column: pa.Array, rows: np.ndarray) -> list[pa.StructArray]:
    """Entries of some rows of a column of lists, or of packed lists."""
    some = column.take(pa.array(rows))
    if not pa.types.is_binary(column.type):
        return [some.flatten()]
    return [part.to_struct_array() for row in some for part in pa.ipc.open_stream(row.as_buffer())]


PACKED_SHELF = "shelf long, held binary"
PACKED_QUERIES = "turn long, asked binary"


def packed_shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row PACKED_SHELF for each shelf of rows (shelf, held)."""
    shelves = _Shelves()

    def row(number: int, entries: pa.StructArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_packed(entries)], pa.binary())], names=["shelf", "held"])

    for batch in batches:
        for shelf in shelves.add(batch):
            yield row(*shelf)
    for shelf in shelves.rest():
        yield row(*shelf)


def packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows PACKED_QUERIES of rows (turn, asked), with one entry each."""
    for batch in batches:
        turn, asked = batch.column("turn").to_numpy(), batch.column("asked")
        order = np.argsort(turn, kind="stable")
        for start, stop in zip(*_runs(turn[order])):
            packed = _packed(asked.take(pa.array(order[start:stop])))
            yield pa.RecordBatch.from_arrays([pa.array([turn[order[start]]], pa.int64()), pa.array([packed], pa.binary())], names=["turn", "asked"])


def _meet(held: _Side, asked: _Asked) -> Iterator[Board]:
    """The boards of one shelf."""
    meets = np.full(len(asked.kind), -1)
    for kind, other in ((TERM, TERM), (WEAK, TERM), (FIELDS, FIELDS), (CLUE, CLUE)):
        h, a = held.rows(other), asked.rows(kind)
        if len(h) and len(a):
            found = pc.fill_null(pc.index_in(asked.key.take(pa.array(a)), value_set=held.key.take(pa.array(h))), -1)
            found = found.to_numpy(zero_copy_only=False)
            meets[a] = np.where(found >= 0, h[found], -1)
    for qb in asked.where:
        if asked.queries[qb]:
            yield Board(held, asked, qb, meets)


def _best(scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) of the k best of each query, equal scores in the order of the items."""
    held = np.where(found, scores, -np.inf)
    k = min(k, held.shape[1])
    order = np.argsort(-held, axis=1, kind="stable")[:, :k]
    q = np.repeat(np.arange(len(held)), k)
    i = order.ravel()
    kept = found[q, i]
    return q[kept], i[kept]


class _Kept:
    """The k best items so far of each query of a block, equal scores by the lowest ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        n, floor = len(ids), self.floor
        if n > self.k and np.isinf(floor).any():
            kth = np.partition(np.where(found, scores, -np.inf), n - self.k, axis=1)[:, n - self.k]
            floor = np.maximum(floor, kth)
        q, i = np.nonzero(found & (scores >= floor[:, None]))
        q, ids, scores = np.concatenate([self.q, q]), np.concatenate([self.ids, ids[i]]), np.concatenate([self.scores, scores[q, i]])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = place < self.k
        self.q, self.ids, self.scores = q[kept], ids[kept], scores[kept]
        last = place[kept] == self.k - 1
        self.floor[self.q[last]] = self.scores[last]


def _best_of_all(k: int, score: Callable[[Board], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each query on all shelves of a task; ``score`` gives (scores, which of them count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Kept] = {}
        for board in _boards(batches):
            kept.setdefault(board.qb, _Kept(board.queries, k)).add(board.ids, *score(board))
        for qb, best in kept.items():
            columns = [pa.array(np.full(len(best.q), qb, np.int64)), pa.array(best.q.astype(np.int32)), pa.array(best.ids), pa.array(best.scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["qb", "qn", "image_id", "score"])

    return run


def best_by_sum(k: int, v: str, f: str, places: int = PLACES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best by one sum over shared terms, rounded to ``places``; only items that share a term."""

    def score(board: Board) -> tuple[np.ndarray, np.ndarray]:
        raw = board.terms(v, f)
        return np.round(raw, places), raw > 0

    return _best_of_all(k, score)


def best_above(k: int, v: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same k best as by all terms: weak ones are added only for queries with an item on the shelf that can reach the limit with them."""

    def score(board: Board) -> tuple[np.ndarray, np.ndarray]:
        a = board.asked.lists
        floor, rest = np.full(board.queries, -np.inf), np.zeros(board.queries)
        for r in board.rows(LIMIT):
            floor[a["qn"].of(r)], rest[a["qn"].of(r)] = a["f1"].of(r), a["f2"].of(r)
        raw = board.terms(v, "f1")
        found = (raw > 0) & (raw + rest[:, None] >= floor[:, None])
        wanted = found.any(1) & (rest > 0)
        if wanted.any():
            raw += board.weak_terms(v, wanted)
        return np.round(raw, PLACES), found

    return _best_of_all(k, score)


def best_by_vectors(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best products of each query with the vectors of all shelves of a task, rounded; shelves hold items with a vector only."""

    def score(board: Board) -> tuple[np.ndarray, np.ndarray]:
        made = np.round(board.visual(), PLACES)
        return made, np.ones(made.shape, bool)

    return _best_of_all(k, score)


def best_by_final(k: int, weights: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best, and SPARE more, by the weighted sum of all signals; only items with a signal above 0."""

    def score(board: Board) -> tuple[np.ndarray, np.ndarray]:
        final, found = board.blank(), np.zeros((board.queries, len(board.ids)), bool)
        for signal, w in zip(board.signals(SIGNALS), weights):
            found |= signal > 0
            signal *= w
            final += signal
        return np.round(final, PLACES, out=final), found

    return _best_of_all(k + SPARE, score)


AHEAD = "qb long, qn int, setting int, ahead long"


def count_ahead(grid: Sequence[Sequence[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every weighting, how many items of a task's shelves come before each query's target."""

    def count(board: Board, ahead: np.ndarray, asked: np.ndarray) -> None:
        goals = board.rows(GOAL)
        signals = list(board.signals(SIGNALS)) if len(goals) else []
        for r in goals:
            a = board.asked.lists
            qn, goal = a["qn"].of(r), a["ids"].of(r)
            own = a["f1"].of(r).reshape(len(qn), len(grid))
            found = np.logical_or.reduce([s[qn] > 0 for s in signals])
            earlier = board.ids[None, :] < goal[:, None]
            asked[qn] = True
            for setting, weights in enumerate(grid):
                final = np.zeros((len(qn), len(board.ids)))
                for signal, w in zip(signals, weights):
                    if w:
                        final += w * signal[qn]
                final = np.round(final, PLACES)
                mine = np.round(own[:, setting], PLACES)[:, None]
                np.add.at(ahead[:, setting], qn, (found & ((final > mine) | ((final == mine) & earlier))).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for board in _boards(batches):
            if board.qb not in sums:
                sums[board.qb] = np.zeros((board.queries, len(grid)), np.int64), np.zeros(board.queries, bool)
            count(board, *sums[board.qb])
        for qb, (ahead, asked) in sums.items():
            qn = np.flatnonzero(asked)
            q, setting = np.repeat(qn, len(grid)), np.tile(np.arange(len(grid)), len(qn))
            columns = [pa.array(np.full(len(q), qb, np.int64)), pa.array(q.astype(np.int32)), pa.array(setting.astype(np.int32)), pa.array(ahead[q, setting])]
            yield pa.RecordBatch.from_arrays(columns, names=["qb", "qn", "setting", "ahead"])

    return run


TOPIC = "qb long, qn int, term string, weight double"


class _Found:
    """Which queries ``qn`` of a block found the item ``at`` of a shelf."""

    def __init__(self, entries: pa.StructArray) -> None:
        shelf, at = (entries.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shelf", "at"))
        self.qn = _Lists(entries, "qn")
        self.queries = int(self.qn.values.max(initial=-1)) + 1
        self.shelves, number = np.unique(shelf, return_inverse=True)
        self.width = int(at.max(initial=-1)) + 1
        code = number * self.width + at
        self.order = np.argsort(code)
        self.codes = code[self.order]

    def rows(self, shelf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The entry of each item, or -1."""
        if not len(self.codes):
            return np.full(len(at), -1)
        number = np.minimum(np.searchsorted(self.shelves, shelf), len(self.shelves) - 1)
        code = np.where((self.shelves[number] == shelf) & (at < self.width), number * self.width + at, -1)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[place] == code, self.order[place], -1)

    def sums(self, held: pa.StructArray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, term, query, weight): what the items of each query weigh in each term, some terms at a time, in their order."""
        order = pc.sort_indices(held.field("term")).to_numpy()
        terms = held.field("term").take(pa.array(order))
        run = pc.run_end_encode(terms)
        ends = run.run_ends.to_numpy()
        term_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at, ltf = _Lists(held, "at"), _Lists(held, "ltf")
        sizes = at.sizes[order]
        shelf, idf = (np.repeat(held.field(n).to_numpy(zero_copy_only=False)[order], sizes) for n in ("shelf", "idf"))
        item = self.rows(shelf, at.values[at.places(order)].astype(np.int64))
        met = item >= 0
        term, item = np.repeat(term_of, sizes)[met], item[met]
        weight = (ltf.values[ltf.places(order)] * idf)[met]
        times = self.qn.sizes[item]
        # In pieces of bounded size, of whole terms.
        starts, stops = _runs(term)
        done = np.cumsum(times)
        piece = np.repeat((done[stops - 1] - 1) // LIGHT_AT_ONCE if len(stops) else stops, stops - starts)
        for start, stop in zip(*_runs(piece)):
            each = times[start:stop]
            q = self.qn.values[_spread(self.qn.first[item[start:stop]], each, np.ones(stop - start, np.int64))]
            key, place = np.unique(np.repeat(term[start:stop], each) * self.queries + q, return_inverse=True)
            yield run.values, key // self.queries, key % self.queries, np.bincount(place, np.repeat(weight[start:stop], each))


class _KeptTerms:
    """The k heaviest terms so far of each query of a block, by rounded weights, equal ones in the order of the terms."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.kept, self.more, self.waiting = None, [], 0

    def add(self, terms: pa.Array, term: np.ndarray, q: np.ndarray, weight: np.ndarray) -> None:
        rounded = np.round(weight, PLACES)
        some = np.flatnonzero(rounded >= self.floor[q])
        some = some[np.lexsort((term[some], -rounded[some], q[some]))]
        some = some[_place(q[some]) < self.k]
        self.more.append(pa.table({"q": q[some], "rounded": rounded[some], "term": terms.take(pa.array(term[some])), "weight": weight[some]}))
        self.waiting += len(some)
        if self.waiting > max(LIGHT_AT_ONCE, self.kept.num_rows if self.kept else 0):
            self.settle()

    def settle(self) -> None:
        rows = pa.concat_tables([*([self.kept] if self.kept else []), *self.more])
        rows = rows.sort_by([("q", "ascending"), ("rounded", "descending"), ("term", "ascending")])
        place = _place(rows.column("q").to_numpy())
        self.kept, self.more, self.waiting = rows.filter(pa.array(place < self.k)).combine_chunks(), [], 0
        last = rows.filter(pa.array(place == self.k - 1))
        self.floor[last.column("q").to_numpy()] = last.column("rounded").to_numpy()


def _place(keys: np.ndarray) -> np.ndarray:
    """The place of each row among those of its key; equal keys are neighbours."""
    return np.arange(len(keys)) - np.searchsorted(keys, keys, side="left")


def heaviest_terms(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k heaviest terms, and SPARE more, of what each query of a block found, of all rows (held, qb, asked) of a task.

    ``held`` has all postings of some terms as entries (term, idf, shelf, at, ltf), ``asked`` what the queries found as
    entries (shelf, at, qn), as lists or packed; either may be NULL. What a block found comes first, in pieces with numbers ``chunk`` or as a whole. Without
    ``qb`` postings are for all blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[pa.StructArray]] = {}
        taken: dict[int, set[int]] = {}
        seen: dict[int, tuple[_Found, _KeptTerms]] = {}
        for batch in batches:
            asked, chunk = batch.column("asked"), batch.column("chunk" if "chunk" in batch.schema.names else "qb")
            blocks = batch.column("qb").to_numpy(zero_copy_only=False)
            mine = asked.is_valid().to_numpy(zero_copy_only=False)
            for qb in np.unique(blocks[mine]).astype(np.int64).tolist():
                rows = pa.array(np.flatnonzero(mine & (blocks == qb)))
                pieces.setdefault(qb, []).extend(_not_taken(asked.take(rows), chunk.take(rows), taken.setdefault(qb, set())))
            held = batch.column("held")
            for i in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)):
                for entries in _unpacked(held, np.array([i])):
                    for qb in pieces if np.isnan(blocks[i]) else [int(blocks[i])]:
                        if qb not in seen:
                            found = _Found(pa.concat_arrays(pieces[qb]))
                            seen[qb] = found, _KeptTerms(found.queries, k + SPARE)
                        found, kept = seen[qb]
                        for some in found.sums(entries):
                            kept.add(*some)
        for qb, (_, kept) in seen.items():
            if kept.more:
                kept.settle()
            if kept.kept is None:
                continue
            for rows in kept.kept.to_batches():
                columns = [pa.array(np.full(rows.num_rows, qb, np.int64)), rows.column("q").cast(pa.int32()), rows.column("term"), rows.column("weight")]
                yield pa.RecordBatch.from_arrays(columns, names=["qb", "qn", "term", "weight"])

    return run


PHRASE_HIT = "qb long, qn int, image_id long"
# A place is the item's number on the shelf, and the position of a token in the low bits.
POSITION_BITS = 32


class _Phrases:
    """Blocks of phrases, from entries (qb, term, qn, off, size): a term is wanted in phrases ``qn``, ``off`` words after their
    first; those without a term say of how many words phrases ``qn`` are."""

    def __init__(self, entries: pa.StructArray) -> None:
        self.term = entries.field("term")
        lists = {n: _Lists(entries, n) for n in ("qn", "off", "size")}
        qb = entries.field("qb").to_numpy(zero_copy_only=False)
        words, sized = (np.flatnonzero(lists[n].sizes) for n in ("off", "size"))
        self.blocks = []
        for b in np.unique(qb).tolist():
            w, z = words[qb[words] == b], sized[qb[sized] == b]
            each = {n: lists[n].values[lists[n].places(w)].astype(np.int64) for n in ("qn", "off")}
            need = np.zeros(int(lists["qn"].values.max(initial=-1)) + 1, np.int64)
            need[lists["qn"].values[lists["qn"].places(z)]] = lists["size"].values[lists["size"].places(z)]
            self.blocks.append((b, np.repeat(w, lists["qn"].sizes[w]), each["qn"], each["off"], need))

    def hits(self, shelf: pa.StructArray) -> Iterator[pa.RecordBatch]:
        """Items of a shelf, from entries (ids, term, place), that hold the phrases. A phrase is where all its terms stand, each
        so many words further on; the rarest term is looked at first."""
        ids, place = _Lists(shelf, "ids"), _Lists(shelf, "place")
        held = np.flatnonzero(place.sizes)
        if not len(held):
            return
        found = pc.fill_null(pc.index_in(self.term, value_set=shelf.field("term").take(pa.array(held))), -1).to_numpy(zero_copy_only=False)
        row = np.where(found >= 0, held[found], -1)
        for b, entry, qn, off, need in self.blocks:
            whose = row[entry]
            some = np.flatnonzero(whose >= 0)
            some = some[np.lexsort((place.sizes[whose[some]], qn[some]))]
            yield from _phrases_on(ids.values, place, b, qn[some], off[some], whose[some], need)


def _phrases_on(ids: np.ndarray, place: _Lists, qb: int, qn: np.ndarray, off: np.ndarray, whose: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
    phrase, first, count = np.unique(qn, return_index=True, return_counts=True)
    whole = count == need[phrase]
    out_q, out_i = [], []
    for p, a, n in zip(phrase[whole].tolist(), first[whole].tolist(), count[whole].tolist()):
        start = place.of(whose[a]) - off[a]
        for r, o in zip(whose[a + 1 : a + n], off[a + 1 : a + n]):
            held = place.of(r)
            at = np.minimum(np.searchsorted(held, start + o), len(held) - 1)
            start = start[held[at] == start + o]
            if not len(start):
                break
        items = np.unique(start >> POSITION_BITS)
        out_q.append(np.full(len(items), p))
        out_i.append(items)
    if out_q:
        q, i = np.concatenate(out_q), np.concatenate(out_i)
        columns = [pa.array(np.full(len(q), qb, np.int64)), pa.array(q.astype(np.int32)), pa.array(ids[i])]
        yield pa.RecordBatch.from_arrays(columns, names=["qb", "qn", "image_id"])


def phrase_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PHRASE_HIT of rows (shelf, held, chunk, asked) that come as those of ``_boards``."""
    phrases, of = None, None
    for shelf, asked in _gathered(batches):
        if asked is not of:
            phrases, of = _Phrases(asked), asked
        yield from phrases.hits(shelf)


# Pairs of blocks: a row holds a block of items and a block of queries, each as one list of numbers.


def _matrix(batch: pa.RecordBatch, name: str, i: int, rows: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pair_rows(batch: pa.RecordBatch, i: int, scores: np.ndarray, k: int) -> pa.RecordBatch:
    queries, ids = batch.column("queries")[i].values, batch.column("ids")[i].values
    q, at = _best(scores, np.ones(scores.shape, bool), k)
    columns = [queries.take(pa.array(q)), ids.take(pa.array(at)), pa.array(scores[q, at])]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "image_id", "score"])


def fitted_book(entries: int, rounds: int = 12) -> Callable[[pa.Table], pa.Table]:
    """A codebook for the pieces ``x`` of one part: k-means from pieces evenly apart in the order of ``key``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = np.vstack(table.column("x").to_pylist()).astype(np.float64)
        book = x[np.linspace(0, len(x) - 1, min(entries, len(x))).astype(int)].copy()
        for _ in range(rounds):
            nearest = (book**2).sum(1) - 2 * x @ book.T
            entry = nearest.argmin(1)
            count = np.bincount(entry, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, entry, x)
            used = count > 0
            book[used] = sums[used] / count[used, None]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _books(batch: pa.RecordBatch, i: int, width: int) -> np.ndarray:
    """(parts, entries, width of a part): the codebooks of vectors of a width."""
    lists = batch.column("books")[i].values
    parts = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(parts, -1, width // parts)


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of blocks (ids, units, books)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids").slice(i, 1)
            units = _matrix(batch, "units", i, len(batch.column("ids")[i]))
            books = _books(batch, i, units.shape[1])
            cut = units.reshape(len(units), len(books), -1)
            codes = np.stack([((b**2).sum(1) - 2 * cut[:, p] @ b.T).argmin(1) for p, b in enumerate(books)], axis=1)
            data = pa.array([codes.astype(np.uint8).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, data], names=["ids", "codes"])


def best_codes(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each query of a pair of blocks (ids, codes, books, queries, asked), by the products with the entries coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = _matrix(batch, "asked", i, len(batch.column("queries")[i]))
                books = _books(batch, i, asked.shape[1])
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(-1, len(books))
                cut = asked.reshape(len(asked), len(books), -1)
                scores = np.zeros((len(asked), len(codes)))
                for p, book in enumerate(books):
                    scores += (cut[:, p] @ book.T)[:, codes[:, p]]
                yield _pair_rows(batch, i, scores, k)

    return run
