"""What the operators should return, worked out the plain way on small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import regex
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, uid long, hash string"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def messy_documents(seed: int = 5) -> list[tuple]:
    """Documents with NULLs in every column, empty, blank and long texts, near and exact copies, repeated rows and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choices(vocabulary, k=n))

    passage = prose(60)
    texts: list[str | None] = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [prose(30) + " " + passage + "\n" + prose(20), passage, passage.replace(" ", "\t", 1), "Éa ñ ü " * 30, "a " * 200, "x" * 700]
    long = prose(6000)
    texts += [long, long, long + " end", None, None, "", "  \n ", "one", "one two", "ONE two", "123 456", "日本語 テキスト"]
    near = texts[3].split()
    for i in range(5):
        changed = list(near)
        changed[rng.randrange(len(changed))] = "new"
        texts.append(" ".join(changed))
    rows = []
    for i, t in enumerate(texts):
        lang = [None, "aa", "bb"][i % 3]
        source = [None, "s0", "s1", "é", "s2"][min(i % 9, 4)]
        rows.append((i, t, lang, source, None if t is None else len(t), 7, 0.5, 1, "h"))
    rows += [rows[2], rows[2], rows[46], (None, texts[5], None, None, None, None, None, None, None), (None, "other null id", "aa", "s0", 3, 1, 1.0, 1, "")]
    return rows


def simhash(text: str | None, shingle: int = 3) -> int:
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    runs = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: dict[int, int], most: int = 2) -> dict[int, int]:
    """Smallest key of the component of each key."""
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= most:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


def repeated_strings(docs: list[tuple[int, bytes]], length: int) -> list[tuple]:
    seen = collections.Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for key, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_windows(docs: list[tuple[int, str | None]], window: int) -> list[tuple]:
    """``docs`` in order."""
    seen, out = set(), []
    for key, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def copies(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.8) -> dict:
    """(doc, item) -> (start, similarity) of the most similar window of item size; for an item of fewer than five words, of its first copy."""

    def cut(text):
        return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    out = {}
    for item, text in items:
        b = shingles(cut(text))
        n = len(cut(text))
        for doc, body in docs:
            if 0 < n < 5:
                w = cut(body)
                found = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == b[0]]
                if found:
                    out[doc, item] = (found[0], 1.0)
                continue
            a = shingles(cut(body))
            width = min(len(a), len(b))
            for start in range(len(a) - width + 1) if width else ():
                both = sum((collections.Counter(a[start : start + width]) & collections.Counter(b)).values())
                got = both / (len(b) + width - both)
                if got >= least - 1e-12 and got > out.get((doc, item), (0, 0))[1] + 1e-12:
                    out[doc, item] = (start, got)
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares of 150 % of all sizes by weights 5, 2, 1 in turn; what goes beyond twice a size is shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def five_words(text: str | None) -> frozenset:
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar_groups(docs: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Smallest id that links lead to; texts without a word are linked among each other."""
    sets = {i: five_words(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both >= least * either - 1e-9:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def spellings(docs: list[tuple[int | None, str | None]]) -> dict:
    """word -> (form, root, n, n_near, form_n)."""
    n: collections.Counter = collections.Counter()
    for key, text in docs:
        for run in regex.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    neighbours: dict = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            neighbours[a].append(b)
            neighbours[b].append(a)
    form = {}
    for w, others in neighbours.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), c, len(neighbours[w]), n[form[w]] if form[w] else None) for w, c in n.items()}


def measures(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = [x for x in regex.split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen: set = set()
    again = 0
    for line in (text or "").split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, again, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list, list]:
    """([(id, code, error)], codebooks by part) of (id, integers), in whole numbers of any size."""
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(p: int, x: tuple) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(p, c[p])[1] for c in cut]
            new = []
            for e, old in enumerate(books[p]):
                own = [c[p] for c, m in zip(cut, mine) if m == e]
                new.append(tuple(sum(x) // len(own) for x in zip(*own)) if own else old)
            books[p] = new
    out = []
    for (i, _), c in zip(rows, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books
