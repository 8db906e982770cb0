"""Substring dedup by collinear chaining: passages that two documents share, small changes allowed.

Seeds are all of a text's runs of K words: where no more than one word in K + 1 is changed, four in five are equal and
each stretch between changes is a seed. Seeds that only one document holds are dropped first. Each other seed is an anchor
between a document and two others that hold it, the first (smallest id) and the one before the document: two per
occurrence at most, never one per pair of documents. Chunks of ascending ids send their distinct keys, packed, to the
parts of the key space and get back where the chunks before hold them; anchors are made in the chunk and not sent.
Where all seeds of ``min_words`` words in a row are held elsewhere, that whole run is a seed too, so that an exact passage
whose parts stand separately in earlier documents has anchors to one that holds it whole; it is sent only where its seeds
do not all lead to one document on one diagonal already. Stretches that no passage so found takes in, and whose seeds
others hold too, get anchors to all earlier holders in a second pass, where blocks of ids meet two by two; a seed in very
many documents (of a common line, say) is looked up only in those that hold another seed near it, as a passage needs more
than such a line. The anchors between two documents are chained in order, gaps costing GAP_COST a word, by a Fenwick tree
over the other document's places; chains are then aligned on the words of both texts and lengthened as far as they match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.llm.repeats import CHUNK_BYTES, chunk_of, chunked, in_order, repeated_keys, sizes_of
from counterfair.llm.words import Words, chunks, runs_at, shingles

K = 4
GAP_COST = 0.02
BREAK = 10  # unlike words in a row that end a passage
REACH = (2 * BREAK + 1) * (K - 1) + BREAK + K  # between common seeds: BREAK words unlike in each text, K - 1 alike between them
LEAST_CHAIN = 10  # words that a chain must span to be aligned
MARGIN = 400  # words of the other text sent along on both sides of a chain
ANCHORS_AT_ONCE = 1 << 17
BATCH_BYTES = 1 << 18  # of texts whose words are worked out at once
BLOCK_BYTES = 128 << 20  # of texts whose unexplained seeds meet all holders in one task
LEAST_BLOCKS = 4
HELD_BYTES = 2 << 20  # of packed places that are looked through at once
SPARE_FROM = 4  # holders a seed, on the average of a document, from which on seeds are spared


def _words(texts: list[bytes]) -> Iterator[np.ndarray]:
    for _, held in chunks(texts, BATCH_BYTES):
        w = Words(held)
        for i in range(len(held)):
            yield w.of(i)


class Seeds:
    """Words of a chunk's texts end to end, and their seeds: ``place`` among all words, ``at`` in the text ``of``, ``keys``.

    ``bounds`` are where texts begin; a text of fewer than K words has no seeds.
    """

    def __init__(self, texts: list[bytes]):
        small = np.int32 if sum(map(len, texts)) < 1 << 31 else np.int64
        words, bounds, place, keys = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=small)], [np.zeros(0, dtype=np.uint64)]
        low = 0
        for _, held in chunks(texts, BATCH_BYTES):
            w = Words(held)
            words.append(w.hashes)
            bounds.append(w.bounds[1:] + low)
            if len(w.hashes) >= K:
                every = shingles(w.hashes, K)
                new = np.ones(len(every), dtype=bool)
                new[1:] = every[1:] != every[:-1]  # of a word said over and over, the first
                new[w.bounds[:-1][w.bounds[:-1] < len(new)]] = True
                for j in range(1, K):  # runs that reach into the next text
                    over = w.bounds[1:] - j
                    new[over[(over >= w.bounds[:-1]) & (over < len(new))]] = False
                some = np.flatnonzero(new)
                place.append((some + low).astype(small))
                keys.append(every[some])
            low += len(w.hashes)
        self.words, self.bounds = np.concatenate(words), np.concatenate(bounds)
        del words
        self.place = np.concatenate(place)
        self.keys = np.concatenate(keys)
        del place, keys
        n = np.diff(np.searchsorted(self.place, self.bounds.astype(small)))
        self.of = np.repeat(np.arange(len(n), dtype=small), n)
        self.at = self.place - np.repeat(self.bounds[:-1].astype(small), n)

    def before(self, some: np.ndarray) -> np.ndarray:
        """For each word, and past the last, how many of some seeds (in order of place) begin before it."""
        out = np.zeros(len(self.words) + 1, dtype=self.place.dtype)
        out[self.place[some] + 1] = 1  # no two begin at one word
        return np.cumsum(out, out=out)


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where in it each distinct key begins."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    return order, np.flatnonzero(new)


def _distinct_seeds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct seeds of a chunk, and in how many texts each is, two standing for more."""
    s = Seeds(texts)
    order, low = _by_key(s.keys)
    if not len(low):
        return s.keys, low
    of = s.of[order]
    return s.keys[order[low]], 1 + (np.minimum.reduceat(of, low) != np.maximum.reduceat(of, low))


def _stretches(at: np.ndarray, *of: np.ndarray) -> np.ndarray:
    """Numbers of the stretches without a gap over REACH; seeds go by what they are ``of`` (a text, a pair) and place."""
    new = np.zeros(len(at), dtype=bool)
    new[1:] = np.diff(at) > REACH
    for v in of:
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _regions(at: np.ndarray, min_words: int, *of: np.ndarray) -> np.ndarray:
    """Which seeds lie in a stretch that can hold a passage: its ends reach K - 1 words past a seed."""
    if len(at) == 0:
        return np.zeros(0, dtype=bool)
    group = _stretches(at, *of)
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    last = np.append(first[1:], len(at)) - 1
    return ((at[last] - at[first] + K) >= min_words - 2 * (K - 1))[group]


def _whole_runs(s: Seeds, repeated: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places among all words and hashes of the runs of ``n`` words whose seeds are all held by other documents too."""
    none = np.zeros(0, dtype=np.int64)
    if len(s.words) < n:
        return none, none, none.astype(np.uint64)
    low, high = slice(0, len(s.words) - n + 1), slice(n - K + 1, len(s.words) - K + 2)
    missing = s.before(~repeated)
    good = missing[low] == missing[high]
    every = s.before(slice(None))
    places = np.flatnonzero(good & (every[low] < every[high]))
    del missing, every, good
    of = np.searchsorted(s.bounds, places, side="right") - 1
    inside = places + n <= s.bounds[of + 1]
    places, of = places[inside], of[inside]
    keys = np.empty(len(places), dtype=np.uint64)
    lot = max(BATCH_BYTES, 2 * n)  # words at once
    for begin in range(0, len(s.words), lot):
        here = slice(*np.searchsorted(places, [begin, begin + lot]))
        keys[here] = runs_at(s.words[begin : begin + lot + n], places[here] - begin, n)
    new = np.ones(len(places), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])  # of a word said over and over, the first
    return of[new], places[new], keys[new]


def _segments(at: np.ndarray, other: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Stretches (start, end, start in the other text) made of common runs of ``n`` words on one diagonal."""
    if not len(at):
        return []
    order = np.lexsort((at, other - at))
    x, y = at[order], other[order]
    step, new = x[1:] - x[:-1], np.ones(len(x), dtype=bool)
    new[1:] = (y[1:] - y[:-1] != step) | (step > n)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    return list(zip(x[first].tolist(), (x[last] + n).tolist(), y[first].tolist()))


def chain(at: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Chains of anchors (places in both texts) as index arrays, best first; an anchor is in one chain at most.

    ``at`` ascends. An anchor continues the best chain that ends before it in both texts: the Fenwick tree keeps, over
    places in the other text, the largest score plus GAP_COST times the places where the chain ends. A chain may pass
    over unlike stretches; aligning it cuts it there.
    """
    steps, other_steps = at[1:] - at[:-1], other[1:] - other[:-1]
    rising = len(at) > 0 and (steps > 0).all() and (other_steps > 0).all()
    if rising and (len(at) == 1 or (steps + other_steps).max() * GAP_COST < 0.99):  # each anchor adds to the one chain
        return [np.arange(len(at))]
    score, before = [1.0] * len(at), [-1] * len(at)
    x, y = at.tolist(), other.tolist()
    i = 0
    if rising:  # the anchor before is the best to continue
        for i in range(1, len(x)):
            gain = score[i - 1] + GAP_COST * (x[i - 1] + y[i - 1]) - GAP_COST * (x[i] + y[i])
            if gain > 0:
                score[i], before[i] = gain + 1, i - 1
        i = len(x)
    else:
        places = np.unique(other)
        rank = (np.searchsorted(places, other) + 1).tolist()
        size = len(places)
        tree = [(-1e18, -1)] * (size + 1)
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:  # anchors at one place cannot follow each other
            best, r = (-1e18, -1), rank[j] - 1
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - GAP_COST * (x[j] + y[j])
            if gain > 0:
                score[j], before[j] = gain + 1, best[1]
            else:
                score[j] = 1.0
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + GAP_COST * (x[m] + y[m]), m), rank[m]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used = [False] * len(x)
    out = []
    for end in sorted(range(len(x)), key=lambda m: (-score[m], m)):
        if used[end]:
            continue
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        out.append(np.array(path[::-1]))
    return out


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of the words between two anchors."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 2:
            return same
    ends: list[int] = []  # patience sorting over matching places
    spots: dict[int, list[int]] = {}
    for j, v in enumerate(b.tolist()):
        spots.setdefault(v, []).append(j)
    for v in a.tolist():
        for j in reversed(spots.get(v, ())):
            k = bisect_left(ends, j)
            ends[k : k + 1] = [j]
    return len(ends)


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two word rows stay alike from their beginning (a match 1, a change -3, up to 12 below the best)."""
    n = min(len(a), len(b))
    if n == 0:
        return 0, 0
    same = a[:n] == b[:n]
    if not same[:5].any():
        return 0, 0
    total = np.cumsum(np.where(same, 1, -3))
    drop = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > 12)
    total = total[: drop[0]] if len(drop) else total
    if len(total) == 0 or total.max() <= 0:
        return 0, 0
    length = int(total.argmax()) + 1
    return length, int(same[:length].sum())


def align(a: np.ndarray, b: np.ndarray, at: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Passages of a chain: ends in both texts (start, end, start, end) and the number of equal words.

    Between anchors the words are aligned; where more than BREAK of them differ, one passage ends and another begins.
    """
    x, y = int(at[0]), int(other[0])
    start, other_start, count = _opened(a, b, x, y, 0, 0)
    step = at[1:] - at[:-1]
    cut = (np.flatnonzero((step > K) | (step != other[1:] - other[:-1])) + 1).tolist()
    ends = [*cut, len(at)]  # of seeds that overlap or touch on one diagonal
    seeds, m, block = list(zip(at.tolist(), other.tolist())), 0, 0
    while m < len(seeds):
        while ends[block] <= m:
            block += 1
        i, j = seeds[m]
        m += 1
        if i < x or j < y:  # the seed overlaps what is aligned: on the same diagonal its rest counts
            if i - j == x - y:
                m = ends[block]
                end, there = seeds[m - 1]
                if end + K > x:
                    count += end + K - x
                    x, y = end + K, there + K
            continue
        same = _matches(a[x:i], b[y:j])
        if max(i - x, j - y) - same > BREAK:
            right, more = _reach(a[x:], b[y:])
            yield start, x + right, other_start, y + right, count + more
            start, other_start, count = _opened(a, b, i, j, x, y)
        else:
            count += same
        m = ends[block]
        x, y = seeds[m - 1][0] + K, seeds[m - 1][1] + K
        count += x - i
    right, same = _reach(a[x:], b[y:])
    yield start, x + right, other_start, y + right, count + same


def _opened(a: np.ndarray, b: np.ndarray, x: int, y: int, low: int, other_low: int) -> tuple[int, int, int]:
    """Start of a passage before its first anchor, and the equal words there."""
    left, same = _reach(a[low:x][::-1], b[other_low:y][::-1])
    return x - left, y - left, same


def _exact_runs(a: np.ndarray, b: np.ndarray, diagonals: set[int], ends: tuple[int, int], n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Runs of ``n`` equal words or more between two places of a text, on the diagonals given."""
    for d in diagonals:
        low, high = max(ends[0], -d), min(ends[1], len(b) - d)
        same = np.concatenate([[False], a[low:high] == b[low + d : high + d], [False]])
        edges = np.flatnonzero(np.diff(same.view(np.int8)))
        for x, y in zip((edges[::2] + low).tolist(), (edges[1::2] + low).tolist()):
            if y - x >= n:
                yield x, y, x + d, y + d, y - x


def _outermost(found: dict[tuple, bool]) -> dict[tuple, bool]:
    """Passages of one pair of documents (start, end, start, end, ...) that do not lie inside another one.

    The values tell whether a passage, or one inside it, was found by a first holder.
    """
    out: dict[tuple, bool] = {}
    for p in sorted(found, key=lambda p: (p[0] - p[1], p)):
        around = [q for q in out if q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3]]
        for q in around or [p]:
            out[q] = out.get(q, False) or found[p]
    return out


def _needed(pairs: dict[int, dict[tuple, bool]]) -> list[tuple]:
    """A document's passages by other document, without those that only repeat one with a first holder of its seeds."""
    found = [(o, p, lead) for o, held in pairs.items() for p, lead in _outermost(held).items()]
    firsts = [p for _, p, lead in found if lead]
    inside = lambda p: any(q[0] < p[0] + K and p[1] < q[1] + K for q in firsts)
    return [(o, *p) for o, p, lead in found if lead or not inside(p)]


def _equal_stretches(chains: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Stretches of ``n`` words or more that chains cover with overlapping anchors on one diagonal."""
    out = []
    for at, other in chains:
        step = at[1:] - at[:-1]
        cut = np.flatnonzero((step > K) | (step != other[1:] - other[:-1]))
        for low, high in zip([0, *(cut + 1)], [*cut, len(at) - 1]):
            if at[high] + K - at[low] >= n:
                out.append((int(at[low]), int(at[high]) + K))
    return out


def _unlike(rest: pd.DataFrame, first: pd.DataFrame) -> np.ndarray:
    """Which passages of the second pass lie, but for K words, in none of the same document's from the first."""
    held = {i: list(zip(g["start_word"], g["end_word"])) for i, g in first.groupby("doc_id")}
    ends = zip(rest["doc_id"], rest["start_word"], rest["end_word"])
    return np.array([not any(a < x + K and y < b + K for a, b in held.get(i, ())) for i, x, y in ends], dtype=bool)


CHAIN = "doc_id BIGINT, other_id BIGINT, at ARRAY<INT>, other_at ARRAY<INT>, lead BOOLEAN"
PASSAGE = (
    "doc_id BIGINT, other_id BIGINT, start_word BIGINT, end_word BIGINT, other_start BIGINT, other_end BIGINT,"
    " equal_words BIGINT, likeness DOUBLE"
)


SENT = "chunk BIGINT, part BIGINT, keys BINARY, doc BINARY, at BINARY, last BINARY, last_at BINARY, holders BINARY"
ANSWER = "chunk BIGINT, part BIGINT, earlier BINARY, doc BINARY, at BINARY, last BINARY, last_at BINARY, crowded BINARY, number BINARY"
LEFT = "block INT, left BOOLEAN, keys BINARY, doc BINARY, n BINARY, at BINARY"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _staged(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``; the shuffle files of the job that writes the table go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return staged(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _range_of(cuts: np.ndarray):
    """Column function: in which of the ranges that begin at ``cuts`` an id lies."""

    @F.pandas_udf("bigint")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right"))

    return place


def _cuts(docs: DataFrame, text: str, key: str, chunks: int) -> np.ndarray:
    """Ids that deal the documents into chunks of ascending ids and about equal bytes."""
    ids = docs.select(F.col(key).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n")).where("id IS NOT NULL")
    shares = [(j + 1) / (4 * chunks) for j in range(4 * chunks - 1)]
    fine = np.unique(np.array(ids.agg(F.percentile_approx("id", shares, 16 * chunks)).first()[0] or [], dtype=np.int64))
    sizes = np.zeros(len(fine) + 1, dtype=np.int64)
    for place, n in ids.groupBy(_range_of(fine)("id")).agg(F.coalesce(F.sum("n"), F.lit(0))).collect():
        sizes[place] = n
    chunk = (np.cumsum(sizes) - sizes) * chunks // max(1, sizes.sum())
    return fine[np.diff(chunk) > 0]


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all highest ones together: where they are small, the shuffle's compression takes most away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(held: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _narrow(values: np.ndarray) -> bytes:
    """As ``_packed``, of numbers of 0 or more, without the highest bytes where all are 0."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return _packed(values.astype("<u8"))[: width * len(values)]


def _widened(held: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, : len(held) // n] = np.frombuffer(held, dtype=np.uint8).reshape(-1, n).T
    return out.view("<i8").ravel()


def _seeds_packed(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Seeds by document and place: key numbers, documents, the number of seeds of each, steps between their places."""
    first = _begins(doc)
    steps = np.diff(at, prepend=at[:1])
    steps[first] = at[first]
    return _narrow(key), _packed(doc[first]), _packed(np.diff(np.append(first, len(doc))).astype("<u4")), _narrow(steps)


def _seeds_unpacked(keys: bytes, doc: bytes, n: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _unpacked(n, "<u4").astype(np.int64)
    size = int(n.sum())
    place = np.cumsum(_widened(at, size))
    first = np.cumsum(n) - n
    place -= np.repeat(np.concatenate([[0], place])[first], n)
    return _widened(keys, size), np.repeat(_unpacked(doc, "<i8"), n), place.astype(np.int32)


def _bits(held: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held, dtype=np.uint8), count=n).astype(bool)


class Holders:
    """Occurrences of keys in the documents of a chunk, and which documents of the chunk hold each key.

    ``order`` puts them by key, id and place; ``group`` is a key's number among the chunk's sorted distinct keys.
    """

    def __init__(self, keys: np.ndarray, doc: np.ndarray, at: np.ndarray):
        self.order = np.lexsort((at, doc, keys))
        k, self.doc, self.at = keys[self.order], doc[self.order], at[self.order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        other = new.copy()
        other[1:] |= self.doc[1:] != self.doc[:-1]
        self.low = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.keys = k[self.low]
        self.runs = np.flatnonzero(other)  # where a document's occurrences of a key begin
        self.run = np.cumsum(other) - 1

    def sent(self, chunk: int, parts: int) -> pd.DataFrame:
        """For each part of the key space: the chunk's distinct keys, their first and last place, up to 4 holders counted."""
        high = np.append(self.low[1:], len(self.doc)) - 1
        holders = np.minimum(np.bincount(self.group[self.runs], minlength=len(self.keys)), 4).astype(np.uint8)
        edges = np.searchsorted(self.keys >> np.uint64(64 - (parts.bit_length() - 1)), np.arange(parts + 1, dtype=np.uint64))
        out = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            some = slice(edges[p], edges[p + 1])
            low, last = self.low[some], high[some]
            doc, at = self.doc[low], self.at[low]
            steps = np.diff(self.keys[some], prepend=np.uint64(0))
            ends = (_packed(v) for v in (steps, doc, at, self.doc[last] - doc, self.at[last] - at))
            out.append((chunk, p, *ends, holders[some].tobytes()))
        return _frame(out, SENT)

    def linked(self, answers: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """In the order given: each occurrence's first place anywhere, the last one in a smaller id (or none), whether over 3 hold it."""
        n = len(self.keys)
        first, first_at = self.doc[self.low], self.at[self.low].astype(np.int64)
        last, last_at, before = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        crowded = np.zeros(n, dtype=bool)
        low = 0
        for row in answers[answers["part"] >= 0].sort_values("part").itertuples(index=False):
            size = int(np.frombuffer(row.earlier[:4], dtype="<u4")[0])
            some = low + np.flatnonzero(_bits(row.earlier[4:], size))
            crowded[low : low + size] = _bits(row.crowded, size)
            first[some], first_at[some] = _unpacked(row.doc, "<i8"), _unpacked(row.at, "<i4")
            last[some], last_at[some] = first[some] + _unpacked(row.last, "<i8"), first_at[some] + _unpacked(row.last_at, "<i4")
            before[some] = True
            low += size
        g = self.group[self.runs]
        inside = np.zeros(len(g), dtype=bool)
        inside[1:] = g[1:] == g[:-1]  # an earlier document of the chunk holds the key too
        end = np.maximum(self.runs - 1, 0)
        by_run = np.where(inside, self.doc[end], last[g]), np.where(inside, self.at[end], last_at[g]), inside | before[g]
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(back))
        group, run = self.group[back], self.run[back]
        return first[group], first_at[group], *(v[run] for v in by_run), crowded[group]

    def numbers(self, answers: pd.DataFrame, parts: int) -> np.ndarray:
        """In the order given: a number of each occurrence's key, the same in all chunks."""
        answers = answers[answers["part"] >= 0].sort_values("part")
        number = [np.cumsum(_unpacked(v, "<u4"), dtype=np.int64) * parts + p for p, v in zip(answers["part"], answers["number"])]
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.concatenate([np.zeros(0, dtype=np.int64), *number])[self.group]
        return out


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the first place of its keys in earlier chunks and the last one there, in the order they were sent.

    What a chunk sends to itself (a part below 0) comes back as it is.
    """
    if rows["part"].iloc[0] < 0:
        kept = rows.rename(columns={"keys": "earlier"}).assign(crowded=b"", number=b"")
        return kept[[c.split()[0] for c in ANSWER.split(", ")]]
    rows = rows.sort_values("chunk")
    keys = [np.cumsum(_unpacked(k, "<u8")) for k in rows["keys"]]
    sizes = [len(k) for k in keys]
    doc, last = (np.concatenate([_unpacked(v, "<i8") for v in rows[c]]) for c in ("doc", "last"))
    at, last_at = (np.concatenate([_unpacked(v, "<i4") for v in rows[c]]) for c in ("at", "last_at"))
    holders = np.concatenate([np.frombuffer(v, dtype=np.uint8) for v in rows["holders"]]).astype(np.int64)
    last, last_at = last + doc, last_at + at
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[order][1:] != every[order][:-1]
    low = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lead = np.empty_like(order)
    lead[order] = order[low][group]
    before = np.empty_like(order)
    before[order] = order[np.maximum(np.arange(len(order)) - 1, 0)]
    earlier, crowded, ranks = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool), np.empty_like(order)
    earlier[order], crowded[order], ranks[order] = ~new, (np.add.reduceat(holders[order], low) > 3)[group], group
    out, start = [], 0
    for chunk, part, n in zip(rows["chunk"], rows["part"], sizes):
        some = np.arange(start, start + n)
        bits = np.uint32(n).astype("<u4").tobytes() + np.packbits(earlier[some]).tobytes()
        held = some[earlier[some]]
        f, b = lead[held], before[held]
        ends = (_packed(v) for v in (doc[f], at[f], last[b] - doc[f], last_at[b] - at[f]))
        number = np.diff(ranks[some], prepend=0).astype("<u4")
        out.append((chunk, part, bits, *ends, np.packbits(crowded[some]).tobytes(), _packed(number)))
        start += n
    return _frame(out, ANSWER)


def _alike(s: Seeds, kept: np.ndarray, doc: np.ndarray, there: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``n`` words at ``places`` have all their seeds lead to one document on one diagonal; the first seed of each run.

    Of the seeds ``kept``, ``doc`` and ``there`` are the places that they lead to.
    """
    at, of = s.at[kept], s.of[kept]
    cut = np.ones(len(kept) + 1, dtype=s.place.dtype)
    cut[1:-1] = (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(there - at) != 0) | (np.diff(of) != 0)
    np.cumsum(cut, out=cut)
    before = s.before(kept)
    low, high = before[places], before[places + n - K + 1] - 1
    whole = high - low == n - K  # none left out
    whole[whole] = cut[low[whole]] == cut[high[whole]]
    return whole, low


def _spared(unit: np.ndarray, at: np.ndarray, n: np.ndarray, extent: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which seeds need not be looked up in all their ``n`` holders, and the first and last spared seed within reach of each.

    Spared are groups of seeds less than ``extent`` words long and over ``reach`` words apart in their ``unit``, those
    with the most holders: a stretch of anchors without a gap over ``reach`` that is ``extent`` long has an anchor outside
    them. Seeds go by unit and place. The best groups that end at each seed or before it are worked out left to right;
    units whose seeds have few holders spare none.
    """
    spared = np.zeros(len(at), dtype=bool)
    itself = np.arange(len(at))
    if extent <= 0 or not len(at):
        return spared, itself, itself
    rank = np.cumsum(np.diff(unit, prepend=unit[:1]) != 0)
    start = np.searchsorted(rank, rank)
    step = np.int64(at.max()) + 1
    pos = rank * step + at
    low = np.maximum(start, np.searchsorted(pos, pos - (extent - 1)))
    earlier = np.maximum(start, np.searchsorted(pos, pos[low] - min(reach, int(step))))
    total = np.concatenate([[0], np.cumsum(n)])
    gain = total[1:] - total[low]
    size = np.bincount(rank)
    heavy = np.add.reduceat(n, np.flatnonzero(start == itself)) > SPARE_FROM * size
    first, end = np.flatnonzero(start == itself), np.append(np.flatnonzero(start == itself)[1:], len(at))
    for a, b in zip(first[heavy].tolist(), end[heavy].tolist()):
        best = [0] * (b - a + 1)
        before, more = (earlier[a:b] - a).tolist(), gain[a:b].tolist()
        for i in range(b - a):
            with_it, without = more[i] + best[before[i]], best[i]
            best[i + 1] = with_it if with_it > without else without
        i = b - a
        while i > 0:
            if best[i] == best[i - 1]:
                i -= 1
            else:
                spared[low[a + i - 1] : a + i] = True
                i = before[i - 1]
    places = np.flatnonzero(spared)
    if not len(places):
        return spared, itself, itself
    new = np.ones(len(places), dtype=bool)  # groups
    new[1:] = (np.diff(places) != 1) | (np.diff(rank[places]) != 0) | (np.diff(pos[places]) > reach)
    group = np.cumsum(new) - 1
    begin, last = places[new], places[np.append(np.flatnonzero(new)[1:], len(places)) - 1]
    count = np.concatenate([[0], np.cumsum(spared)])
    left, right = np.maximum(count[:-1] - 1, 0), np.minimum(count[1:], len(places) - 1)
    near = lambda other: (rank[other] == rank) & (np.abs(pos[other] - pos) <= reach)
    leads = np.where(near(places[left]), begin[group[left]], itself)
    ends = np.where(near(places[right]), last[group[right]], itself)
    return spared, np.minimum(leads, itself), np.maximum(ends, itself)


def _order_of(values: np.ndarray) -> np.ndarray:
    """An order by whole numbers of 0 or more that leaves equal ones as they are."""
    n = max(1, len(values))
    if len(values) and int(values.max()) < (1 << 62) // n:  # plain numbers sort faster
        return np.sort(values.astype(np.int64) * n + np.arange(n)) % n
    return np.argsort(values, kind="stable")


def _begins(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


class Held:
    """Seeds (keys, ids, places) that are looked up: by key, with the documents' ranks among ``ids``."""

    def __init__(self, seeds: tuple[np.ndarray, ...]):
        key, doc, at = _by_place(seeds)
        first = _begins(doc)
        self.ids, self.n_ids = doc[first], np.int64(len(first))
        order = _order_of(key)
        self.key, self.at = key[order], at[order]
        self.rank = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(doc))))[order]
        self.holder = np.zeros(len(key), dtype=np.int64)  # key and document
        np.cumsum(self.key[1:] != self.key[:-1], out=self.holder[1:])
        self.holder *= self.n_ids
        self.holder += self.rank


def _shared_pairs(left: tuple[np.ndarray, ...], held: Held | tuple[np.ndarray, ...], min_words: int, reach: int = 1 << 40) -> Iterator[pd.DataFrame]:
    """Anchors of left seeds (keys, ids, places) to smaller ids that hold them, of pairs that span enough words at once.

    A pair whose anchors have a gap over ``reach`` need not be given where none of the parts spans enough. Seeds that many
    documents hold are looked up only in those that hold another seed near them, as far as such pairs can do without.
    """
    key, doc, at = _by_place(left)
    extent = min_words - 2 * (K - 1) - K  # between the first and the last anchor
    held = held if isinstance(held, Held) else Held(held)
    own = _order_of(key)  # keys looked up in order
    names = key[own]
    first = _begins(names)
    size = np.diff(np.append(first, len(key)))
    found, until = (np.searchsorted(held.key, names[first], side=side) for side in ("left", "right"))
    low, n = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.int64)
    low[own], n[own] = np.repeat(found, size), np.repeat(until - found, size)
    some = n > 0
    key, doc, at, low, n = (v[some] for v in (key, doc, at, low, n))
    spared, leads, ends = _spared(doc, at, n, extent, reach)
    spots, count = np.flatnonzero(spared), np.concatenate([[0], np.cumsum(spared)])
    mine_rank = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    looked_up = np.where(spared, 0, n)
    total = np.cumsum(looked_up)
    edges = np.append(np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)), len(doc))  # where documents begin
    begin = 0
    while begin < len(edges) - 1:
        base = total[edges[begin]] - looked_up[edges[begin]]
        end = max(begin + 1, int(np.searchsorted(total[edges[1:] - 1], base + ANCHORS_AT_ONCE, side="right")))
        some = slice(edges[begin], edges[end])
        begin = end
        mine, theirs = _each(np.arange(some.start, some.stop), low[some], looked_up[some])
        keep = held.ids[held.rank[theirs]] < doc[mine]
        mine, theirs = mine[keep], theirs[keep]
        if len(mine) == 0:
            continue
        pair = (mine_rank[mine] - mine_rank[some.start]) * held.n_ids + held.rank[theirs]
        order = _order_of(pair)  # a pair's anchors stay by place
        mine, theirs, pair = mine[order], theirs[order], pair[order]
        first = _begins(pair)
        lead, last = np.minimum.reduceat(leads[mine], first), np.maximum.reduceat(ends[mine], first)
        wide = at[last] - at[lead] >= extent
        size = np.diff(np.append(first, len(mine)))
        keep = np.repeat(wide, size)
        there, lead, last, size = held.rank[theirs[first[wide]]], lead[wide], last[wide], count[last[wide] + 1] - count[lead[wide]]
        pairs = pair[first[wide]]
        mine, theirs, pair = mine[keep], theirs[keep], pair[keep]
        out, step = [(mine, theirs, pair)], 0
        asked = np.cumsum(size)
        while step < len(size):  # spared seeds near a pair's anchors, where the other document holds them too
            base = asked[step] - size[step]
            until = max(step + 1, int(np.searchsorted(asked, base + ANCHORS_AT_ONCE, side="right")))
            lot = np.arange(step, until)
            step = until
            which, spot = _each(lot, count[lead[lot]], size[lot])
            spot = spots[spot]
            wanted = held.holder[low[spot]] - held.rank[low[spot]] + there[which]
            at_first = np.searchsorted(held.holder, wanted)
            found = np.searchsorted(held.holder, wanted, side="right") - at_first
            index, place = _each(np.arange(len(found)), at_first, found)
            out.append((spot[index], place, pairs[which[index]]))
        mine, theirs, pair = (np.concatenate(v) for v in zip(*out))
        order = np.lexsort((theirs, mine, pair))
        mine, theirs, pair = mine[order], theirs[order], pair[order]
        if len(pair) == 0:
            continue
        first = _begins(pair)
        size = np.diff(np.append(first, len(pair)))
        wide = np.repeat(at[mine[first + size - 1]] - at[mine[first]] >= extent, size)
        mine, theirs = mine[wide], theirs[wide]
        yield pd.DataFrame({"doc_id": doc[mine], "other_id": held.ids[held.rank[theirs]], "at": at[mine], "other_at": held.at[theirs]})


def _by_place(seeds: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Keys, ids and places by id and place."""
    _, doc, at = seeds
    same = doc[1:] == doc[:-1]
    if ((doc[1:] > doc[:-1]) | (same & (at[1:] >= at[:-1]))).all():
        return seeds
    order = np.lexsort((at, doc))
    return tuple(v[order] for v in seeds)


def _each(of: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``of`` the ``n`` places from ``low`` on, both side by side."""
    return np.repeat(of, n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _ordered(rows: pd.DataFrame, *columns: str) -> pd.DataFrame:
    return rows.iloc[np.lexsort([rows[c].to_numpy() for c in reversed(columns)])]


def _inside(doc: np.ndarray, at: np.ndarray, passages: pd.DataFrame) -> np.ndarray:
    """Which seeds (by document and place) lie in a passage of their document."""
    if not (len(doc) and len(passages)):
        return np.zeros(len(doc), dtype=bool)
    ids, rank = np.unique(doc, return_inverse=True)
    start, end = passages["start_word"].to_numpy(), passages["end_word"].to_numpy() - K
    step = np.int64(max(at.max(), start.max(), end.max())) + 1
    pos = rank * step + at
    own = np.searchsorted(ids, passages["doc_id"].to_numpy()) * step  # a document with passages has seeds
    low, high = np.searchsorted(pos, own + start), np.searchsorted(pos, own + end, side="right")
    cover = np.bincount(low, minlength=len(pos) + 1) - np.bincount(np.maximum(low, high), minlength=len(pos) + 1)
    return np.cumsum(cover)[:-1] > 0


def shared_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 50, percent: int = 80):
    """Passages of at least ``min_words`` words that a document shares with one of smaller id.

    One row per passage: where it lies in both texts (word places, end excluded), how many words are equal, and their
    share of the longer side, at least ``percent`` of 100. Of the documents that hold a passage, each is paired with the
    first that holds its seeds, or where that gives no passage, with the last before it; where neither gives one, with all
    before it that do. So every run of ``min_words`` equal words that an earlier document holds lies in a row, and a changed
    copy does whichever the earlier holders of its seeds are. The second pass takes as many anchors as there are pairs of
    holders of the seeds in stretches that the first leaves unexplained. Null, empty and blank texts have no passages; rows without id take
    no part; rows that repeat an id count as one document, whose first text (in text order) is aligned.
    """
    n_chunks, parts = sizes_of(docs, text)
    rows = chunked(docs.where(F.col(key).isNotNull()), text, key, n_chunks)
    # Seeds are looked up by chunks of ascending ids: the holders inside a chunk are in order there, and a seed that many
    # documents hold is sent once a chunk.
    cuts = _cuts(docs, text, key, n_chunks)
    range_of = _range_of(cuts)
    ranged = rows.withColumn("chunk", range_of("doc_id"))
    by_range = ranged.groupBy("chunk")
    masks = _staged(repeated_keys(ranged, parts, None, _distinct_seeds), "passage-masks")
    whole_run = max(min_words, K + 1)

    def single_seeds(rows: pd.DataFrame, repeated: Callable[[Seeds], np.ndarray]) -> tuple:
        """Ids and seeds of a chunk, whether others hold each, and of those kept: which they are, id, place and key."""
        ids, texts = in_order(rows)
        s = Seeds(texts)
        held = repeated(s)
        kept = np.flatnonzero(held)
        kept = kept[_regions(s.at[kept], min_words, s.of[kept])]
        ids, keys = np.array(ids, dtype=np.int64), s.keys[kept]
        del s.keys  # no longer needed
        return ids, s, held, kept, ids[s.of[kept]], s.at[kept].astype(np.int32), keys

    def by_masks(side: pd.DataFrame) -> Callable[[Seeds], np.ndarray]:
        def repeated(s: Seeds) -> np.ndarray:
            bits = [_bits(m, n) for m, n in zip(*(side.sort_values("part")[c] for c in ("mask", "n")))]
            order, low = _by_key(s.keys)
            out = np.empty(len(order), dtype=bool)
            out[order] = np.repeat(np.concatenate([np.zeros(0, dtype=bool), *bits]), np.diff(np.append(low, len(order))))
            return out

        return repeated

    def as_sent(side: pd.DataFrame) -> Callable[[Seeds], np.ndarray]:
        return lambda s: _bits(side.loc[side["part"] < 0, "earlier"].iloc[0], len(s.keys))

    def send_seeds(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _frame([], SENT)
        _, _, held, _, doc, at, keys = single_seeds(rows, by_masks(side))
        chunk = int(rows["chunk"].iloc[0])
        own = _frame([(chunk, -1 - chunk, np.packbits(held).tobytes(), *[b""] * 5)], SENT)
        return pd.concat([own, Holders(keys, doc, at).sent(chunk, parts)], ignore_index=True)

    def beside_texts(**tables: DataFrame) -> DataFrame:
        """Tables by chunk as one, for a cogroup with the texts; numbers that a table has not are 0."""
        some = [t.withColumn("kind", F.lit(kind)) for kind, t in tables.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some).fillna(0)

    def answers_to(sent: DataFrame, name: str) -> DataFrame:
        return _staged(sent.groupBy("part").applyInPandas(_answered, ANSWER), name)

    links = answers_to(by_range.cogroup(masks.groupBy("chunk")).applyInPandas(send_seeds, SENT), "passage-links")
    places = links.drop("number")

    def whole_runs(ids: np.ndarray, s: Seeds, held: np.ndarray, kept: np.ndarray, first: np.ndarray, first_at: np.ndarray) -> tuple:
        """Ids, places and keys of whole runs, and the first places of those whose seeds all lead to one (-1: the others).

        The first document that holds all seeds of a run in a row on one diagonal, each seed's first, holds the run first.
        """
        of, at, keys = _whole_runs(s, held, whole_run)
        alike, start = _alike(s, kept, first, first_at, at, whole_run)
        there, there_at = np.zeros(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int64)
        there[alike], there_at[alike] = first[start[alike]], first_at[start[alike]]
        return ids[of], (at - s.bounds[of]).astype(np.int32), keys, there, there_at

    def send_runs(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _frame([], SENT)
        ids, s, held, kept, doc, at, keys = single_seeds(rows, as_sent(side))
        first, first_at, *_ = Holders(keys, doc, at).linked(side)
        doc, at, keys, _, there_at = whole_runs(ids, s, held, kept, first, first_at)
        ask = there_at < 0
        return Holders(keys[ask], doc[ask], at[ask]).sent(int(rows["chunk"].iloc[0]), parts)

    runs = answers_to(by_range.cogroup(places.groupBy("chunk")).applyInPandas(send_runs, SENT), "passage-runs")
    side = beside_texts(seeds=places, runs=runs.drop("number"))

    def first_chains(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _frame([], CHAIN)
        links = side[side["kind"] == "seeds"]
        ids, s, held, kept, doc, at, keys = single_seeds(rows, as_sent(links))
        first, first_at, last, last_at, before, _ = Holders(keys, doc, at).linked(links)
        run_doc, run_at, run_keys, there, there_at = whole_runs(ids, s, held, kept, first, first_at)
        ask = there_at < 0
        there[ask], there_at[ask], *_ = Holders(run_keys[ask], run_doc[ask], run_at[ask]).linked(side[side["kind"] == "runs"])
        lead, two, run = first < doc, before & (last > first), there < run_doc
        anchors = [(doc[lead], first[lead], at[lead], first_at[lead], True, True), (doc[two], last[two], at[two], last_at[two], True, False)]
        anchors.append((run_doc[run], there[run], run_at[run], there_at[run], False, True))
        del s, held, kept, keys, doc, first, first_at, last, last_at, before, run_doc, run_keys, there, there_at
        n = [len(a[0]) for a in anchors]
        ends = [np.concatenate([a[i] for a in anchors], dtype=kind) for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32))]
        flags = [np.repeat([a[i] for a in anchors], n) for i in (4, 5)]
        del anchors
        return chains(*ends, *flags)

    def chains(ids: np.ndarray, others: np.ndarray, at: np.ndarray, other: np.ndarray, single: np.ndarray, lead: np.ndarray) -> pd.DataFrame:
        """Chains of anchors (ids and places in both texts), of a seed or a whole run, to a first holder or another one."""
        if not len(ids):
            return _frame([], CHAIN)
        order = np.lexsort((other, at, others, ids))
        ids, others = ids[order], others[order]
        edges = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(others) != 0)) + 1])
        ends = np.append(edges[1:], len(ids))
        wide = at[order[ends - 1]] - at[order[edges]] + K >= LEAST_CHAIN
        wide |= ~np.logical_and.reduceat(single[order], edges)  # others have no chain
        by_doc: dict[int, list[tuple]] = {}
        for low, high in zip(edges[wide].tolist(), ends[wide].tolist()):
            pair = order[low:high]
            kept = pair_chains(at[pair], other[pair], single[pair], lead[pair])
            by_doc.setdefault(int(ids[low]), []).extend((int(others[low]), *c) for c in kept)
        out = []
        for i, kept in by_doc.items():
            sure = _equal_stretches([(a, b) for _, a, b, first in kept if first], min_words)
            for o, a, b, first in kept:
                if first or not any(start <= a[0] and a[-1] + K <= end for start, end in sure):
                    out.append((i, o, a, b, first))
        return _frame(out, CHAIN)

    def pair_chains(at: np.ndarray, other: np.ndarray, single: np.ndarray, lead: np.ndarray) -> list[tuple]:
        """Chains of one pair of documents, and whether an anchor of theirs leads to its first holder."""
        x, y, first = at[single], other[single], lead[single]
        kept = [(x[c], y[c], bool(first[c].any())) for c in chain(x, y) if x[c[-1]] - x[c[0]] + K >= LEAST_CHAIN]
        straight: dict[int, list[int]] = {}
        for k, (a, b, _) in enumerate(kept):
            if (b - a == b[0] - a[0]).all():
                straight.setdefault(int(b[0] - a[0]), []).append(k)
        for start, end, o in _segments(at[~single], other[~single], whole_run):
            there = False
            for k in straight.get(o - start, ()):  # aligning a chain on this diagonal alone takes in the stretch
                a, b, _ = kept[k]
                if ((start <= a) & (a <= end - K)).any():
                    kept[k], there = (a, b, True), True
            if not there:
                ends = np.array([start, end - K])
                kept.append((ends, ends + (o - start), True))
        return kept

    def words_of(ids: list, texts: list[bytes], wanted: set) -> dict[int, np.ndarray]:
        """Words of the documents wanted, of each its first text."""
        texts_of = {i: t for i, t in zip(reversed(ids), reversed(texts)) if i in wanted}
        return dict(zip(texts_of, _words(list(texts_of.values()))))

    def windows(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The other text's words around each chain."""
        ids, texts = in_order(rows)
        wanted = set(held["other_id"])
        words = words_of(ids, texts, wanted)
        low = [max(0, int(b[0]) - MARGIN) for b in held["other_at"]]
        cut = [words[o][a : int(b[-1]) + MARGIN].tobytes() for o, a, b in zip(held["other_id"], low, held["other_at"])]
        return held.drop(columns=["chunk"]).assign(low=low, words=cut)

    def aligned(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, texts = in_order(rows)
        wanted = set(held["doc_id"])
        words = words_of(ids, texts, wanted)
        out: dict[int, dict[int, dict[tuple, bool]]] = {}
        columns = ("doc_id", "other_id", "at", "other_at", "lead", "low", "words")
        for i, o, at, other, lead, low, raw in zip(*(held[c] for c in columns)):
            b = np.frombuffer(raw, dtype=np.uint64)
            at, other = np.asarray(at), np.asarray(other) - low
            mine = out.setdefault(i, {}).setdefault(o, {})
            for a0, a1, b0, b1, same in align(words[i], b, at, other):
                if min(a1 - a0, b1 - b0) < min_words:
                    continue
                found = [(a0, a1, b0, b1, same)]
                if 100 * same < percent * max(a1 - a0, b1 - b0):  # too unlike as a whole
                    inside = (at >= a0) & (at < a1)
                    found = _exact_runs(words[i], b, set((other - at)[inside].tolist()), (a0, a1), min_words)
                for a0, a1, b0, b1, same in found:
                    p = (a0, a1, b0 + low, b1 + low, same, same / max(a1 - a0, b1 - b0))
                    mine[p] = mine.get(p, False) or lead
        return _frame(sorted((i, *p) for i, pairs in out.items() for p in _needed(pairs)), PASSAGE)

    def passages_of(chained: DataFrame, few: bool = False) -> DataFrame:
        """Chains aligned; where ``few`` documents have any, the others' texts are not sent."""

        def texts(wanted: str):
            ids = chained.select(F.col(wanted).alias("doc_id"))
            return (rows.join(ids, "doc_id", "left_semi").select(*rows.columns) if few else rows).groupBy("chunk")

        by_other = chained.withColumn("chunk", chunk_of(F.col("other_id"), n_chunks)).groupBy("chunk")
        sent = texts("other_id").cogroup(by_other).applyInPandas(windows, CHAIN + ", low INT, words BINARY")
        by_doc = sent.withColumn("chunk", chunk_of(F.col("doc_id"), n_chunks)).groupBy("chunk")
        return texts("doc_id").cogroup(by_doc).applyInPandas(aligned, PASSAGE)

    chained = _staged(by_range.cogroup(side.groupBy("chunk")).applyInPandas(first_chains, CHAIN), "passage-chains")
    first = _staged(passages_of(chained), "passages")
    n_ranges = len(cuts) + 1
    blocks = min(n_ranges, max(LEAST_BLOCKS, -(-n_chunks * CHUNK_BYTES // BLOCK_BYTES)))

    def unexplained(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """Seeds of stretches outside the passages found, where some seed has holders that the first pass did not try.

        Blocks of chunks meet two by two: a chunk's seeds so left go to all blocks of smaller or the same ids, all of its
        seeds to all blocks of larger or the same ids.
        """
        if not len(rows):
            return _frame([], LEFT)
        links = side[side["kind"] == "seeds"]
        *_, doc, at, keys = single_seeds(rows, as_sent(links))
        holders = Holders(keys, doc, at)
        *_, crowded = holders.linked(links)
        number = holders.numbers(links, parts)
        order = np.lexsort((at, doc))
        doc, at, number, crowded = (v[order] for v in (doc, at, number, crowded))
        keep = ~_inside(doc, at, side[side["kind"] == "passage"])
        left = np.flatnonzero(keep)
        left = left[_regions(at[left], min_words, doc[left])]
        if len(left):
            stretch = _stretches(at[left], doc[left])
            left = left[np.bincount(stretch, weights=crowded[left])[stretch] > 0]
        block = int(rows["chunk"].iloc[0]) * blocks // n_ranges
        out = [(block, True, *_seeds_packed(number[left], doc[left], at[left]))] if len(left) else []
        if len(keys):
            out.append((block, False, *_seeds_packed(number, doc, at)))
        return _frame(out, LEFT)

    explained = first.select(range_of("doc_id").alias("chunk"), "doc_id", "start_word", "end_word")
    seen = beside_texts(seeds=links, passage=explained)
    between = by_range.cogroup(seen.groupBy("chunk")).applyInPandas(unexplained, LEFT)
    met_blocks = F.when(F.col("left"), F.sequence(F.lit(0), "block")).otherwise(F.sequence("block", F.lit(blocks - 1)))
    between = between.withColumn("other", F.explode(met_blocks))
    between = between.withColumns({"a": F.greatest("block", "other"), "b": F.least("block", "other")}).drop("block", "other")

    def seeds_of(packed: Iterable[tuple]) -> tuple[np.ndarray, ...]:
        some = sorted((_seeds_unpacked(*p) for p in packed), key=lambda p: p[1][0])  # chunks of ascending ids
        return tuple(np.concatenate(v) for v in zip(*some))

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        left, held = (rows[rows["left"].eq(side)][["keys", "doc", "n", "at"]] for side in (True, False))
        if not (len(left) and len(held)):
            return _frame([], CHAIN)
        out, lot, size = [], [], 0
        packed = list(held.itertuples(index=False))
        while packed:  # a document lies in one chunk
            lot.append(packed.pop())
            size += len(lot[-1].at)
            if size >= HELD_BYTES or not packed:
                some = Held(seeds_of(lot))
                for one in left.itertuples(index=False):
                    out += [rest_chains(anchors) for anchors in _shared_pairs(_seeds_unpacked(*one), some, min_words, REACH)]
                lot, size = [], 0
        return pd.concat([_frame([], CHAIN), *(c for c in out if len(c))], ignore_index=True)

    def rest_chains(rows: pd.DataFrame) -> pd.DataFrame:
        for place in ("other_at", "at"):
            rows = _ordered(rows, "doc_id", "other_id", place)
            rows = rows[_regions(rows[place].to_numpy(), min_words, rows["doc_id"].to_numpy(), rows["other_id"].to_numpy())]
        every = np.ones(len(rows), dtype=bool)
        return chains(*(rows[c].to_numpy() for c in ("doc_id", "other_id", "at", "other_at")), every, ~every)

    rest = passages_of(_staged(between.groupBy("a", "b").applyInPandas(met, CHAIN), "passage-chains"), few=True)

    def beside(rest: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        return rest[_unlike(rest, first)].drop(columns="chunk")

    by_doc = rest.withColumn("chunk", range_of("doc_id")).groupBy("chunk")
    more = by_doc.cogroup(explained.groupBy("chunk")).applyInPandas(beside, PASSAGE)
    return first.unionByName(more)
