"""Language-model scores by context-tree weighting over bytes, beside a unigram base score.

A byte is eight binary decisions along a tree of 255 nodes. For each node, every context of the last 0 .. DEPTH bytes
counts the zeros and ones seen in training and gives the Krichevsky-Trofimov estimate (ones + 1/2) / (n + 1). With Pe
the KT probability of all that a context saw, its weighted probability is Pw = Pe at DEPTH and half Pe, half the product
of its longer contexts' Pw above; so a context's own estimate has the weight Pe / 2 Pw, the longer ones the rest. A
context never seen has its shorter context's estimate. Texts are lowered, start after zero bytes and end with one.

Documents are dealt into chunks. A chunk sends its distinct (context, byte) runs with their training counts to the part
of the two last context bytes, which holds the whole tree below them; only what joins the parts, contexts of one byte
(256 x 255 nodes), is added up for all. Each part then returns the logarithm for every run that a chunk asked for.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.llm.repeats import in_order, sizes_of
from counterfair.llm.words import Words, chunks, mix

DEPTH = 4
CHUNK_SHARE = 2  # chunks are this much smaller than those of shingles: each byte has a run
FOLDS, HELD_OUT = 7, 2
TOKEN, RUN, TOTAL = 0, 1, 2
SENT = "chunk BIGINT, kind INT, part INT, keys BINARY, counts BINARY, n BIGINT"
BACK = "chunk BIGINT, kind INT, part INT, found BINARY, n BIGINT"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the bytes before it, the nearest first, and the byte, as one number.

    Also returns the bounds of the texts.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), dtype=np.uint8)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], sizes)
    out = np.zeros(len(data), dtype=np.uint64)
    for back in range(1, depth + 1):
        before = np.zeros(len(data), dtype=np.uint64)
        before[back:] = data[: max(0, len(data) - back)]
        before[place < back] = 0
        out = (out << np.uint64(8)) | before
    return (out << np.uint64(8)) | data, bounds


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the bounds of the texts."""
    hashes, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for _, held in chunks(texts):
        w = Words(held)
        hashes.append(w.hashes)
        sizes.append(np.diff(w.bounds))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _run_part(keys: np.ndarray, depth: int, bits: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth - 1))  # the two last bytes
    return (mix(near) >> np.uint64(64 - bits)).astype(np.int64)


def _by_part(keys: np.ndarray, kind: int, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings sorted keys together by part, each part sorted, and the parts' bounds."""
    part = _run_part(keys, depth, bits) if kind == RUN else (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange((1 << bits) + 1))


@lru_cache(maxsize=1)
def _small() -> np.ndarray:
    return np.array([math.lgamma(i / 2) if i else 0.0 for i in range(64)])


def _lgamma(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2) for whole numbers of at least 1: a table, then Stirling's series."""
    x = np.maximum(twice, 32) / 2
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(twice < 64, _small()[np.minimum(twice, 63)], series)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of a row of decisions."""
    return _lgamma(2 * zeros + 1) + _lgamma(2 * ones + 1) - _lgamma(2 * (zeros + ones) + 2) - math.log(math.pi)


class Level:
    """Nodes of one depth for the bits of one place: sorted keys (context and the bits above), counts, estimates."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, bit: int):
        symbol = runs & np.uint64(255)
        keys = (runs >> np.uint64(8) << np.uint64(8)) | (symbol >> np.uint64(8 - bit))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        one = (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1
        self.keys = keys[starts]
        self.ones = np.add.reduceat(np.where(one, counts, 0), starts) if len(keys) else counts
        self.n = np.add.reduceat(counts, starts) if len(keys) else counts
        self.log_own = _log_kt(self.n - self.ones, self.ones)
        self.log_all = self.log_own

    def over(self, longer: Level) -> None:
        """Weight this depth's estimate against the next one's."""
        parent = (longer.keys >> np.uint64(16) << np.uint64(8)) | (longer.keys & np.uint64(255))
        at = np.searchsorted(self.keys, parent)
        below = np.bincount(at, weights=longer.log_all, minlength=len(self.keys))
        self.log_all = np.logaddexp(self.log_own, below) - math.log(2)

    @property
    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.n + 1)

    @property
    def weight(self) -> np.ndarray:
        return np.exp(self.log_own - self.log_all) / 2


def _shorter(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs and counts without the farthest context byte."""
    keys = (runs >> np.uint64(16) << np.uint64(8)) | (runs & np.uint64(255))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


class Tree:
    """All contexts of ``least`` to ``depth`` bytes below the runs of one part; levels[d][bit]."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, depth: int, least: int):
        self.levels: dict[int, list[Level]] = {}
        for d in range(depth, least - 1, -1):
            self.levels[d] = [Level(runs, counts, bit) for bit in range(8)]
            if d < depth:
                for own, longer in zip(self.levels[d], self.levels[d + 1]):
                    own.over(longer)
            runs, counts = _shorter(runs, counts)
        self.shorter = runs, counts  # of depth least - 1
        self.depth, self.least = depth, least


def _top(sums: pd.DataFrame) -> list[list[tuple]]:
    """Depths 0 and 1 for all parts: by depth and bit (keys, estimate, weight, n).

    ``sums`` has (bit, key, below, n): bit 8 rows hold the counts of (last byte, byte); others the sum over longer
    contexts of log Pw at (last byte, bits above).
    """
    counts = sums[sums["bit"] == 8].sort_values("key")
    runs, n = counts["key"].to_numpy(dtype=np.uint64), counts["n"].to_numpy(dtype=np.int64)
    tree = Tree(runs, n, 1, 0)
    for bit, own in enumerate(tree.levels[1]):
        rows = sums[sums["bit"] == bit].sort_values("key")
        own.log_all = np.logaddexp(own.log_own, rows["below"].to_numpy()) - math.log(2)
    for own, longer in zip(tree.levels[0], tree.levels[1]):
        own.over(longer)
    return [[(x.keys, x.estimate, x.weight, x.n) for x in tree.levels[d]] for d in (0, 1)]


def _log10(runs: np.ndarray, tree: Tree, top: list[list[tuple]]) -> np.ndarray:
    """log10 probability of the byte of each run in its context."""
    out = np.zeros(len(runs))
    symbol = runs & np.uint64(255)
    for bit in range(8):
        one = (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1
        path = []  # (estimate, weight, seen) from depth 0 to the deepest
        for d in range(tree.depth + 1):
            keys, estimate, weight, n = top[d][bit] if d < 2 else (
                (x := tree.levels[d][bit]).keys, x.estimate, x.weight, x.n)
            context = runs >> np.uint64(8) >> np.uint64(8 * (tree.depth - d))
            at = np.searchsorted(keys, (context << np.uint64(8)) | (symbol >> np.uint64(8 - bit)))
            path.append((estimate[at], weight[at], n[at] > 0))
        for d in range(1, len(path)):  # a context never seen leaves it to the shorter one
            path[d] = (np.where(path[d][2], path[d][0], path[d - 1][0]), *path[d][1:])
        p = path[-1][0]
        for estimate, weight, _ in path[-2::-1]:
            p = weight * estimate + (1 - weight) * p
        out += np.log10(np.where(one, p, 1 - p))
    return out


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length) for each row of ``docs``.

    Documents whose crc32(id as text) leaves HELD_OUT modulo FOLDS are scored only, all others also train; a null id
    counts as the empty text, rows that repeat an id each count. A null text is empty: one end token, one end byte.
    ``score`` is the model's log10 probability of the text, ``code_length`` its bits per byte, the end included.
    Without training rows all estimates are 1/2. Words meet as 64-bit hashes. ``depth`` is 2 to 7 bytes.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    n_chunks, parts = sizes_of(docs, text)
    bits = parts.bit_length() - 1
    body = F.coalesce(F.col(text), F.lit(""))
    chunk = F.pmod(F.xxhash64(F.col(key), body), F.lit(n_chunks * CHUNK_SHARE))
    rows = docs.select(chunk.alias("chunk"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))

    def distinct(values: np.ndarray, bounds: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(values, return_inverse=True)
        return keys, np.bincount(at, weights=np.repeat(train, np.diff(bounds)), minlength=len(keys)).astype(np.int64)

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts = in_order(rows)
        train = np.array([not is_held_out(i) for i in ids])
        tokens, bounds = _tokens(texts)
        n = int(np.diff(bounds)[train].sum())
        chunk = int(rows["chunk"].iloc[0])
        out = [(chunk, TOTAL, 0, None, None, n), (chunk, TOTAL, 1, None, None, int(train.sum()))]
        for kind, (keys, counts) in ((TOKEN, distinct(tokens, bounds, train)), (RUN, distinct(*_runs(texts, depth), train))):
            order, edges = _by_part(keys, kind, depth, bits)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            for p in np.flatnonzero(np.diff(edges)):
                low, high = edges[p], edges[p + 1]
                out.append((chunk, kind, int(p), _pack_sorted(keys[low:high]), _pack(counts[low:high]), high - low))
        return pd.DataFrame(out, columns=["chunk", "kind", "part", "keys", "counts", "n"])

    sent = staged(rows.groupBy("chunk").applyInPandas(send, SENT), "context-runs")

    def merged(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        each = [_unpack_sorted(k) for k in rows["keys"]]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        weights = np.concatenate([_unpack(c, np.uint32) for c in rows["counts"]])
        return each, keys, np.bincount(at, weights=weights, minlength=len(keys)).astype(np.int64)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        """What the tree of a part adds to the contexts of one byte; of tokens, how many were seen in training."""
        _, keys, counts = merged(rows)
        if rows["kind"].iloc[0] == TOKEN:
            return pd.DataFrame({"bit": [9], "key": [0], "below": [0.0], "n": [int((counts > 0).sum())]})
        tree = Tree(keys, counts, depth, 2)
        out = []
        for bit, x in enumerate(tree.levels[2]):
            parent = (x.keys >> np.uint64(16) << np.uint64(8)) | (x.keys & np.uint64(255))
            ends, at = np.unique(parent, return_inverse=True)
            below = np.bincount(at, weights=x.log_all, minlength=len(ends))
            out.append(pd.DataFrame({"bit": bit, "key": ends.astype(np.int64), "below": below, "n": 0}))
        runs, n = tree.shorter
        out.append(pd.DataFrame({"bit": 8, "key": runs.astype(np.int64), "below": 0.0, "n": n}))
        return pd.concat(out)

    asked = sent.where(F.col("kind") != TOTAL)
    sums = asked.groupBy("kind", "part").applyInPandas(gather, "bit INT, key BIGINT, below DOUBLE, n BIGINT")
    sums = sums.groupBy("bit", "key").agg(F.sum("below").alias("below"), F.sum("n").alias("n")).toPandas()  # 2 x 256 x 256 rows
    totals = dict(sent.where(F.col("kind") == TOTAL).groupBy("part").agg(F.sum("n")).collect())
    ends = totals.get(1, 0)
    seen = int(sums[sums["bit"] == 9]["n"].sum()) + (ends > 0)
    train_tokens = totals.get(0, 0) + ends
    top = _top(sums) if (sums["bit"] == 8).any() else []

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        each, keys, counts = merged(rows)
        value = counts.astype(float) if rows["kind"].iloc[0] == TOKEN else _log10(keys, Tree(keys, counts, depth, 2), top)
        found = [value[np.searchsorted(keys, k)].tobytes() for k in each]
        return rows[["chunk", "kind", "part", "n"]].assign(found=found)[["chunk", "kind", "part", "found", "n"]]

    back = asked.groupBy("kind", "part").applyInPandas(answer, BACK)

    def values(kind: int, keyed: np.ndarray, held: pd.DataFrame) -> np.ndarray:
        """The returned value of each key of the chunk, one per occurrence."""
        keys, at = np.unique(keyed, return_inverse=True)
        order, _ = _by_part(keys, kind, depth, bits)
        held = held[held["kind"] == kind].sort_values("part")
        out = np.zeros(len(keys))
        if len(held):
            out[order] = np.concatenate([np.frombuffer(f) for f in held["found"]])
        return out[at]

    def finish(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, texts = in_order(rows)
        tokens, bounds = _tokens(texts)
        counts = values(TOKEN, tokens, held)
        total = math.log10(train_tokens + seen + 1)
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(ids)), n)
        base = np.bincount(owner, weights=np.log10(counts + 1) - total, minlength=len(ids))
        known = np.bincount(owner[counts > 0], minlength=len(ids))
        runs, places = _runs(texts, depth)
        score = np.add.reduceat(values(RUN, runs, held), places[:-1])
        out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64")})
        out["held_out"] = [is_held_out(i) for i in ids]
        out["n_tokens"] = n + 1
        out["n_known"] = known + (ends > 0)
        out["train_tokens"] = train_tokens
        out["base_score"] = base + math.log10(ends + 1) - total
        out["score"] = score
        out["code_length"] = -score / np.diff(places) / math.log10(2)
        return out

    schema = (
        "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE,"
        " score DOUBLE, code_length DOUBLE"
    )
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(finish, schema)
