"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a document come from its whole text, for many documents at once. The trees are fitted on the labelled
documents, at most ``max_rows`` of them: those whose ids come first by md5, so that the choice depends on no order of
rows. Trees have equal depth and lie flattened in three arrays; a batch of documents walks down all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.llm.words import Words, chunks

MAX_ROWS = 50_000
FEATURES = (
    "bytes words lines mean_word mean_line upper digits symbols stops exclaim bars beyond_ascii spaces entropy"
    " distinct_words top_word distinct_pairs distinct_lines odd_ends upper_words"
).split()
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "symbols": b"#$%&*+/<=>@[\\]^_`{}~",
    "stops": b".,;:?'\"()-",
    "exclaim": b"!",
    "bars": b"|",
    "beyond_ascii": bytes(range(128, 256)),
    "spaces": b" \t\n\x0b\x0c\r",
}


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys, and how often the commonest occurs, by owner."""
    if len(keys) == 0:
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[starts], counts)
    return np.bincount(o[starts], minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; all are defined for the empty text."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    put = {name: out[:, i] for i, name in enumerate(FEATURES)}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    by_byte = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    size = np.maximum(sizes, 1)
    for name, members in _CLASSES.items():
        put[name][:] = by_byte[:, list(members)].sum(axis=1) / size
    share = by_byte / size[:, None]
    put["entropy"][:] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    put["bytes"][:] = np.log1p(sizes)

    w = Words([t.lower() for t in texts])
    n_words = np.diff(w.bounds)
    holder = np.repeat(np.arange(n), n_words)
    lengths = w.ends - w.starts
    words = np.maximum(n_words, 1)
    put["words"][:] = np.log1p(n_words)
    put["mean_word"][:] = np.bincount(holder, weights=lengths, minlength=n) / words
    distinct, most = _distinct(holder, w.hashes, n)
    put["distinct_words"][:], put["top_word"][:] = distinct / words, most / words
    same = holder[1:] == holder[:-1]
    pairs = w.hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[:-1]
    put["distinct_pairs"][:] = _distinct(holder[1:][same], pairs[same], n)[0] / np.maximum(n_words - 1, 1)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    if len(data):
        start = w.starts + first[holder]
        ends = data[w.ends - 1 + first[holder]]
        odd = np.isin(ends, np.frombuffer(_CLASSES["symbols"] + b"!|", dtype=np.uint8))
        put["odd_ends"][:] = np.bincount(holder, weights=odd, minlength=n) / words
        put["upper_words"][:] = (
            np.bincount(holder, weights=(data[start] >= 65) & (data[start] <= 90), minlength=n) / words
        )
    breaks = by_byte[:, 10]
    put["lines"][:] = np.log1p(breaks)
    put["mean_line"][:] = np.log1p(sizes / (breaks + 1))
    lines = [hash(x) for t in texts for x in t.split(b"\n")]
    held = np.repeat(np.arange(n), breaks.astype(np.int64) + 1)
    put["distinct_lines"][:] = _distinct(held, np.array(lines, dtype=np.int64), n)[0] / (breaks + 1)
    return out


@dataclass
class Trees:
    """Tree t has its inner nodes 1 .. 2**depth - 1 in row t of ``feature`` and ``cut``, its leaves in ``leaf``."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1 if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (1 << depth)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, damp: float = 5.0):
    """Boost logistic loss. Without rows, or with one class only, the score is the smoothed share of the label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        empty = np.zeros((0, 1 << depth))
        return Trees(base, empty.astype(np.int64), empty, empty)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # bin k: x <= edges[k]
    raw = np.full(len(y), base)
    feature = np.zeros((trees, 1 << depth), dtype=np.int64)
    cut = np.full((trees, 1 << depth), np.inf)
    leaf = np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = y - p, p * (1 - p)
        node = np.ones(len(y), dtype=np.int64)
        for level in range(depth):
            low, n = 1 << level, 1 << level
            best = np.zeros(n)
            at = node - low
            sums = [np.bincount(at, weights=v, minlength=n) for v in (gradient, hessian)]
            parent = sums[0] ** 2 / (sums[1] + damp)
            for j, e in enumerate(edges):
                if len(e) == 0:
                    continue
                cell = at * (bins + 1) + binned[j]
                g, h = (
                    np.bincount(cell, weights=v, minlength=n * (bins + 1)).reshape(n, bins + 1)[:, : len(e)].cumsum(axis=1)
                    for v in (gradient, hessian)
                )
                gain = g**2 / (h + damp) + (sums[0][:, None] - g) ** 2 / (sums[1][:, None] - h + damp) - parent[:, None]
                k = gain.argmax(axis=1)
                value = gain[np.arange(n), k]
                better = value > best + 1e-12
                best[better] = value[better]
                feature[t, low : low + n][better] = j
                cut[t, low : low + n][better] = e[k[better]]
            node = 2 * node + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - (1 << depth)
        g, h = (np.bincount(at, weights=v, minlength=1 << depth) for v in (gradient, hessian))
        leaf[t] = rate * g / (h + damp)
        raw += leaf[t, at]
    return Trees(base, feature, cut, leaf)


def _measured(docs: DataFrame, extra: list[str], extra_types: str, finish) -> DataFrame:
    """``finish(statistics, batch)`` for runs of rows of (text, *extra)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            for start, held in chunks(raw):
                yield finish(statistics(held), batch.slice(start, len(held)))

    return docs.select(F.col("text"), *extra).mapInArrow(run, extra_types)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Trees:
    """Fit on the labelled rows of ``docs`` (doc_id, text); ``labels`` has (doc_id, label), 0 or 1.

    Other labels, null ids and null labels are left out; an id with several labels has their rounded mean. The sample
    of at most ``max_rows`` labels bounds what is broadcast and what reaches the driver; repeated ids in ``docs`` all
    count, up to ``max_rows`` rows.
    """
    usable = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    sample = one.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    chosen = docs.join(F.broadcast(sample), "doc_id")

    def finish(x: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = pa.array(list(x), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], lists], names=["doc_id", "label", "x"])

    rows = _measured(chosen, ["doc_id", "label"], "doc_id BIGINT, label INT, x ARRAY<DOUBLE>", finish)
    found = rows.orderBy("doc_id").limit(max_rows).toArrow()
    x = np.array(found["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy().astype(float), **options)


def score(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """(row, score) for each row of ``docs``; a null text counts as empty. ``row`` is the whole input row."""
    import pyspark.sql.types as T

    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])

    def finish(x: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["row"], pa.array(model.score(x))], names=["row", "score"])

    return _measured(packed, ["row"], schema, finish)


def is_training(key: Column, folds: int = 5, held_out: int = 0) -> Column:
    """Whether crc32 of the id as text leaves another remainder than the held-out one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds != held_out
