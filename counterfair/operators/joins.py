"""Joins of the search and reporting jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfair.functions.scalar import q
from counterfair.session import cut_lineage

PROBES = 6
SLICE = 1 << 13  # bytes of a filter sent at a time
SALTS = 32  # groups of tasks whose filters are joined first


def merge_on_keys(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Inner equi-join; non-key columns that clash get suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[q(c).alias(c + suffix if c in clash else c) for c in df.columns])

    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), keys, "inner")


def not_seen(candidates: DataFrame, key: list[str], order: list[str], *visited: DataFrame) -> DataFrame:
    """Candidates whose key is in none of the visited sets; the first by ``order`` for equal keys.

    Duplicates collapse by a partial aggregate before the shuffle, so a popular key costs one row per task.
    """
    rest = [c for c in candidates.columns if c not in key]
    order_key = F.struct(*[q(o) for o in order])
    fresh = candidates.groupBy(*[q(k) for k in key]).agg(F.min_by(F.struct(*[q(c) for c in rest]), order_key).alias("_r"))
    fresh = fresh.select(*[q(k) for k in key], *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    for seen in visited:
        fresh = fresh.join(seen.select(*[q(k) for k in key]), key, "left_anti")
    return fresh.select(*[q(c) for c in candidates.columns])


def not_seen_among_many(
    candidates: DataFrame, key: list[str], order: list[str], visited: DataFrame, max_bytes: int = 16 << 20
) -> DataFrame:
    """``not_seen`` where ``visited`` is far larger than the candidates that it may hold.

    Tasks set the bits of their visited keys in a Bloom filter of ten bits a key, filters are joined by a bitwise or, and
    candidates without all their bits are new for certain. Only the others go into the anti-join, and of the visited keys
    nothing but filters is shuffled until then. A filter beyond ``max_bytes`` is not built; the plain join does.
    """
    fresh = not_seen(candidates, key, order)
    kinds = {k: candidates.schema[k].dataType for k in key}
    bits = 1 << max(16, (10 * visited.count() - 1).bit_length())
    if bits > 8 * max_bytes:
        return not_seen(candidates, key, order, visited)

    def code(df: DataFrame) -> Column:
        """Equal keys have equal codes: the candidates' types, and one zero."""
        same = [q(k).try_cast(t) for k, t in kinds.items()]
        return F.xxhash64(*[c + F.lit(0.0) if isinstance(t, (T.DoubleType, T.FloatType)) else c for c, t in zip(same, kinds.values())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in _bit_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        slices = held.reshape(-1, SLICE)
        some = np.flatnonzero(slices.any(axis=1))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(np.full(len(some), salt), pa.int64()), pa.array([slices[i].tobytes() for i in some], pa.binary())],
            names=["slice", "salt", "bits"],
        )

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [joined.tobytes()]})

    built = visited.select(code(visited).alias("c")).mapInArrow(build, "slice BIGINT, salt BIGINT, bits BINARY")
    merged = built.groupBy("slice", "salt").applyInPandas(either, "slice BIGINT, bits BINARY")
    merged = merged.groupBy("slice").applyInPandas(either, "slice BIGINT, bits BINARY")
    whole = np.zeros((bits // 8 // SLICE, SLICE), dtype=np.uint8)
    for r in merged.toLocalIterator():  # ``max_bytes`` at most
        whole[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = candidates.sparkSession.sparkContext.broadcast(whole.ravel())

    @F.pandas_udf("boolean")
    def maybe(codes: pd.Series) -> pd.Series:
        held, found = shared.value, np.ones(len(codes), dtype=bool)
        for at in _bit_places(codes.to_numpy(), bits):
            found &= held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0
        return pd.Series(found)

    marked = cut_lineage(fresh.withColumn("_maybe", maybe(code(fresh))))
    new, open_ = marked.filter(~F.col("_maybe")).drop("_maybe"), marked.filter("_maybe").drop("_maybe")
    seen = visited.select(*[q(k) for k in key])
    return new.unionByName(open_.join(seen, key, "left_anti").select(*new.columns))


def _bit_places(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The PROBES bits of each code."""
    code = codes.astype(np.int64).view(np.uint64)
    step = (code >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (code + np.uint64(i) * step) & np.uint64(bits - 1)


def pair_by_position(messages: DataFrame, doc: str, pos: str, payload: list[str], first: int = 1) -> DataFrame:
    """Messages ``first``, ``first + 1`` are a pair, and so on: one row per pair with both payloads.

    The group is (document, pair number), two rows at most, so long documents spread over tasks.
    """
    numbered = messages.filter(q(pos) >= first).withColumn("pair_id", F.floor((q(pos) - first) / 2))
    odd = (q(pos) - first) % 2
    sides = [
        F.max(F.when(odd == side, F.struct(*[q(c) for c in payload]))).alias(name)
        for side, name in ((0, "original"), (1, "counterfactual"))
    ]
    return numbered.groupBy(doc, "pair_id").agg(*sides).filter(F.col("original").isNotNull())


def pair_turns(messages: DataFrame, doc: str, pos: str, role: str, text: str, first: str, second: str) -> DataFrame:
    """Each ``first`` message with the ``second`` message right after it, joined on (doc, position)."""
    asked = messages.filter(q(role) == first).select(doc, q(pos).alias(pos), q(text).alias("original"))
    answered = messages.filter(q(role) == second).select(doc, (q(pos) - 1).alias(pos), q(text).alias("counterfactual"))
    return asked.join(answered, [doc, pos])


def attach_by_key(grid: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Put per-key values (accuracy, K) onto every grid row."""
    return grid.join(values, keys)
