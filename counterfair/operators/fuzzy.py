"""Closest choices: for each value the choice that holds the part with the fewest edits to it.

Choices are rows, never a list. Each of a value's grams of GRAM letters that an edit touches is lost, so k edits leave
one of any k * GRAM + 1 of them whole: the rarest of a value's grams lead, through an inverted index, to all choices
within that many edits. What they find is decided by a bit-parallel automaton over substrings (one machine word per
value, one step per letter of the choice, many pairs at once). Values that no such choice settles, those without rare
grams among them, meet all choices in blocks, and the best of all blocks counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfair.session import cut_lineage, is_small

GRAM = 3
EDITS = 2  # that the index covers
CHOICES, VALUES = 8192, 4096  # of one block of comparisons
WORD = 64


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, padded to one length, and the lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), -1, dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _automaton(equal: Iterator[np.ndarray], live: Iterator[np.ndarray], size: np.ndarray, n: int) -> np.ndarray:
    """Fewest edits between values of ``size`` letters (64 at most) and any part of n texts, read letter by letter.

    ``equal`` gives for each step the places of the value that hold the text's letter, as bits; ``live`` which texts
    still have one. A column of the edit table is kept as its vertical differences, up in one word and down in another.
    """
    one = np.uint64(1)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    size = np.broadcast_to(size, n)
    top = np.where(size > 0, one << (np.maximum(size, 1) - 1).astype(np.uint64), np.uint64(0))
    score = size.astype(np.int64).copy()
    best = score.copy()
    for eq, on in zip(equal, live):
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(across | up), up & across
        score += ((rise & top) != 0) & on
        score -= ((fall & top) != 0) & on
        rise, fall = rise << one, fall << one  # a match may begin anywhere, so the first row stays 0
        up, down = np.where(on, fall | ~(vertical | rise), up), np.where(on, rise & vertical, down)
        np.minimum(best, score, out=best)
    return best


def _one_distance(value: str, text: str) -> int:
    """The same automaton for one pair, in a whole number as wide as the value."""
    if not value:
        return 0
    full, top, places = (1 << len(value)) - 1, 1 << (len(value) - 1), {}
    for i, c in enumerate(value):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, len(value)
    best = score
    for c in text:
        eq = places.get(c, 0)
        vertical, across = eq | down, (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = (fall | ~(vertical | rise)) & full, rise & vertical
        best = min(best, score)
    return best


def pair_distances(values: list[str], texts: list[str]) -> np.ndarray:
    """Fewest edits that turn each value into some part (the empty one, too) of the text beside it."""
    out = np.zeros(len(values), dtype=np.int64)
    short = np.array([len(v) <= WORD for v in values], dtype=bool)
    for i in np.flatnonzero(~short).tolist():
        out[i] = _one_distance(values[i], texts[i])
    rows = np.flatnonzero(short)
    if len(rows) == 0:
        return out
    value, size = letters([values[i] for i in rows])
    text, length = letters([texts[i] for i in rows])
    bits = np.uint64(1) << np.arange(value.shape[1], dtype=np.uint64)

    def equal() -> Iterator[np.ndarray]:
        for j in range(text.shape[1]):
            yield ((value == text[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)

    out[rows] = _automaton(equal(), (j < length for j in range(text.shape[1])), size, len(rows))
    return out


def value_distances(value: str, text: np.ndarray, length: np.ndarray, texts: list[str]) -> np.ndarray:
    """As ``pair_distances`` for one value against many texts (also given as ``letters``)."""
    if len(value) > WORD:
        return np.array([_one_distance(value, t) for t in texts], dtype=np.int64)
    alphabet, places = np.unique(np.array([ord(c) for c in value], dtype=np.int64)), {}
    for i, c in enumerate(value):
        places[ord(c)] = places.get(ord(c), 0) | 1 << i
    bits = np.array([places[c] for c in alphabet.tolist()] or [0], dtype=np.uint64)
    if len(alphabet) == 0:
        return np.zeros(len(texts), dtype=np.int64)

    def equal() -> Iterator[np.ndarray]:
        for j in range(text.shape[1]):
            at = np.minimum(np.searchsorted(alphabet, text[:, j]), len(alphabet) - 1)
            yield np.where(alphabet[at] == text[:, j], bits[at], np.uint64(0))

    return _automaton(equal(), (j < length for j in range(text.shape[1])), np.array(len(value)), len(texts))


def _grams(text: Column) -> Column:
    """All runs of GRAM letters, in order."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    cut = F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.char_length(text) >= GRAM, cut).otherwise(F.array().cast("array<string>"))


def _best(rows: DataFrame) -> DataFrame:
    """The choice with the fewest edits for each (col, value), the first in order on ties."""
    best = F.min(F.struct("d", F.col("choice").alias("closest"), "code"))
    return rows.groupBy("col", "value").agg(best.alias("b")).select("col", "value", "b.*")


def _indexed(values: DataFrame, choices: DataFrame) -> DataFrame:
    """(col, value, d, closest, code) where the rarest grams of a value lead to its closest choice for certain."""
    index = choices.select("col", "choice", "code", F.explode(F.array_distinct(_grams(F.col("choice")))).alias("g"))
    held = index.groupBy("col", "g").agg(F.count("*").alias("held"))
    total = choices.groupBy("col").agg(F.count("*").alias("total"))
    grams = values.where(F.char_length("value") >= GRAM).select("col", "value", F.posexplode(_grams(F.col("value"))).alias("at", "g"))
    edits = F.least(F.lit(EDITS), F.floor((F.char_length("value") - GRAM) / GRAM)).cast("int")
    probes = grams.join(held, ["col", "g"], "left").withColumns({"held": F.coalesce("held", F.lit(0)), "edits": edits})
    rarest = Window.partitionBy("col", "value").orderBy("held", "at")
    probes = probes.withColumn("r", F.row_number().over(rarest)).where(f"r <= edits * {GRAM} + 1")
    # Where the grams lead to a quarter of all choices or more, comparing with all is as cheap.
    cost = F.sum("held").over(Window.partitionBy("col", "value"))
    probes = probes.withColumn("cost", cost).join(total, "col").where("cost * 4 < total AND held > 0")
    probes = probes.select("col", "value", "edits", "g").distinct()
    pairs = probes.join(index, ["col", "g"]).select("col", "value", "edits", "choice", "code").distinct()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pair_distances(batch["value"].to_pylist(), batch["choice"].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int64())], names=[*batch.schema.names, "d"])

    code = choices.schema["code"].dataType.simpleString()
    decided = pairs.mapInArrow(decide, f"col STRING, value STRING, edits INT, choice STRING, code {code}, d BIGINT")
    return _best(decided.where("d <= edits"))


def _compared(values: DataFrame, choices: DataFrame, max_errors: int) -> DataFrame:
    """(col, value, d, closest, code): each value against all choices of its column, block by block."""
    blocks, crowds = (max(1, -(-x.count() // size)) for x, size in ((choices, CHOICES), (values, VALUES)))

    def dealt(rows: DataFrame, name: str, own: int, other: int) -> DataFrame:
        """Rows dealt into their own blocks, once for each block of the other side."""
        own_block = F.pmod(F.xxhash64(name), F.lit(own)).cast("int")
        return rows.select(*rows.columns, own_block.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("_other"))

    left = dealt(values, "value", crowds, blocks).select(F.col("col").alias("col"), F.col("_own").alias("x"), F.col("_other").alias("y"), "value")
    right = dealt(choices, "choice", blocks, crowds).select(F.col("col").alias("col"), F.col("_other").alias("x"), F.col("_own").alias("y"), "choice", "code")

    def compare(values: pd.DataFrame, choices: pd.DataFrame) -> pd.DataFrame:
        if len(values) == 0 or len(choices) == 0:
            return pd.DataFrame({c: np.zeros(0, dtype=object) for c in ("col", "value", "d", "choice", "code")})
        choices = choices.sort_values("choice", kind="stable")
        texts = choices["choice"].tolist()
        text, length = letters(texts)
        found = []
        for value in values["value"].tolist():
            d = value_distances(value, text, length, texts)
            at = int(d.argmin())
            if d[at] <= max_errors:
                found.append((values["col"].iloc[0], value, int(d[at]), texts[at], choices["code"].iloc[at]))
        return pd.DataFrame(found, columns=["col", "value", "d", "choice", "code"])

    code = choices.schema["code"].dataType.simpleString()
    by_block = ["col", "x", "y"]
    compared = left.groupBy(by_block).cogroup(right.groupBy(by_block))
    return _best(compared.applyInPandas(compare, f"col STRING, value STRING, d BIGINT, choice STRING, code {code}"))


def closest_values(values: DataFrame, encoder: DataFrame, max_errors: int = 10) -> DataFrame:
    """(col, value, closest, code) for each distinct (col, value).

    ``encoder`` is (col, value, code), the choices. A choice's distance is the fewest edits that turn the value into some
    part of it, the empty part included; the smallest counts, on ties the first choice in order; ``closest`` is NULL
    where none is within ``max_errors``, and for NULL values and columns without choices.
    """
    wanted = values.select(F.col("col").cast("string").alias("col"), F.col("value").cast("string").alias("value")).distinct()
    wanted = cut_lineage(wanted)
    choices = encoder.select(F.col("col").cast("string").alias("col"), F.col("value").cast("string").alias("choice"), "code")
    choices = cut_lineage(choices.where(F.col("choice").isNotNull() & F.col("col").isNotNull()))
    known = wanted.where(F.col("value").isNotNull() & F.col("col").isNotNull())
    found, rest = None, known
    if not is_small(choices, CHOICES):
        found = cut_lineage(_indexed(known, choices).where(F.col("d") <= max_errors))
        rest = known.join(found, ["col", "value"], "left_anti")
    compared = _compared(cut_lineage(rest) if found is not None else rest, choices, max_errors)
    best = (found.unionByName(compared) if found is not None else compared).select("col", "value", "closest", "code")
    return wanted.join(best, ["col", "value"], "left")
