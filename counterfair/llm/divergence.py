"""Source divergence audit: how far the word use of each source lies from every other source of its language.

A source's share of a term depends on the term's count alone, so the divergence of two sources is priced from their
joint table: how many terms have count level a in one and b in the other. One-hot columns for (source, level) over a
block of terms, multiplied by their transpose, give the joint tables of all pairs of sources at once; the products hold
counts below 2**24 and are exact in single precision. Blocks are priced where they are multiplied and only one number
per pair of sources leaves a block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterfair.llm.common import staged

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # in UTF-8: all but 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F
GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
PIECE = 1 << 20  # bytes of one text whose terms are held as a list
HELD_TERMS = 500_000  # distinct (group, term) counts held in a task before they are sent
CELLS = 1 << 18  # counts (terms x sources) of one block
ROWS, COLUMNS, LEAST_ROWS = 4096, 2048, 64  # terms and one-hot columns of one product
SOURCES = 256  # sources on the left side of one task's products
SHARDS = 32  # in which the first ranks of a source are found before they meet
COUNTS = "lang STRING, source STRING, term STRING, n BIGINT, docs BIGINT"
SUMS = "lang STRING, g INT, h INT, value BIGINT"


def term_lists(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a lowered text, piece by piece; pieces end between terms."""
    start = 0
    while start < len(data):
        end = len(data)
        if start + PIECE < end:
            gap = GAP.search(data, start + PIECE)
            end = gap.start() if gap else end
        yield TERM.findall(data, start, end)
        start = end


def _sent(held: dict) -> pa.RecordBatch:
    rows = [(*group, t, n, docs[t]) for group, (terms, docs) in held.items() for t, n in terms.items()]
    lang, source, term, n, docs = zip(*rows)
    return pa.record_batch(
        [pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        names=["lang", "source", "term", "n", "docs"],
    )


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen: set[bytes] = set()
            terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(terms)
            for found in term_lists(text.lower()):
                terms.update(found)
                seen.update(found)
            docs.update(seen)
            size += len(terms)
            if size >= HELD_TERMS:  # within a batch too: its texts may hold many times as many terms
                yield _sent(held)
                held, size = {}, 0
    if any(t for t, _ in held.values()):
        yield _sent(held)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; counted per task before the shuffle."""
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    counted = rows.mapInArrow(_count_terms, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(levels: np.ndarray, owners: np.ndarray, totals: list[int], terms: int, scale: int) -> np.ndarray:
    """Scaled share of each (source, level) column, in whole numbers of any size."""
    return np.array([1 + scale * (c + 1) // (totals[g] + terms) for g, c in zip(owners.tolist(), levels.tolist())], dtype=np.int64)


def pair_sums(counts: np.ndarray, low: int, high: int, totals: list[int], terms: int, scale: int) -> np.ndarray:
    """Divergence of sources ``low:high`` from all sources, over the terms of a block (counts: terms x sources)."""
    width = counts.shape[1]
    out = np.zeros((high - low, width), dtype=np.int64)
    counts = counts[np.argsort(counts.sum(axis=1), kind="stable")]  # terms of like counts share their levels
    start = 0
    while start < len(counts):
        rows = min(ROWS, len(counts) - start)
        while True:
            block = counts[start : start + rows]
            levels = [np.unique(block[:, g], return_inverse=True) for g in range(width)]
            if sum(len(v) for v, _ in levels) <= COLUMNS or rows <= LEAST_ROWS:
                break
            rows //= 2
        first = np.concatenate([[0], np.cumsum([len(v) for v, _ in levels])])
        place = np.arange(rows)
        tiles, at = [], 0
        while at < width:  # sources whose columns fit into one product
            end = at + 1
            while end < width and first[end + 1] - first[at] <= COLUMNS:
                end += 1
            tiles.append((at, end))
            at = end

        def columns(at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """One-hot columns of some sources, their shares and where each source begins."""
            begin = (first[at:end] - first[at]).astype(np.int64)
            hot = np.zeros((rows, first[end] - first[at]), dtype=np.float32)
            for g in range(at, end):
                hot[place, begin[g - at] + levels[g][1]] = 1
            owners = np.repeat(np.arange(at, end), np.diff(first[at : end + 1]))
            values = np.concatenate([levels[g][0] for g in range(at, end)])
            return hot, _shares(values, owners, totals, terms, scale), begin

        for a, b in tiles:
            a, b = max(a, low), min(b, high)
            if a >= b:
                continue
            hot, p, begin = columns(a, b)
            for c, d in tiles:
                other, q, other_begin = columns(c, d)
                joint = (hot.T @ other).astype(np.int64)
                gap = p[:, None] - q[None, :]
                joint *= gap * gap // q[None, :]
                out[a - low : b - low, c:d] += np.add.reduceat(np.add.reduceat(joint, begin, axis=0), other_begin, axis=1)
        start += rows
    return out


def source_divergence(
    docs: DataFrame,
    min_docs: int = 3,
    scale: int = 1_000_000_000,
    top: int = 200,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for
    the ``top`` terms that a source uses more than its language does.

    Terms are runs of letters (all but ASCII characters other than A-Z and a-z), A-Z lower-cased; a language keeps those
    that at least ``min_docs`` of its rows hold. With p = 1 + scale * (count + 1) // (all counts + kept terms) for a
    source, and q likewise for the other source or the whole language, a term's value is (p - q)**2 // q; a pair's
    value is the sum over all kept terms. Ranks go by value, descending, then by item.

    Null texts, languages and sources are empty strings. Each row is a document; ids are not read. A source without
    terms has zero counts; a language without kept terms has pairs of value 0 and no term rows. An empty table gives no rows.
    """
    groups = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))
    ).distinct()
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, text, lang, source).withColumns(
        {
            "held": F.sum("docs").over(term),
            "total": F.sum("n").over(term),
            "lead": F.row_number().over(term.orderBy("source")) == 1,
        }
    )
    kept = staged(counted.where(F.col("held") >= min_docs).select("lang", "source", "term", "n", "total", "lead"), "divergence-terms")
    of_lang = kept.groupBy("lang").agg(
        F.count_if("lead").alias("terms"), F.sum("n").alias("lang_total")
    )
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    numbered = (
        groups.join(of_source, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .na.fill(0, ["source_total", "terms", "lang_total"])
        .withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS)).cast("int"))
        .withColumn("tiles", F.ceil(F.col("sources") / SOURCES).cast("int"))
    )
    numbered = staged(numbered, "divergence-sources")
    return _pairs(kept, numbered, scale).unionByName(_terms(kept, numbered, scale, top))


def _pairs(kept: DataFrame, sources: DataFrame, scale: int) -> DataFrame:
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    entries = kept.join(sources.select("lang", "source", "g", "blocks", "tiles"), ["lang", "source"])
    entries = entries.select("lang", block, every_tile, "term", "g", "n")
    shape = sources.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tiles", "g", "source_total", "terms")
    shape = shape.select(F.col("lang").alias("lang"), "block", every_tile, F.col("g").alias("place"), *(F.col(c).alias(c) for c in ("source_total", "terms")))

    def multiply(rows: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
        shape = shape.sort_values("place")
        codes, names = pd.factorize(rows["term"])
        if len(names) == 0 or len(shape) == 1:
            return pd.DataFrame({c: np.zeros(0, dtype=object) for c in ("lang", "g", "h", "value")})
        counts = np.zeros((len(names), len(shape)), dtype=np.int64)
        counts[codes, rows["g"].to_numpy()] = rows["n"].to_numpy()
        low = int(shape["tile"].iloc[0]) * SOURCES
        high = min(low + SOURCES, len(shape))
        sums = pair_sums(counts, low, high, shape["source_total"].tolist(), int(shape["terms"].iloc[0]), scale)
        g, h = np.nonzero(np.arange(low, high)[:, None] != np.arange(len(shape))[None, :])
        return pd.DataFrame({"lang": shape["lang"].iloc[0], "g": g + low, "h": h, "value": sums[g, h]})

    by_block = ["lang", "block", "tile"]
    sums = entries.groupBy(by_block).cogroup(shape.groupBy(by_block)).applyInPandas(multiply, SUMS)
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    mine = sources.select("lang", "source", F.col("g").alias("i"))
    other = sources.select("lang", F.col("source").alias("item"), F.col("g").alias("j"))
    sums = sums.select("lang", F.col("g").alias("i"), F.col("h").alias("j"), "value")
    pairs = mine.join(other, "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")
    ).withColumn("rank", F.row_number().over(ranked))


def _terms(kept: DataFrame, sources: DataFrame, scale: int, top: int) -> DataFrame:
    share = "1 + (CAST({0} AS DECIMAL(18, 0)) * ({1} + 1)) div ({2} + terms)"
    used = kept.join(sources.select("lang", "source", "source_total", "lang_total", "terms"), ["lang", "source"])
    used = used.withColumn("p", F.expr(share.format(scale, "n", "source_total"))).withColumn("q", F.expr(share.format(scale, "total", "lang_total")))
    used = used.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = (F.desc("value"), "item")
    shard = Window.partitionBy("lang", "source", "shard").orderBy(*order)
    first = used.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(SHARDS))).withColumn("r", F.row_number().over(shard)).where(F.col("r") <= top)
    ranked = Window.partitionBy("lang", "source").orderBy(*order)
    return (
        first.select("lang", "source", F.lit("term").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )
