"""Deterministic picks from a row's variants, samples and rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfair.functions.scalar import hash_int
from counterfair.operators.expand import Domain
from counterfair.operators.score import array_udf, score_bins, variant_scores


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    As generator output they are plain attributes, so the optimizer cannot copy their (interpreted)
    array expressions into every later use, such as the inputs of a Python scoring step.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


PICKS = ("k", "spread", "member", "partner", "low", "high")


def pick_variants(bins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(k, spread, member, partner, low, high) per row from its variants' bins.

    Member and partner come from the bin with the most variants (the first one met on ties), low from
    the lowest and high from the highest bin; the row's four hashes say which of the variants there.
    """
    rows = np.arange(len(bins))[:, None]
    counts = np.bincount((rows * (bins.max() + 1) + bins).ravel(), minlength=len(bins) * (bins.max() + 1))
    counts = counts.reshape(len(bins), -1)
    crowd = np.take_along_axis(counts, bins, axis=1)
    largest = np.take_along_axis(bins, crowd.argmax(axis=1)[:, None], axis=1)
    lowest, highest = bins.min(axis=1, keepdims=True), bins.max(axis=1, keepdims=True)

    def nth(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
        inside = bins == wanted
        return (np.cumsum(inside, axis=1) == (h % inside.sum(axis=1) + 1)[:, None]).argmax(axis=1)

    return np.stack(
        [
            (counts > 0).sum(axis=1),
            (highest - lowest)[:, 0],
            nth(largest, hashes[:, 0]),
            nth(largest, hashes[:, 1]),
            nth(lowest, hashes[:, 2]),
            nth(highest, hashes[:, 3]),
        ],
        axis=1,
    ).astype(np.int32)


def partition_picks(df: DataFrame, model, domain: Domain, eps: float, *parts: Column) -> DataFrame:
    """Add k, spread and the picked variant numbers member, partner, low and high.

    Scores, bins and picks are one step per Arrow batch; ``parts`` seed the hashes, which stay in the JVM.
    """
    features = list(model.features)
    tags = PICKS[2:]

    def picked(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(PICKS)), np.int32)
        scores = variant_scores(x[:, : len(features)], features, model, domain)
        return pick_variants(score_bins(scores, eps), x[:, len(features) :].astype(np.int64))

    hashed = df.withColumns({f"_h_{t}": hash_int(F.lit(t), *parts) for t in tags})
    chosen = hashed.withColumn("_picks", array_udf(picked, [*features, *[f"_h_{t}" for t in tags]], T.IntegerType()))
    return chosen.withColumns({n: F.col("_picks")[i] for i, n in enumerate(PICKS)}).drop(
        "_picks", *[f"_h_{t}" for t in tags]
    )


def max_difference_partner(pv: Column, own: Column) -> tuple[Column, Column]:
    """(partner, flips): first variant with another class, else the one with the largest change in the
    winning probability; -1 when no variant changes it. ``own`` is the row's variant number."""
    mine = F.element_at(pv, own + 1)
    numbered = F.transform(pv, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    flipped = F.filter(numbered, lambda e: (e["p"] > 0.5) != (mine > 0.5))
    top = F.greatest(mine, 1 - mine)
    changes = F.transform(
        F.filter(numbered, lambda e: e["i"] != own),
        lambda e: F.struct(F.abs(F.greatest(e["p"], 1 - e["p"]) - top).alias("d"), (-e["i"]).alias("i")),
    )
    best = F.array_max(changes)
    farthest = F.when(best["d"] > 0, -best["i"]).otherwise(F.lit(-1))
    flips = F.size(flipped) > 0
    return F.when(flips, F.try_element_at(flipped, F.lit(1))["i"]).otherwise(farthest).cast("int"), flips


def debug_sample(rows: DataFrame, row_id: str, n: int, seed: int = 0, top_share: float = 0.2) -> DataFrame:
    """``top_share`` of ``n`` with the highest K plus a uniform rest; a row may be in both parts."""
    top = int(n * top_share)
    best = rows.orderBy(F.desc("k"), row_id).limit(top).withColumn("part", F.lit("top"))
    rest = rows.orderBy(hash_int(F.lit(seed), F.col(row_id)), row_id).limit(int(n * (1 - top_share)))
    return best.unionByName(rest.withColumn("part", F.lit("random")))


def top_neurons(effects: DataFrame, count: int = 3) -> DataFrame:
    """(direction, place, neuron, effect): the strongest effects of each sign; NULL where missing."""
    direction = F.when(F.col("effect") < 0, "pos").when(F.col("effect") > 0, "neg")
    strength = F.abs("effect")
    signed = effects.withColumn("direction", direction).filter(F.col("direction").isNotNull())
    # A layer bounds the number of neurons, so each sign is a small window.
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(strength), F.desc("neuron")))
    ranked = signed.withColumn("place", place).filter(F.col("place") <= count)
    slots = effects.agg(F.lit(1)).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("direction"), F.lit(i).alias("place"))
                    for d in ("pos", "neg")
                    for i in range(1, count + 1)
                ]
            )
        )
    )
    return slots.join(ranked.select("direction", "place", "neuron", "effect"), ["direction", "place"], "left")
