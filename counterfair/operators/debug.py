"""Localising bias to a layer and its neurons."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfair.functions.models import MlpModel
from counterfair.functions.scalar import q
from counterfair.operators.expand import Domain
from counterfair.operators.joins import attach_by_key
from counterfair.operators.picks import debug_sample, top_neurons
from counterfair.operators.score import (
    array_udf,
    batch_totals,
    forced_accuracy,
    forced_metrics,
    number_udf,
    variant_chunks,
)
from counterfair.session import broadcast_if_small, cut_lineage

RATE_EPSILON = 1e-7
PIVOTS = 3
PAIRS = 1 << 15  # compared at a time


def widest_pair(a: np.ndarray, pivots: int = PIVOTS) -> tuple[np.ndarray, int]:
    """Per row of (rows x variants x units), the largest mean absolute difference of two variants; comparisons made.

    The distances of all variants to a few pivots, each the variant farthest from the one before, bound every pair: it
    is no farther apart than the two are from a pivot together. Only pairs whose bound exceeds the best so far are compared;
    the pair with the largest bound goes first.
    """
    n, size, _ = a.shape
    if size < 2 or n == 0:
        return np.zeros(n), 0
    rows, left, right = np.arange(n), *np.triu_indices(size, 1)
    best, bound, at, made = np.zeros(n), np.full((n, len(left)), np.inf), np.zeros(n, dtype=np.int64), 0
    for _ in range(min(pivots, size)):
        away = np.abs(a - a[rows, at][:, None]).mean(axis=2)
        made += n * (size - 1)
        best = np.maximum(best, away.max(axis=1))
        np.minimum(bound, away[:, left] + away[:, right], out=bound)
        at = away.argmax(axis=1)

    def compare(row: np.ndarray, pair: np.ndarray) -> None:
        for s in range(0, len(row), PAIRS):
            r, p = row[s : s + PAIRS], pair[s : s + PAIRS]
            np.maximum.at(best, r, np.abs(a[r, left[p]] - a[r, right[p]]).mean(axis=1))

    first = bound.argmax(axis=1)
    open_ = np.flatnonzero(bound[rows, first] > best)
    compare(open_, first[open_])
    bound[rows, first] = -1.0
    row, pair = np.nonzero(bound > best[:, None])
    compare(row, pair)
    return best, made + len(open_) + len(row)


def pairwise_max_distance(df: DataFrame, model: MlpModel, domain: Domain, out: str = "distance") -> DataFrame:
    """Per hidden layer, the largest mean absolute difference between activations of two variants.

    A row's variants are compared inside its Arrow batch; no pair ever becomes a table row.
    """
    features, size = list(model.features), domain.size

    def distances(x: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, model.hidden_count))]
        for n, wide in variant_chunks(x, features, domain):
            acts = model.activations(wide)[:-1]
            parts.append(np.stack([widest_pair(act.reshape(n, size, -1))[0] for act in acts], axis=1))
        return np.concatenate(parts)

    return df.withColumn(out, array_udf(distances, features))


def group_max_distance(df: DataFrame, group: str, dims: list[Column]) -> DataFrame:
    """(group, distance): the largest mean absolute difference of two vectors of an unbounded group.

    The L1 diameter is the widest range of any signed sum of the coordinates, so minima and maxima of
    2^(d-1) projections give it exactly, without pairs and with map-side combine. For few dimensions.
    """
    signs = [(1, *rest) for rest in product((1, -1), repeat=len(dims) - 1)]
    sums = []
    for s in signs:
        total = F.lit(0.0)
        for sign, dim in zip(s, dims):
            total = total + dim.cast("double") if sign > 0 else total - dim.cast("double")
        sums.append(total)
    wide = df.select(q(group).alias(group), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    ranges = [F.max(f"s{i}") - F.min(f"s{i}") for i in range(len(signs))]
    widest = F.greatest(*ranges) if len(ranges) > 1 else ranges[0]
    return wide.groupBy(group).agg((widest / len(dims)).alias("distance"))


def layer_change_rate(distance: Column) -> Column:
    """(d - max earlier d) / (max earlier d + 1e-7) for each layer of a distance array."""
    def rate(d, i):
        earlier = F.when(i > 0, F.array_max(F.slice(distance, 1, i))).otherwise(F.lit(0.0))
        return (d - earlier) / (earlier + RATE_EPSILON)

    return F.transform(distance, rate)


def biased_layer(rated: DataFrame, rate: str = "rate") -> DataFrame:
    """(layer, layer_rate): mode over rows of each row's steepest layer (the first layer is left out),
    and the mean of the row maxima. Ties go to the lower layer."""
    later = F.slice(rate, 2, F.size(rate) - 1)
    best = F.array_max(later)
    layer = (F.array_position(later, best) + 1).cast("int")
    per_row = rated.select(layer.alias("layer"), best.alias("best"))
    return per_row.agg(F.mode("layer", True).alias("layer"), F.avg("best").alias("layer_rate"))


def neuron_stats(df: DataFrame, model: MlpModel) -> DataFrame:
    """(layer, neuron, act_min, act_mean) over the whole table, pre-aggregated per Arrow batch."""
    widths = [model.width(i + 1) for i in range(model.hidden_count)]

    def totals(x: np.ndarray) -> dict[str, np.ndarray]:
        acts = np.concatenate(model.activations(x)[:-1], axis=1)
        return {"low": acts.min(axis=0), "sum": acts.sum(axis=0), "n": np.full(acts.shape[1], float(len(x)))}

    cells = batch_totals(df, list(model.features), totals, sum(widths), ["low", "sum", "n"])
    places = [(layer + 1, neuron) for layer, w in enumerate(widths) for neuron in range(w)]
    layer_of = F.array(*[F.lit(p[0]) for p in places])
    neuron_of = F.array(*[F.lit(p[1]) for p in places])
    return cells.groupBy("cell").agg(
        F.min("low").alias("act_min"), (F.sum("sum") / F.sum("n")).alias("act_mean")
    ).select(
        F.element_at(layer_of, F.col("cell") + 1).alias("layer"),
        F.element_at(neuron_of, F.col("cell") + 1).alias("neuron"),
        "act_min",
        "act_mean",
    )


def neuron_stats_long(activations: DataFrame) -> DataFrame:
    """The same from a stored (layer, act ARRAY) table."""
    long = activations.select("layer", F.posexplode("act").alias("neuron", "a"))
    return long.groupBy("layer", "neuron").agg(F.min("a").alias("act_min"), F.avg("a").alias("act_mean"))


def neuron_scores(df: DataFrame, model: MlpModel, layer: int, protected: str, low: int, high: int) -> DataFrame:
    """(neuron, score): mean of |a(x)| + |a(flipped x)| per neuron of one layer."""
    features = list(model.features)
    slot = features.index(protected)

    def totals(x: np.ndarray) -> dict[str, np.ndarray]:
        other = x.copy()
        other[:, slot] = np.where(x[:, slot] == low, high, low)
        both = np.abs(model.activations(x, layer)[-1]) + np.abs(model.activations(other, layer)[-1])
        return {"sum": both.sum(axis=0), "n": np.full(both.shape[1], float(len(x)))}

    cells = batch_totals(df, features, totals, model.width(layer), ["sum", "n"])
    return cells.groupBy("cell").agg((F.sum("sum") / F.sum("n")).alias("score")).withColumnRenamed("cell", "neuron")


def neuron_mask(scores: DataFrame, width: int, alpha: float = 0.5, digits: int = 9) -> DataFrame:
    """(neuron, score, mask): 1 for scores at or above the m-th largest, m = max(floor(alpha n) - 1, 0) + 1."""
    m = max(int(alpha * width) - 1, 0) + 1
    fine = scores.withColumn("score", F.round("score", digits))
    # One row per neuron of a layer: a single small window.
    ranked = fine.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"))))
    threshold = ranked.filter(F.col("_r") == m).select("score").scalar()
    return fine.withColumn("mask", (F.col("score") >= threshold).cast("int"))


def neuron_effect(grid: DataFrame, base_accuracy: float, tolerance: float = 0.05) -> DataFrame:
    """(neuron, effect): relative K change when held at its mean minus that when held at its minimum.

    Only cells that keep the accuracy within ``tolerance`` of the base count.
    """
    kept = F.col("acc") >= F.lit(base_accuracy) - F.lit(tolerance)
    means = grid.groupBy("neuron").agg(
        F.avg(F.when(kept & (F.col("force") == 0), F.col("k"))).alias("k_min"),
        F.avg(F.when(kept & (F.col("force") == 1), F.col("k"))).alias("k_mean"),
        F.avg(F.when(kept, F.col("init_k"))).alias("k_init"),
    )
    active = (F.col("k_mean") - F.col("k_init")) / F.col("k_init")
    inactive = (F.col("k_min") - F.col("k_init")) / F.col("k_init")
    return means.select("neuron", (active - inactive).alias("effect"))


def debug_report(grid: DataFrame, ranked: DataFrame, base_accuracy: float) -> DataFrame:
    """Accuracy and K before, with the worst neuron deactivated, with the best neuron activated."""
    def chosen(direction: str) -> Column:
        first = (F.col("direction") == direction) & (F.col("place") == 1)
        return ranked.filter(first).agg(F.max("neuron")).scalar()

    worst = (F.col("neuron") == chosen("neg")) & (F.col("force") == 0)
    best = (F.col("neuron") == chosen("pos")) & (F.col("force") == 1)
    return grid.agg(
        F.lit(base_accuracy).alias("a"),
        F.avg("init_k").alias("k"),
        F.avg(F.when(worst, F.col("acc"))).alias("a_deactivated"),
        F.avg(F.when(worst, F.col("k"))).alias("k_deactivated"),
        F.avg(F.when(best, F.col("acc"))).alias("a_activated"),
        F.avg(F.when(best, F.col("k"))).alias("k_activated"),
    )


def neuron_debug(
    rows: DataFrame,
    found: DataFrame,
    model: MlpModel,
    domain: Domain,
    row_id: str,
    label: str,
    samples: int = 1000,
    tolerance: float = 0.05,
    eps: float = 0.025,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Whole debugging run: sample, biased layer, force grid, effects, ranking and report.

    ``rows`` is the labelled table, ``found`` holds discriminatory rows with their K. ``row_id`` is a
    whole number; a row drawn twice counts as two samples.
    """
    features = list(model.features)
    sample = debug_sample(found, row_id, samples, seed).select(
        (q(row_id) * 2 + (F.col("part") == "random").cast("int")).alias("sample"),
        *[q(f) for f in features],
        F.col("k").alias("init_k"),
    )
    sample = sample.cache()
    rated = pairwise_max_distance(sample, model, domain).withColumn("rate", layer_change_rate(F.col("distance")))
    layer_row = biased_layer(rated)
    layer = layer_row.first()["layer"]
    stats = neuron_stats(rows, model).filter(F.col("layer") == layer).orderBy("neuron").collect()
    forces = [[s["act_min"] for s in stats], [s["act_mean"] for s in stats]]
    base = rows.agg(
        F.round(F.sum(_hit(model, label)) / F.count(F.lit(1)), 3).alias("acc")
    ).first()["acc"]
    grid = attach_by_key(
        forced_metrics(sample, model, domain, layer, forces, eps),
        broadcast_if_small(cut_lineage(forced_accuracy(rows, model, label, layer, forces))),
        ["force", "neuron"],
    ).select("sample", "force", "neuron", "k", "acc", "init_k")
    effects = cut_lineage(neuron_effect(grid, base, tolerance))
    ranked = top_neurons(effects)
    return {
        "layer": layer_row,
        "grid": grid,
        "effects": effects,
        "top": ranked,
        "report": debug_report(grid, ranked, base),
    }


def _hit(model: MlpModel, label: str) -> Column:
    return (((number_udf(model.proba, list(model.features)) > 0.5).cast("int")) == F.col(label)).cast("int")
