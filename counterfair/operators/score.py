"""Model application on DataFrames: Column expressions for one layer, Arrow batches for networks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfair.functions.models import LogisticModel, MlpModel
from counterfair.functions.scalar import q
from counterfair.operators.expand import Domain
from counterfair.session import broadcast_if_small, cut_lineage

# Variants held in one matrix inside a task; 32k x 64 doubles is 16 MB.
MATRIX_ROWS = 32_768


def _matrix(parts: tuple[pd.Series, ...]) -> np.ndarray:
    return np.column_stack([p.to_numpy(dtype=float) for p in parts])


def array_udf(
    fn: Callable[[np.ndarray], np.ndarray], features: list[str], element: T.DataType = T.DoubleType()
) -> Column:
    """``fn(matrix) -> matrix`` as an array column, one Arrow batch at a time.

    A row with a NULL input has a NULL result.
    """

    @F.pandas_udf(T.ArrayType(element))
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            x = _matrix(parts)
            known = np.flatnonzero(~np.isnan(x).any(axis=1))
            out = [None] * len(x)
            for i, v in zip(known, fn(x[known]) if len(known) else ()):
                out[i] = v
            yield pd.Series(out, dtype=object)

    return apply(*[q(f) for f in features])


def number_udf(fn: Callable[[np.ndarray], np.ndarray], features: list[str]) -> Column:
    """``fn(matrix) -> vector`` as a DOUBLE column."""

    @F.pandas_udf(T.DoubleType())
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(fn(_matrix(parts)))

    return apply(*[q(f) for f in features])


def score_logistic(df: DataFrame, model: LogisticModel, out: str = "p") -> DataFrame:
    return df.withColumn(out, model.column())


def score_mlp(df: DataFrame, model: MlpModel, out: str = "p") -> DataFrame:
    return df.withColumn(out, number_udf(model.proba, list(model.features)))


def score(df: DataFrame, model, out: str = "p") -> DataFrame:
    """p(class 1) by whichever route the model offers."""
    if isinstance(model, LogisticModel):
        return score_logistic(df, model, out)
    return df.withColumn(out, number_udf(model.proba, list(model.features)))


def predict_class(p: Column) -> Column:
    """Class of a two-class score; the first class on ties."""
    return (p > 0.5).cast("int")


def accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    hits = F.avg((F.col(prediction) == F.col(label)).cast("int"))
    return df.agg(F.round(hits, 3).alias("accuracy"))


def input_gradient(df: DataFrame, model, out: str = "grad") -> DataFrame:
    return df.withColumn(out, array_udf(model.gradient, list(model.features)))


def pair_gradient_masked(
    df: DataFrame, model: MlpModel, others: list[str], layer: int, mask: list[int], out: str
) -> DataFrame:
    """Gradient between masked hidden vectors of a row and its partner (columns ``others``)."""
    width, keep = len(model.features), np.asarray(mask, dtype=float)

    def both(x: np.ndarray) -> np.ndarray:
        return model.pair_gradient(x[:, :width], x[:, width:], layer, keep)

    return df.withColumn(out, array_udf(both, [*model.features, *others]))


def layer_outputs(df: DataFrame, model: MlpModel, keys: list[str]) -> DataFrame:
    """(keys, layer, act): one row per hidden layer with its activation array."""
    width = [model.width(i + 1) for i in range(model.hidden_count)]

    def flat(x: np.ndarray) -> np.ndarray:
        return np.concatenate(model.activations(x)[:-1], axis=1)

    packed = df.select(*[q(k) for k in keys], array_udf(flat, list(model.features)).alias("_all"))
    starts = np.concatenate([[0], np.cumsum(width)[:-1]]).tolist()
    slices = F.array(
        *[
            F.struct(F.lit(i + 1).alias("layer"), F.slice("_all", int(s) + 1, int(w)).alias("act"))
            for i, (s, w) in enumerate(zip(starts, width))
        ]
    )
    return packed.select(*[q(k) for k in keys], F.inline(slices))


def layer_outputs_relational(df: DataFrame, weights: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, layer, neuron, act) by joins and sums over a ``weights(layer, i, j, w)`` table.

    The rows are partitioned by key once; every layer's sums then stay in place, because the weights
    are broadcast (after a count) and (key, neuron) groups are already together. ``layer_outputs``
    does the same without building a row per weight; this form needs no network object.
    """
    depth = weights.agg(F.max("layer")).first()[0]
    units = F.array(*[F.struct(F.lit(i).alias("i"), q(f).cast("double").alias("a")) for i, f in enumerate(features)])
    current = df.select(q(key).alias(key), F.inline(units)).repartition(key)
    outputs = []
    for number in range(1, depth + 1):
        here = weights.filter(F.col("layer") == number)
        links = broadcast_if_small(here.filter(F.col("i") >= 0).select("i", "j", "w"))
        bias = broadcast_if_small(here.filter(F.col("i") < 0).select("j", F.col("w").alias("b")))
        sums = current.join(links, "i").groupBy(key, "j").agg(F.sum(F.col("a") * F.col("w")).alias("s"))
        z = F.col("s") + F.col("b")
        act = z if number == depth else F.greatest(z, F.lit(0.0))
        layer = cut_lineage(sums.join(bias, "j").select(key, "j", act.alias("a")))
        outputs.append(layer.select(key, F.lit(number).alias("layer"), F.col("j").alias("neuron"), F.col("a").alias("act")))
        current = layer.withColumnRenamed("j", "i")
    result = outputs[0]
    for extra in outputs[1:]:
        result = result.unionByName(extra)
    return result


def variant_probabilities(df: DataFrame, model, domain: Domain, out: str = "pv") -> DataFrame:
    """Scores of all variants of a row as one array, in variant order.

    Variants never leave the row's task: expansion and scoring are one matrix step per Arrow batch.
    """
    features = list(model.features)
    return df.withColumn(out, array_udf(lambda x: variant_scores(x, features, model, domain), features))


def score_bins(p: np.ndarray, eps: float) -> np.ndarray:
    """Array form of ``functions.scalar.score_bin``: the last edge ``i * eps`` that is <= p."""
    bins = np.floor(p / eps)
    bins += (bins + 1) * eps <= p
    bins -= bins * eps > p
    return np.minimum(bins, bin_count(eps) - 1).astype(np.int64)


def bin_count(eps: float) -> int:
    return len(np.arange(0, 1, eps))


def distinct_bins(bins: np.ndarray, count: int) -> np.ndarray:
    """Number of distinct bins per row."""
    if count <= 63:
        return np.bitwise_count(np.bitwise_or.reduce(np.left_shift(np.int64(1), bins), axis=1))
    return (np.diff(np.sort(bins, axis=1), axis=1) > 0).sum(axis=1) + 1


def variant_bins(df: DataFrame, model, domain: Domain, eps: float = 0.025, out: str = "bins") -> DataFrame:
    """Score bins of all variants of a row as one array, in variant order."""
    features = list(model.features)

    def binned(x: np.ndarray) -> np.ndarray:
        return score_bins(variant_scores(x, features, model, domain), eps).astype(np.int32)

    return df.withColumn(out, array_udf(binned, features, T.IntegerType()))


def variant_chunks(x: np.ndarray, features: list[str], domain: Domain) -> Iterator[tuple[int, np.ndarray]]:
    """(rows, matrix) pieces of a batch with every row expanded over the domain.

    A piece holds at most ``MATRIX_ROWS`` variants (or one row's), whatever the batch size.
    """
    grid = domain.grid()
    slots = [features.index(n) for n in domain.names]
    chunk = max(1, MATRIX_ROWS // len(grid))
    for start in range(0, len(x), chunk):
        rows = x[start : start + chunk]
        wide = np.repeat(rows, len(grid), axis=0)
        wide[:, slots] = np.tile(grid, (len(rows), 1))
        yield len(rows), wide


def variant_scores(x: np.ndarray, features: list[str], model, domain: Domain) -> np.ndarray:
    parts = [model.proba(wide).reshape(n, domain.size) for n, wide in variant_chunks(x, features, domain)]
    return np.concatenate(parts) if parts else np.zeros((0, domain.size))


METRIC_FIELDS = [
    T.StructField("k", T.IntegerType()),
    T.StructField("spread", T.IntegerType()),
    T.StructField("sh_entropy", T.DoubleType()),
    T.StructField("p_min", T.DoubleType()),
    T.StructField("p_max", T.DoubleType()),
]


def row_metrics(df: DataFrame, model, domain: Domain, eps: float = 0.025) -> DataFrame:
    """Per row: K, bin spread, entropy and score range over all variants, in one narrow pass.

    The table is never expanded or shuffled; only five numbers per row leave the Arrow batch. A row with
    a NULL feature has NULL metrics.
    """
    features = list(model.features)
    schema = T.StructType([*df.schema.fields, *METRIC_FIELDS])
    width = bin_count(eps)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            unknown = np.isnan(x).any(axis=1)
            p = variant_scores(np.where(unknown[:, None], 0.0, x), features, model, domain)
            bins = score_bins(p, eps)
            cell = np.arange(len(p))[:, None] * width + bins
            counts = np.bincount(cell.ravel(), minlength=len(p) * width).reshape(len(p), width)
            share = counts / domain.size
            entropy = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
            extra = [
                pa.array((counts > 0).sum(axis=1), pa.int32(), mask=unknown),
                pa.array(bins.max(axis=1) - bins.min(axis=1), pa.int32(), mask=unknown),
                pa.array(entropy, pa.float64(), mask=unknown),
                pa.array(p.min(axis=1), pa.float64(), mask=unknown),
                pa.array(p.max(axis=1), pa.float64(), mask=unknown),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return df.mapInArrow(measure, schema)


def forced_metrics(
    df: DataFrame, model: MlpModel, domain: Domain, layer: int, forces: list[list[float]], eps: float = 0.025
) -> DataFrame:
    """K of every row with each neuron of one layer held at each constant: (…, force, neuron, k).

    ``forces[f][n]`` is the constant of force f for neuron n. Layers below are computed once.
    """
    features, count = list(model.features), bin_count(eps)
    cells = [(neuron, value) for values in forces for neuron, value in enumerate(values)]

    def grid_of(x: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, len(cells)))]
        for n, wide in variant_chunks(x, features, domain):
            hidden = model.activations(wide, layer)[-1]
            columns = [
                distinct_bins(score_bins(p.reshape(n, domain.size), eps), count).astype(float)
                for p in model.forced_probas(hidden, layer, cells)
            ]
            parts.append(np.stack(columns, axis=1))
        return np.concatenate(parts)

    width = len(forces[0])
    counted = df.withColumn("_k", array_udf(grid_of, features))
    return counted.select(*[q(c) for c in df.columns], F.posexplode("_k").alias("_cell", "_v")).select(
        *[q(c) for c in df.columns],
        F.floor(F.col("_cell") / width).cast("int").alias("force"),
        (F.col("_cell") % width).cast("int").alias("neuron"),
        F.col("_v").cast("int").alias("k"),
    )


def batch_totals(df: DataFrame, columns: list[str], fn: Callable[[np.ndarray], dict[str, np.ndarray]], cells: int, fields: list[str]) -> DataFrame:
    """(cell, fields…) partial results, one set of ``cells`` rows per Arrow batch.

    The map-side combine for wide per-row vectors: a batch sends its totals, not its rows.
    """
    schema = T.StructType(
        [T.StructField("cell", T.IntegerType()), *[T.StructField(f, T.DoubleType()) for f in fields]]
    )

    def reduce_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))])
            totals = fn(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(cells), pa.int32()), *[pa.array(totals[f], pa.float64()) for f in fields]],
                names=schema.names,
            )

    return df.select(*[q(c) for c in columns]).mapInArrow(reduce_batch, schema)


def forced_accuracy(df: DataFrame, model: MlpModel, label: str, layer: int, forces: list[list[float]]) -> DataFrame:
    """(force, neuron, acc): accuracy over the whole table with one neuron held at a constant."""
    width = len(forces[0])

    def hits(x: np.ndarray) -> dict[str, np.ndarray]:
        rows, truth = x[:, :-1], x[:, -1] > 0.5
        hidden = model.activations(rows, layer)[-1]
        cells = [(neuron, value) for values in forces for neuron, value in enumerate(values)]
        right = [float(((p > 0.5) == truth).sum()) for p in model.forced_probas(hidden, layer, cells)]
        return {"hit": np.array(right), "n": np.full(len(right), float(len(x)))}

    cells = batch_totals(df, [*model.features, label], hits, width * len(forces), ["hit", "n"])
    return cells.groupBy("cell").agg(F.round(F.sum("hit") / F.sum("n"), 3).alias("acc")).select(
        F.floor(F.col("cell") / width).cast("int").alias("force"),
        (F.col("cell") % width).cast("int").alias("neuron"),
        "acc",
    )
