"""Projection, filtering, cleaning and encoding of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import clipped, number, q
from counterfair.session import SMALL_BYTES, broadcast_if_small

Bounds = dict[str, tuple[int, int]]


def drop_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[q(n) for n in names])


def keep_cols(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns on the allow-list, in table order; names the table lacks are ignored."""
    wanted = set(names)
    return df.select(*[q(c) for c in df.columns if c in wanted])


def label_last(df: DataFrame, target: str) -> DataFrame:
    """Move the target column to the end; it is an error if it is absent."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.select(*[q(c) for c in df.columns if c != target], q(target))


def binarize_threshold(
    col: Column, threshold: int = 40, high: str = "old", low: str = "young", negated: bool = False
) -> Column:
    """``high`` from the threshold on. The negated form flips the sign first; blank or bad is ``high``."""
    if not negated:
        return F.when(col.cast("int") >= threshold, high).otherwise(low)
    value = -F.expr("1") * col.cast("string").try_cast("int")
    return F.when(F.coalesce(value, F.lit(threshold)) >= threshold, high).otherwise(low)


def equal_width_bin(df: DataFrame, name: str, bins: int, out: str | None = None) -> DataFrame:
    """Right-closed equal-width bins 1..n over the column's range.

    Minimum and maximum come in as scalar subqueries, so the table itself is not joined.
    """
    low = df.agg(F.min(q(name)).cast("double")).scalar()
    high = df.agg(F.max(q(name)).cast("double")).scalar()
    width = (high - low) / F.lit(float(bins))
    code = F.ceil((q(name).cast("double") - low) / width)
    return df.withColumn(out or name, F.when(high == low, 1).otherwise(clipped(code, 1, bins)).cast("int"))


def label_encoder(df: DataFrame, name: str) -> DataFrame:
    """(value, code): dense codes by sorted value, computed over the distinct values only.

    The values are written once, so later joins read them instead of the table. ``profile.column_codes`` codes many
    columns at once.
    """
    from counterfair.operators.profile import dense_codes

    return dense_codes(df.select(q(name).alias("value")).filter(F.col("value").isNotNull()).distinct())


def encode_columns(df: DataFrame, codes: DataFrame, names: list[str]) -> DataFrame:
    """Replace the values of many columns by their codes of (col, value, code); an unknown value becomes NULL."""
    width = F.sum(F.octet_length("value") + 16)
    sizes = {r["col"]: r["b"] for r in codes.groupBy("col").agg(width.alias("b")).collect()}  # one row per column
    for i, n in enumerate(names):
        side = codes.filter(F.col("col") == n).select(F.col("value").alias("_value"), F.col("code").alias(f"_code{i}"))
        side = F.broadcast(side) if sizes.get(n, 0) <= SMALL_BYTES else side
        df = df.join(side, q(n).cast("string") == F.col("_value"), "left").drop("_value")
    coded = {n: F.col(f"_code{i}") for i, n in enumerate(names)}
    return df.withColumns(coded).drop(*[f"_code{i}" for i in range(len(names))])


def label_encode(df: DataFrame, name: str, encoder: DataFrame, out: str | None = None) -> DataFrame:
    """Replace values by codes (BIGINT); a value the encoder does not know becomes NULL."""
    side = broadcast_if_small(encoder.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    coded = df.join(side, q(name) == F.col("_value"), "left").drop("_value")
    return coded.withColumn(out or name, F.col("_code").cast("bigint")).drop("_code")


def label_decode(df: DataFrame, name: str, encoder: DataFrame, out: str | None = None) -> DataFrame:
    """Replace codes by values."""
    side = broadcast_if_small(encoder.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    named = df.join(side, q(name) == F.col("_code"), "left").drop("_code")
    return named.withColumn(out or name, F.col("_value")).drop("_value")


def dict_encode(col: Column, mapping: dict[str, int]) -> Column:
    """Fixed dictionary lookup; unknown is NULL."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


def enum_encode(col: Column, values: list[str]) -> Column:
    """Position in a fixed list; an unknown value is an error when the row is read."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), col).cast("int") - 1
    return F.when(position >= 0, position).otherwise(
        F.raise_error(F.concat(F.lit("value not in list: "), F.coalesce(col, F.lit("NULL")))).cast("int")
    )


def scale_clip(col: Column, scale: float, low: int, high: int) -> Column:
    """Scale, clip, truncate toward zero."""
    return clipped(col.cast("double") / F.lit(float(scale)), float(low), float(high)).cast("int")


def sentinel_flag(col: Column, sentinel: int = -1) -> Column:
    return (col.cast("int") == sentinel).cast("int")


def shift_codes(df: DataFrame, names: list[str], by: int = 1) -> DataFrame:
    return df.withColumns({n: q(n) + by for n in names})


def binarize_label(col: Column, threshold: float = 10) -> Column:
    return (col >= threshold).cast("int")


def mean_impute(df: DataFrame, names: list[str]) -> DataFrame:
    """Blank or non-numeric becomes NULL, then the column mean (one aggregate over all columns)."""
    numeric = {n: number(q(n).cast("string")) for n in names}
    means = df.agg(F.struct(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(numeric.values())])).scalar()
    return df.withColumns({n: F.coalesce(v, means[f"m{i}"]) for i, (n, v) in enumerate(numeric.items())})


def clip_to_bounds(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.withColumns({c: clipped(q(c), lo, hi) for c, (lo, hi) in bounds.items()})


def out_of_bounds(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows that ``clip_to_bounds`` would change."""
    changed = F.lit(False)
    for c, (lo, hi) in bounds.items():
        changed = changed | (q(c) < lo) | (q(c) > hi)
    return df.filter(changed)


def one_hot_label(label: Column) -> Column:
    """0 -> [1, 0], anything else -> [0, 1]."""
    hit = (label != 0).cast("int")
    return F.array(1 - hit, hit)


def mask_protected(df: DataFrame, protected: list[str], drop: bool = False) -> DataFrame:
    """Protected columns set to 0, or removed: the key under which rows count as the same."""
    return df.drop(*protected) if drop else df.withColumns({c: F.lit(0) for c in protected})


def parse_key_values(text: Column, keys: list[str]) -> list[Column]:
    """Columns from ``Key: value`` lines; a missing key is NULL, of a repeated key the last line counts."""

    def entry(line: Column) -> Column:
        at = F.locate(":", line)
        value = F.when(at > 0, F.trim(F.substr(line, at + 1)))
        return F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), value.alias("v"))

    entries = F.transform(F.split(text, "\n"), entry)

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"].alias(key)

    return [last(k) for k in keys]


def column_difference(columns: list[str], protected: list[str]) -> list[str]:
    """All columns minus the protected ones, in order."""
    left_out = set(protected)
    return [c for c in columns if c not in left_out]


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def distinct_keys(df: DataFrame, protected: list[str]) -> DataFrame:
    return mask_protected(df, protected).dropDuplicates()
