"""Column profiles: category detection, value lists, codes, bounds and the schema text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterfair.functions.scalar import number, q
from counterfair.session import broadcast_if_small, cut_lineage


def _unpivot(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[q(n).cast("string").alias(n) for n in names]).unpivot(
        [], [q(n) for n in names], "col", "value"
    )


def detect_categorical(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, categorical): 1 when some non-blank value is not a number; one aggregate over the table."""
    flags = []
    for n in names:
        text = q(n).cast("string")
        bad = number(text).isNull() & text.isNotNull() & (text != "")
        flags.append(F.max(bad.cast("int")).alias(n))
    return df.agg(*flags).unpivot([], [q(n) for n in names], "col", "categorical")


def category_values(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, value): distinct values of each column, long form."""
    return _unpivot(df, names).filter(F.col("value").isNotNull()).distinct()


def _placed(distinct: DataFrame, order: list[str]) -> DataFrame:
    """``distinct`` with ``_place``: 0, 1, ... in ``order``.

    Sorted by ranges and checkpointed; a row's place is its own in its range plus the sizes of the ranges before, one
    number per range.
    """
    ranged = cut_lineage(distinct.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.select(
        *distinct.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return ranged.join(broadcast_if_small(starts), "_part").select(
        *distinct.columns, (F.col("_first") + F.col("_at")).cast("bigint").alias("_place")
    )


def dense_codes(distinct: DataFrame) -> DataFrame:
    """(value, code BIGINT) by sorted value from a table of distinct values."""
    return _placed(distinct, ["value"]).select("value", F.col("_place").alias("code"))


def column_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, value, code BIGINT) for all columns from one scan of the table and one sort; values as text."""
    placed = _placed(category_values(df, names), ["col", "value"])
    first = placed.groupBy("col").agg(F.min("_place").alias("_from"))  # one row per column
    return placed.join(F.broadcast(first), "col").select("col", "value", (F.col("_place") - F.col("_from")).alias("code"))


def column_summary(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """For each column, from one aggregate over the table: categorical (some non-blank value is no number), bounds and mean."""
    aggs = []
    for i, n in enumerate(names):
        text = q(n).cast("string")
        v = number(text)
        bad = v.isNull() & text.isNotNull() & (text != "")
        aggs += [
            F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias(f"c{i}"),
            F.coalesce(F.floor(F.min(v)), F.lit(0)).cast("bigint").alias(f"l{i}"),
            F.coalesce(F.ceil(F.max(v)), F.lit(0)).cast("bigint").alias(f"h{i}"),
            F.avg(v).alias(f"m{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        n: {"categorical": row[f"c{i}"] == 1, "lo": row[f"l{i}"], "hi": row[f"h{i}"], "mean": row[f"m{i}"]}
        for i, n in enumerate(names)
    }


def column_bounds(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, lo, hi): floor of the minimum and ceiling of the maximum, [0, 0] if nothing is numeric."""
    aggs = []
    for n in names:
        v = number(q(n).cast("string"))
        aggs.append(
            F.struct(
                F.lit(n).alias("col"),
                F.coalesce(F.floor(F.min(v)), F.lit(0)).cast("bigint").alias("lo"),
                F.coalesce(F.ceil(F.max(v)), F.lit(0)).cast("bigint").alias("hi"),
            )
        )
    return df.agg(F.array(*aggs).alias("b")).select(F.inline("b"))


def bounds_dict(profile: DataFrame) -> dict[str, tuple[int, int]]:
    """Bounds as a driver-side dictionary: one entry per column of the table."""
    return {r["col"]: (int(r["lo"]), int(r["hi"])) for r in profile.select("col", "lo", "hi").collect()}


def column_profile(df: DataFrame, names: list[str], categorical: list[str]) -> DataFrame:
    """(col, pos, kind, lo, hi) for every feature column; the codes of a categorical one go from 0 to ``hi``."""
    numeric = [n for n in names if n not in set(categorical)]
    counts = category_values(df, categorical).groupBy("col").agg((F.count("*") - 1).alias("hi")) if categorical else None
    return shaped(names, {r["col"]: (r["lo"], r["hi"]) for r in column_bounds(df, numeric).collect()} if numeric else {}, counts, df)


def shaped(names: list[str], bounds: dict[str, tuple[int, int]], counts: DataFrame | None, df: DataFrame) -> DataFrame:
    """The profile of columns: numeric ones with their bounds, the others with ``counts`` (col, hi)."""
    rows = [(n, i, "numeric", *bounds[n]) for i, n in enumerate(names) if n in bounds]
    others = [(n, i, "categorical") for i, n in enumerate(names) if n not in bounds]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "col STRING, pos INT, kind STRING, lo BIGINT, hi BIGINT")
    if others:
        listed = spark.createDataFrame(others, "col STRING, pos INT, kind STRING").join(counts, "col", "left")
        table = table.unionByName(
            listed.select("col", "pos", "kind", F.lit(0).cast("bigint").alias("lo"), F.coalesce("hi", F.lit(-1)).cast("bigint").alias("hi"))
        )
    return table


# The wording of one attribute in the schema text.
NUMERIC_TEXT = " %s (numerical value, range is %d - %d)"
CATEGORICAL_TEXT = " %s (['%s'])"
AGE_TEXT = (
    " %s (categorical value, if the user is younger than 40 than they classify as young"
    " and if the user is older than 40 than they classify as old.)"
)


def schema_prompt(profile: DataFrame, values: DataFrame) -> DataFrame:
    """One row (attributes, template): every column with its values or range, and the JSON template.

    ``values`` is (col, value). The text names every value of the categorical columns, so here they are one list.
    """
    lists = values.groupBy("col").agg(F.array_sort(F.collect_list("value")).alias("values"))
    profile = profile.join(lists, "col", "left")
    listed = F.format_string(CATEGORICAL_TEXT, "col", F.array_join("values", "', '"))
    ranged = F.format_string(NUMERIC_TEXT, "col", "lo", "hi")
    text = (
        F.when(F.col("kind") == "categorical", listed)
        .when(F.lower("col") == "age", F.format_string(AGE_TEXT, "col"))
        .otherwise(ranged)
    )
    slot = F.format_string('"%s":...', "col")
    ordered = F.array_sort(F.collect_list(F.struct("pos", text.alias("text"), slot.alias("slot"))))
    packed = profile.agg(ordered.alias("p"))
    return packed.select(
        F.array_join(F.transform("p", lambda e: e["text"]), "").alias("attributes"),
        F.concat(F.lit("{"), F.array_join(F.transform("p", lambda e: e["slot"]), ", "), F.lit("}")).alias("template"),
    )
