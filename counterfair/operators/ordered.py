"""Running aggregates that survive a hot key.

A plain window sends one key to one task. When a key is too large for that, its rows are cut into ranges of the full
sort key, ties of the leading columns included: each range is scanned on its own, range totals (one row per range) are
scanned across the key, and the carry is joined back. Without hot keys it stays a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfair.session import cut_lineage

MAX_ROWS_PER_TASK = 1_000_000


def with_blocks(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], max_rows: int = MAX_ROWS_PER_TASK
) -> tuple[DataFrame, str | None]:
    """Add a block number per row: 0 for ordinary keys, ascending ranges of (keys, order) for hot ones.

    Returns the frame and the block column, or None when no key exceeds ``max_rows``.

    ``order`` is the sort key of the scans to come, of any types that can be ordered. Only rows that are equal in all of
    it must share a block. Ranges come from a sample, so the rows of hot keys are written once: both readings of a scan
    see the same blocks.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = cut_lineage(counts)  # at most one row per ``max_rows`` rows of the table
    total = hot.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not total:
        return df, None
    names = F.broadcast(hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    ranged = df.join(names, same, "left_semi").repartitionByRange(-(-2 * total // max_rows), *keys, *order)
    ranged = cut_lineage(ranged.withColumn("_block", F.spark_partition_id() + 1))
    rest = df.join(names, same, "left_anti").withColumn("_block", F.lit(0))
    return rest.unionByName(ranged), "_block"


def _frame(keys: Sequence[str], block: str | None, order: Sequence[str]):
    w = Window.partitionBy(*keys, *([block] if block else [])).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _carried(scanned: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_carry``, one row per key and block; NULL keys are keys like others."""
    names = [f"_c{i}" for i in range(len(by))]
    side = carry.select(*[F.col(c).alias(n) for c, n in zip(by, names)], "_carry")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)])
    return scanned.join(side, same).drop(*names)


def running_sum(
    df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], out: str, block: str | None
) -> DataFrame:
    """``sum(value)`` from the first row of the key up to this row."""
    keys = list(keys)
    scanned = df.withColumn("_v", value).withColumn(out, F.sum("_v").over(_frame(keys, block, order)))
    if block is None:
        return scanned.drop("_v")
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    return _carried(scanned, carry, [*keys, block]).withColumn(out, F.col(out) + F.col("_carry")).drop("_v", "_carry")


def running_last(
    df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], out: str, block: str | None
) -> DataFrame:
    """Last non-null ``value`` up to this row: a forward fill."""
    keys = list(keys)
    scanned = df.withColumn("_v", value)
    scanned = scanned.withColumn(out, F.last("_v", ignorenulls=True).over(_frame(keys, block, order)))
    if block is None:
        return scanned.drop("_v")
    position = F.struct(*[F.col(o) for o in order])
    lasts = (
        df.withColumn("_v", value)
        .groupBy(*keys, block)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), position)).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, block, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return _carried(scanned, carry, [*keys, block]).withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_v", "_carry")
