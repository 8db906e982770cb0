"""Mixing sources to target weights: a Pfair schedule over blocks of documents, in DataFrame functions only.

A source of weight w among weights that sum to Q gives block i (from 0) a window of slots: released at
floor(i Q / w), due at ceil((i + 1) Q / w). Of the released blocks the one due first takes the slot, ties by source
name. Windows of unit blocks can always be met, so after any number of slots t a source has had less than one block
more or less than t w / Q. The windows repeat every Q slots, so only one frame of Q slots is ever worked out; block i
of a source is in frame i div w, at the place of its block i mod w.

Documents of a source come in the order of the md5 of their id. The schedule stops with the slot that first completes
every source, so each row is there at least once; a source that ends before starts again (``epoch``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_FRAME = 10_000
ROWS_PER_BUCKET = 20_000
OTHER = "*"


def _class(source: Column, weights: dict[str, int]) -> Column:
    named = sorted(k for k in weights if k != OTHER)
    return F.when(source.isin(named), source).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def frame(classes: DataFrame) -> DataFrame:
    """(cls, w, q, k, slot): the slots of one frame for the rows (cls, w) of ``classes``.

    Both the classes and the slots are bounded by MAX_FRAME through the weights, so one row holds them all.
    """
    packed = classes.agg(F.sort_array(F.collect_list(F.struct("cls", "w"))).alias("c"), F.sum("w").alias("q"))
    # One step: done counts the blocks each class has had, picks lists the class of each slot.
    ready = """transform(filter(sequence(0, size(c) - 1),
        i -> acc.done[i] < c[i].w AND (acc.done[i] * q) div c[i].w <= t),
        i -> struct(((acc.done[i] + 1) * q + c[i].w - 1) div c[i].w AS due, i AS i))"""
    step = f"""transform(array(array_min({ready}).i), p -> struct(
        transform(acc.done, (d, i) -> if(i = p, d + 1, d)) AS done, array_append(acc.picks, p) AS picks))[0]"""
    picks = f"""aggregate(sequence(0L, q - 1), struct(transform(c, x -> 0L) AS done, CAST(array() AS ARRAY<INT>) AS picks),
        (acc, t) -> {step}, acc -> acc.picks)"""
    slots = packed.where("q > 0").select("c", "q", F.posexplode(F.expr(picks)).alias("slot", "p"))
    order = Window.partitionBy("p").orderBy("slot")
    return slots.select(
        F.expr("c[p].cls").alias("cls"),
        F.expr("c[p].w").alias("w"),
        "q",
        (F.row_number().over(order) - 1).cast("long").alias("k"),
        F.col("slot").cast("long").alias("slot"),
    )


def mix(docs: DataFrame, weights: dict[str, int], key: str = "doc_id", source: str = "source", block_rows: int = 32):
    """Schedule all rows of ``docs`` so that blocks of its sources follow the integer ``weights``.

    ``weights`` may name ``"*"`` for all other sources together, null included (1 if absent); a source without rows
    takes no slots. Returns (row, cls, block, epoch, slot, position): ``row`` is the whole input row, so that no name
    clashes; ``position`` orders the result; a last block that is not full leaves a gap there. Rows with equal keys
    (nulls too) are in any order among themselves; an empty table gives an empty result.

    Only counts meet in one place: per source, and per bucket of about ROWS_PER_BUCKET rows, which md5 keeps even
    however large a source is. Ranks are taken within buckets.
    """
    weights = {OTHER: 1} | weights
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_FRAME:
        raise ValueError(f"weights must be positive and add up to {MAX_FRAME} at most")
    common = reduce(math.gcd, weights.values())
    weights = {k: v // common for k, v in weights.items()}
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct("*").alias("row"),
        _class(F.col(source), weights).alias("cls"),
        digest.alias("_h"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("_u"),
    )
    weight_of = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    sizes = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("w", weight_of[F.col("cls")].cast("long"))  # one row for each weight at most
    frame_rows = frame(sizes.select("cls", "w"))

    spread = F.floor(F.col("_u") * F.ceil(F.col("n") / ROWS_PER_BUCKET) / F.lit(2.0**32)).cast("long")
    placed = rows.join(F.broadcast(sizes), "cls").withColumn("_b", spread)
    counts = placed.groupBy("cls", "_b").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy("cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    within = Window.partitionBy("cls", "_b").orderBy("_h", f"row.{key}")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1).join(counts, ["cls", "_b"])
    ranked = ranked.withColumn("_i", F.col("_rank") + F.col("_before"))
    ranked = ranked.withColumn("block", F.expr(f"_i div {block_rows}")).withColumn("_at", F.expr(f"_i % {block_rows}"))

    blocks = sizes.withColumn("m", F.expr(f"(n + {block_rows - 1}) div {block_rows}"))
    last = blocks.alias("b").join(frame_rows.alias("f"), F.expr("b.cls = f.cls AND (b.m - 1) % f.w = f.k"))
    end = last.agg(F.max(F.expr("((b.m - 1) div f.w) * f.q + f.slot + 1")).alias("t"))
    owned = (
        frame_rows.crossJoin(end)  # one row
        .groupBy("cls", "w", "q", "t")
        .agg(F.sum(F.expr("CAST(slot < t % q AS BIGINT)")).alias("_part"))
        .withColumn("total", F.expr("(t div q) * w + _part"))
        .join(blocks.select("cls", "m"), "cls")
        .select("cls", "w", "q", "m", "total")
    )
    seen = ranked.select("row", "cls", "block", "_at").join(F.broadcast(owned), "cls")
    seen = seen.withColumn("epoch", F.explode(F.expr("sequence(0L, (total - 1 - block) div m)")))
    seen = seen.withColumn("_seq", F.expr("block + epoch * m"))
    slots = frame_rows.select("cls", F.col("k").alias("_k"), F.col("slot").alias("_slot"))
    seen = seen.withColumn("_k", F.expr("_seq % w")).join(F.broadcast(slots), ["cls", "_k"])
    seen = seen.withColumn("slot", F.expr("(_seq div w) * q + _slot"))
    return seen.select("row", "cls", "block", "epoch", "slot", F.expr(f"slot * {block_rows} + _at").alias("position"))
