"""Aggregates over variant tables (row_id, variant_id, protected…, p, bin, label) and found sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfair.functions.scalar import fixed, q, score_bin
from counterfair.operators.ordered import MAX_ROWS_PER_TASK, running_sum, with_blocks
from counterfair.session import cut_lineage

BUCKETS = 1000  # of the histogram that finds a key's n-th row


def add_bin(variants: DataFrame, eps: float = 0.025, p: str = "p") -> DataFrame:
    return variants.withColumn("bin", score_bin(F.col(p), eps))


def score_partitions(variants: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """(key, bin, n, members): protected tuples per score bin. A row's variants bound the list."""
    members = F.array_sort(F.collect_list(F.struct(*[q(c) for c in protected])))
    return variants.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"), members.alias("members"))


def _bin_counts(variants: DataFrame, key: str) -> DataFrame:
    return variants.groupBy(key, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("p_min"), F.max("p").alias("p_max")
    )


def k_partitions(variants: DataFrame, key: str) -> DataFrame:
    return variants.groupBy(key).agg(F.count_distinct("bin").cast("int").alias("k"))


def bin_spread(variants: DataFrame, key: str) -> DataFrame:
    return variants.groupBy(key).agg((F.max("bin") - F.min("bin")).alias("spread"))


def shannon_entropy(variants: DataFrame, key: str) -> DataFrame:
    """Base-2 entropy of the variant counts over bins."""
    return _bin_counts(variants, key).groupBy(key).agg(_entropy().alias("sh_entropy"))


def _entropy() -> Column:
    """log2(N) - sum(n log2 n) / N, which needs no second look at the total."""
    total = F.sum("n")
    return F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0))


def min_entropy(k: Column) -> Column:
    return fixed(F.log2(k), 2)


def discriminatory_score(p_min: Column, p_max: Column) -> Column:
    """Scores on both sides of one half, strictly."""
    return ((p_max > 0.5) & (p_min < 0.5)).cast("int")


def partition_report(variants: DataFrame, key: str) -> DataFrame:
    """(key, k, spread, sh_entropy, min_entropy, disc) from one two-level aggregate."""
    return (
        _bin_counts(variants, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).cast("int").alias("k"),
            (F.max("bin") - F.min("bin")).alias("spread"),
            _entropy().alias("sh_entropy"),
            discriminatory_score(F.min("p_min"), F.max("p_max")).alias("disc"),
        )
        .withColumn("min_entropy", min_entropy(F.col("k")))
    )


def discriminatory_label(variants: DataFrame, key: str, protected: str, own: str, label: str = "label") -> DataFrame:
    """(key, disc, first_value): does another protected value change the class, and which one first.

    ``own`` holds the row's own protected value on each variant; its class is taken from that variant.
    """
    is_own = F.col(protected) == F.col(own)
    own_label = F.max(F.when(is_own, F.col(label)))
    firsts = [F.min(F.when(F.col(label) == c, F.col(protected))) for c in (0, 1)]
    return variants.groupBy(key).agg(
        (F.min(label) != F.max(label)).cast("int").alias("disc"),
        F.when(own_label == 0, firsts[1]).otherwise(firsts[0]).alias("first_value"),
    )


def mixed_groups(variants: DataFrame, group: list[str], n: int, label: str = "label") -> DataFrame:
    """Groups whose label sum lies strictly between 0 and ``n``."""
    sums = variants.groupBy(*[q(c) for c in group]).agg(F.sum(label).alias("s"))
    return sums.filter((F.col("s") > 0) & (F.col("s") < n))


def mixed_group_count(variants: DataFrame, group: list[str], n: int, label: str = "label") -> DataFrame:
    """Total of ``n - sum`` over the mixed groups."""
    return mixed_groups(variants, group, n, label).agg(
        F.coalesce(F.sum(F.lit(n) - F.col("s")), F.lit(0)).cast("bigint").alias("discriminatory")
    )


def mixed_group_instances(variants: DataFrame, group: list[str], n: int, label: str = "label") -> DataFrame:
    """Number of mixed groups and their share of all groups in percent."""
    sums = variants.groupBy(*[q(c) for c in group]).agg(F.sum(label).alias("s"))
    mixed = ((F.col("s") > 0) & (F.col("s") < n)).cast("int")
    return sums.agg(
        F.sum(mixed).cast("bigint").alias("mixed"),
        fixed(F.lit(100.0) * F.sum(mixed) / F.count(F.lit(1)), 1).alias("success_pct"),
    )


def success_rate(tried: DataFrame, flag: str, phase: str = "phase") -> DataFrame:
    """(phase, found, tried, rate, rate_plus_one) in percent; the second divides by tried + 1."""
    found, total = F.sum(F.col(flag).cast("int")), F.count(F.lit(1))
    return tried.groupBy(phase).agg(
        found.cast("bigint").alias("found"),
        total.alias("tried"),
        fixed(F.try_divide(found * 100.0, total), 1).alias("rate"),
        fixed(found * 100.0 / (total + 1), 6).alias("rate_plus_one"),
    )


def top_k_frequencies(metrics: DataFrame, ranks: int = 3) -> DataFrame:
    """ik1f…: how many rows have the highest, second, third distinct K; 0 for an absent rank."""
    top = metrics.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).limit(ranks)
    ordered = F.sort_array(F.collect_list(F.struct("k", "n")), asc=False)
    packed = top.agg(ordered.alias("t"))
    return packed.select(
        *[F.coalesce(F.try_element_at("t", F.lit(i + 1))["n"], F.lit(0)).alias(f"ik{i + 1}f") for i in range(ranks)]
    )


def search_report(found: DataFrame, by: list[str]) -> DataFrame:
    """Search quality per trial from found rows with init_k, k, elapsed, disc and both entropies."""
    hit = F.col("disc") == 1
    means = {
        "k_init": F.col("init_k"),
        "k_final": F.col("k"),
        "t_final": F.col("elapsed"),
        "q_inf": F.when(hit, F.col("min_entropy")),
        "q_1": F.when(hit, F.col("sh_entropy")),
    }
    parts = [p for n, c in means.items() for p in (F.sum(c).alias(f"_s_{n}"), F.count(c).alias(f"_c_{n}"))]
    # One pass over the finds. K never exceeds the number of bins, so what follows sees a few rows per trial.
    per_k = found.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), *parts)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k")))
    return per_k.withColumn("r", rank).groupBy(*by).agg(
        F.sum("n").alias("n_found"),
        *[fixed(F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")), 6).alias(n) for n in means],
        *[F.coalesce(F.sum(F.when(F.col("r") == i, F.col("n"))), F.lit(0)).alias(f"ik{i}f") for i in (1, 2, 3)],
    )


def first_n(df: DataFrame, keys: list[str], order: str, n: int, out: str = "_r", max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` (unique), with their rank.

    A key of more than ``max_rows`` rows is cut down first: a histogram of equally full buckets tells in which bucket its
    n-th row lies, and rows above that bucket go. What is left is ranked by ranges of the order, so that neither the key
    nor its first ``n`` rows need one task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = cut_lineage(counts)  # at most one row per ``max_rows`` rows of the table
    if hot.isEmpty():
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return df.withColumn(out, rank).filter(F.col(out) <= n)
    rest = df
    if isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        names = F.broadcast(hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        own = [f"_k{i}" for i in range(len(keys))]
        edges = F.percentile_approx(order, [i / BUCKETS for i in range(1, BUCKETS + 1)], 10 * BUCKETS)
        edges = df.join(names, same).groupBy(*own, "_n").agg(edges.alias("_e"))
        # An edge's rank is off by a tenth of a bucket at most, so two buckets further on the n-th row is below it.
        at = F.ceil(F.lit(n) * BUCKETS / F.col("_n")).cast("int") + 2
        bound = F.when(at <= BUCKETS, F.element_at("_e", F.least(at, F.lit(BUCKETS))))
        bounds = cut_lineage(edges.select(*own, bound.alias("_bound")))
        rest = df.join(F.broadcast(bounds), same, "left").filter(F.col("_bound").isNull() | (F.col(order) <= F.col("_bound"))).select(*df.columns)
    blocked, block = with_blocks(rest, keys, order, max_rows)
    ranked = running_sum(blocked, F.lit(1), keys, [order], out, block).filter(F.col(out) <= n)
    return ranked.drop(block) if block else ranked


def time_to_nth(found: DataFrame, by: list[str], n: int = 1000, time: str = "elapsed", max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """(by, time_to_first, time_to_n): NULL when fewer than ``n`` were found."""
    # Equal times share one row with their count; the counts are summed up by ranges of time.
    times = found.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_n"))
    blocked, block = with_blocks(times, by, time, max_rows)
    head = running_sum(blocked, F.col("_n"), by, [time], "_total", block)
    return head.groupBy(*by).agg(
        F.min(time).alias("time_to_first"), F.min(F.when(F.col("_total") >= n, F.col(time))).alias("time_to_n")
    )


def compare_report(tried: DataFrame, by: list[str], n: int = 1000) -> DataFrame:
    """Baseline comparison per trial: finds per phase, local success, time to 1st and n-th find."""
    hit = F.col("disc").cast("int")
    local = F.col("phase") == "local"
    counts = tried.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~local, hit)), F.lit(0)).alias("g_disc"),
        F.coalesce(F.sum(F.when(local, hit)), F.lit(0)).alias("l_disc"),
        F.sum(hit).alias("tot_disc"),
        fixed(F.try_divide(F.sum(F.when(local, hit)) * 100.0, F.sum(local.cast("int"))), 1).alias("local_succ"),
    )
    return counts.join(time_to_nth(tried.filter(F.col("disc") == 1), by, n), by, "left")


def mean_std_over_trials(table: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """Two rows: the mean and the population standard deviation of every metric."""
    def row(kind: str, fn):
        return F.struct(F.lit(kind).alias("stat"), *[fixed(fn(q(m)), digits).alias(m) for m in metrics])

    both = F.array(row("mean", F.avg), row("std", F.stddev_pop))
    return table.agg(both.alias("rows")).select(F.inline("rows"))


def running_best_k(steps: DataFrame, seed: str, step: str, time: str) -> DataFrame:
    """Best K so far per seed, and when it was reached. A seed's steps are capped by the search."""
    w = Window.partitionBy(seed).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct(F.col("k"), (-F.col(step)).alias("s"), F.col(time).alias("t"))).over(w)
    return steps.withColumn("_b", best).withColumns({"best_k": F.col("_b.k"), "best_at": F.col("_b.t")}).drop("_b")


def oscillation_check(moves: DataFrame, seed: str, step: str, move: str) -> DataFrame:
    """Flag moves equal to the one two steps earlier. Joined on (seed, step), so no seed is one task."""
    earlier = moves.select(q(seed).alias(seed), (q(step) + 2).alias(step), q(move).alias("_two_back"))
    same = F.coalesce((q(move) == F.col("_two_back")).cast("int"), F.lit(0))
    return moves.join(earlier, [seed, step], "left").withColumn("oscillates", same).drop("_two_back")


def round_robin_seeds(rows: DataFrame, cluster: str, row_id: str, limit: int) -> DataFrame:
    """The i-th member of each cluster in turn until ``limit``; no cluster can supply more than that."""
    head = first_n(rows, [cluster], row_id, limit, "turn")
    return head.orderBy("turn", cluster).limit(limit)
