from pyspark.sql import Window
from pyspark.sql import functions as F

from counterfair.operators import joins, metrics, ordered


def skewed(spark):
    """One key holds half of the rows; order values repeat."""
    rows = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 37 % 211).alias("t"),
        "id",
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"),
    )
    return rows


def test_blocked_scans_equal_plain_windows(spark):
    df = skewed(spark)
    blocked, block = ordered.with_blocks(df, ["k"], "t", max_rows=40)
    assert block is not None and blocked.select("k", block).distinct().count() > df.select("k").distinct().count()
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want_sum = df.select("id", F.sum((F.col("id") % 3).cast("int")).over(w).alias("x"))
    got_sum = ordered.running_sum(blocked, (F.col("id") % 3).cast("int"), ["k"], ["t", "id"], "x", block).select("id", "x")
    assert sorted(map(tuple, got_sum.collect())) == sorted(map(tuple, want_sum.collect()))
    want_last = df.select("id", F.last("v", ignorenulls=True).over(w).alias("x"))
    got_last = ordered.running_last(blocked, F.col("v"), ["k"], ["t", "id"], "x", block).select("id", "x")
    assert sorted(map(str, got_last.collect())) == sorted(map(str, want_last.collect()))


def test_blocks_on_timestamps(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = skewed(spark).withColumn("at", F.timestamp_seconds(F.col("t") * 3600 + 1_700_000_000).cast(kind))
        blocked, block = ordered.with_blocks(df, ["k"], "at", max_rows=40)
        ends = blocked.filter("k = 0").groupBy(block).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy(block).collect()
        assert len(ends) > 3 and all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))


def test_a_key_with_one_time_for_all_rows_is_spread(spark):
    df = spark.range(2000).select(F.lit(None).cast("int").alias("k"), F.lit(7).alias("t"), "id", F.when(F.col("id") % 50 == 3, F.col("id")).alias("v"))
    df = df.union(spark.range(5).selectExpr("CAST(1 AS INT)", "7", "id + 5000", "id"))
    blocked, block = ordered.with_blocks(df, ["k"], ["t", "id"], max_rows=200)
    sizes = [r["count"] for r in blocked.where("k IS NULL").groupBy(block).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 600
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("t").over(w).alias("x"), F.last("v", ignorenulls=True).over(w).alias("y"))
    summed = ordered.running_sum(blocked, F.col("t"), ["k"], ["t", "id"], "x", block)
    got = ordered.running_last(summed, F.col("v"), ["k"], ["t", "id"], "y", block).select("id", "x", "y")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_hot_key_means_no_blocks(spark):
    df = skewed(spark)
    same, block = ordered.with_blocks(df, ["k"], "t")
    assert block is None and same is df


def test_not_seen_keeps_first_of_equal_keys(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, "c", 9)], "id INT, key STRING, o INT")
    seen = spark.createDataFrame([("c",)], "key STRING")
    got = {(r["id"], r["key"]) for r in joins.not_seen(df, ["key"], ["o"], seen).collect()}
    assert got == {(2, "a"), (3, "b")}


def test_pairs_by_position(spark):
    rows = [("d", 0, "sys"), ("d", 1, "q1"), ("d", 2, "a1"), ("d", 3, "q2"), ("d", 4, "a2"), ("e", 1, "q")]
    df = spark.createDataFrame(rows, "doc STRING, pos BIGINT, content STRING")
    got = {
        (r["doc"], r["pair_id"], r["original"]["content"], r["counterfactual"]["content"] if r["counterfactual"] else None)
        for r in joins.pair_by_position(df, "doc", "pos", ["content"]).collect()
    }
    assert got == {("d", 0, "q1", "a1"), ("d", 1, "q2", "a2"), ("e", 0, "q", None)}


def test_merge_suffixes_only_clashes(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k INT, g INT, x INT")
    b = spark.createDataFrame([(1, 5, 6)], "k INT, g INT, y INT")
    assert joins.merge_on_keys(a, b, ["k"]).columns == ["k", "g.x", "x", "g.y", "y"]


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, 0 if i < 8 else 1) for i in range(10)], "id INT, c INT")
    assert [r["id"] for r in metrics.round_robin_seeds(df, "c", "id", 5).collect()] == [0, 8, 1, 9, 2]


def test_oscillation_and_time_to_nth(spark):
    df = spark.createDataFrame([("s", i, m) for i, m in enumerate([1, 2, 1, 3, 1, 3])], "s STRING, i INT, m INT")
    flags = {r["i"]: r["oscillates"] for r in metrics.oscillation_check(df, "s", "i", "m").collect()}
    assert flags == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1}
    found = spark.createDataFrame([(0, float(i)) for i in range(5)] + [(1, 7.0)], "trial INT, elapsed DOUBLE")
    got = {r["trial"]: (r["time_to_first"], r["time_to_n"]) for r in metrics.time_to_nth(found, ["trial"], 3).collect()}
    assert got == {0: (0.0, 2.0), 1: (7.0, None)}


def test_first_n_of_a_hot_key_equals_plain_rank(spark):
    df = skewed(spark)
    plain = df.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("id"))).filter("_r <= 7")
    assert sorted(map(str, metrics.first_n(df, ["k"], "id", 7, max_rows=40).collect())) == sorted(map(str, plain.collect()))


def test_time_to_nth_counts_equal_times(spark):
    df = spark.createDataFrame([(0, 1.0)] * 3 + [(0, 2.0)] * 2, "trial INT, elapsed DOUBLE")
    times = [metrics.time_to_nth(df, ["trial"], n).first()["time_to_n"] for n in (1, 3, 4, 5, 6)]
    assert times == [1.0, 1.0, 2.0, 2.0, None]


def test_first_n_is_the_window_at_any_n(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 60_013).alias("t"))
    df = df.union(spark.range(50).selectExpr("9", "id"))
    for n in (1, 900, 15_000, 30_000):
        plain = df.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("t"))).filter(F.col("_r") <= n)
        got = metrics.first_n(df, ["k"], "t", n, max_rows=2000)
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    named = df.withColumn("s", F.lpad(F.col("t").cast("string"), 8, "0"))
    by_name = metrics.first_n(named, ["k"], "s", 40, max_rows=2000).select("k", "t", "_r")
    assert by_name.exceptAll(metrics.first_n(df, ["k"], "t", 40)).isEmpty() and by_name.count() == 160


def test_time_to_nth_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("trial"), (F.col("id") % 977).cast("double").alias("elapsed"))
    for n in (1, 700, 2500, 2501):
        got = metrics.time_to_nth(df, ["trial"], n, max_rows=100).orderBy("trial").collect()
        times = [sorted(float(i % 977) for i in range(5000) if i % 2 == t) for t in (0, 1)]
        assert [(r["time_to_first"], r["time_to_n"]) for r in got] == [(x[0], x[n - 1] if n <= len(x) else None) for x in times]
