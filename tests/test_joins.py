import pytest
from pyspark.sql import functions as F

from counterfair.operators import joins


@pytest.mark.parametrize("max_bytes", [16 << 20, 100])
def test_not_seen_among_many_is_the_plain_anti_join(spark, max_bytes):
    visited = spark.range(40_000).select((F.col("id") * 3).alias("a"), F.when(F.col("id") % 10 > 0, F.lit("x")).alias("b"), F.lit(0.0).alias("z"))
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.col("id") * 7).cast("int").alias("a"), F.lit("x").alias("b"), F.lit(-0.0).alias("z"), "id"
    )
    rows = rows.union(rows.withColumn("id", F.col("id") + 10_000)).repartition(5)
    got = joins.not_seen_among_many(rows, ["a", "b", "z"], ["id"], visited, max_bytes)
    want = joins.not_seen(rows, ["a", "b", "z"], ["id"], visited)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    few = joins.not_seen_among_many(rows, ["a", "b", "z"], ["id"], visited.limit(0), max_bytes)
    assert few.count() == joins.not_seen(rows, ["a", "b", "z"], ["id"]).count()


def test_only_possible_hits_reach_the_anti_join(spark):
    visited = spark.range(100_000).select((F.col("id") * 2).alias("k"))
    rows = spark.range(50_000).select((F.col("id") * 2 + 1).alias("k")).union(spark.range(20).selectExpr("id * 2 AS k")).withColumn("id", F.col("k"))
    got = joins.not_seen_among_many(rows, ["k"], ["id"], visited)
    assert got.count() == 50_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    marked = plan.index("LeftAnti")
    assert "_maybe" in plan[marked:]
