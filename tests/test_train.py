import pytest
from pyspark.sql import functions as F

from counterfair.operators import score, train


def test_logistic_learns_a_threshold(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("int").alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("y"))
    model = train.train_logistic(df, ["a"], "y")
    scored = score.score_logistic(df, model).withColumn("c", score.predict_class(F.col("p")))
    assert score.accuracy(scored, "c", "y").first()["accuracy"] == 1.0


def test_network_trains_and_predicts(spark):
    df = spark.range(200).select((F.col("id") % 20 / 20).alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("y"))
    model = train.train_classifier(df, ["a"], "y", hidden=[4], max_iter=60)
    rows = train.predict(df, ["a"], model).collect()
    assert sum(int(r["prediction"]) == r["y"] for r in rows) > 180


def test_clusters_repeat_and_can_be_kept(spark, tmp_path):
    df = spark.range(90).select("id", (F.col("id") % 3 * 100 + F.col("id") / 90).alias("x"))
    first, _ = train.seed_clusters(df, ["x"], k=3, path=str(tmp_path / "km"))
    again, _ = train.seed_clusters(df, ["x"], k=3, path=str(tmp_path / "km"))
    assert sorted(first.collect()) == sorted(again.collect())
    assert first.select("cluster").distinct().count() == 3


def test_an_unreadable_model_is_not_replaced(spark, tmp_path):
    (tmp_path / "km").mkdir()
    (tmp_path / "km" / "note").write_text("not a model")
    df = spark.range(9).select("id", F.col("id").cast("double").alias("x"))
    with pytest.raises(Exception):
        train.seed_clusters(df, ["x"], k=3, path=str(tmp_path / "km"))
    assert (tmp_path / "km" / "note").read_text() == "not a model"
