"""Model fitting with MLlib."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.functions.models import LogisticModel

HIDDEN = [64, 32, 16, 8, 4]


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def train_classifier(
    df: DataFrame, features: list[str], label: str, hidden: list[int] = HIDDEN, max_iter: int = 100, seed: int = 1234
):
    """Two-class network with the given hidden widths. MLlib's hidden units are sigmoid."""
    trainer = MultilayerPerceptronClassifier(
        layers=[len(features), *hidden, 2], featuresCol="_features", labelCol=label, maxIter=max_iter, seed=seed
    )
    rows = _assembled(df, features).persist()
    try:
        return trainer.fit(rows)
    finally:
        rows.unpersist()


def predict(df: DataFrame, features: list[str], model) -> DataFrame:
    return model.transform(_assembled(df, features)).drop("_features", "rawPrediction", "probability")


def train_logistic(df: DataFrame, features: list[str], label: str, max_iter: int = 100) -> LogisticModel:
    """Logistic regression as a model usable by every operator here."""
    rows = _assembled(df, features).persist()
    fitted = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter).fit(rows)
    rows.unpersist()
    return LogisticModel(tuple(features), tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def _exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def seed_clusters(
    df: DataFrame, features: list[str], k: int = 4, seed: int = 2019, path: str | None = None
) -> tuple[DataFrame, KMeansModel]:
    """Rows with their ``cluster``, and the model; a model saved at ``path`` is loaded instead of fitted.

    Only an absent path means fitting; a model that cannot be read is an error and stays as it is.
    """
    rows = _assembled(df, features)
    if path and _exists(df, path):
        model = KMeansModel.load(path)
    else:
        kept = rows.persist()
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(kept)
        kept.unpersist()
        if path:
            model.write().save(path)
    return model.transform(rows).drop("_features").withColumn("cluster", F.col("cluster").cast("int")), model
