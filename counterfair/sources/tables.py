"""Tabular sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfair.functions.scalar import q


def read_encoded_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Encoded feature table: header skipped, every column a whole number, last column the label.

    Names come from ``columns`` or from the header line; no inference pass over the data.
    """
    names = columns or spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in names])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


def read_raw_csv(spark: SparkSession, path: str, sep: str = ",", lower: bool = False) -> DataFrame:
    """All-string table. Quotes are stripped, blanks stay ''; ``lower`` lower-cases every field, names too."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', inferSchema=False)
    fields = [F.coalesce(q(c), F.lit("")) for c in raw.columns]
    if lower:
        fields = [F.lower(f) for f in fields]
    return raw.select(*[f.alias(c.lower() if lower else c) for f, c in zip(fields, raw.columns)])


def read_dataset(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """Raw table of a named dataset (``sources.datasets``): read, keep or drop columns, label last."""
    from counterfair.operators.prepare import drop_cols, keep_cols, label_last

    raw = read_raw_csv(spark, path, spec.get("sep", ","), spec.get("lower", False))
    if spec.get("keep"):
        raw = keep_cols(raw, spec["keep"])
    raw = drop_cols(raw, spec.get("drop", []))
    return label_last(raw, spec.get("target", raw.columns[-1]))


def write_report(report: DataFrame, path: str) -> None:
    """Metric table as CSV with a header."""
    report.write.mode("overwrite").csv(path, header=True)


def write_found_set(found: DataFrame, path: str) -> None:
    """Found rows with their elapsed seconds, one folder per dataset, trial and phase."""
    found.write.mode("overwrite").partitionBy("dataset", "trial", "phase").parquet(path)


def read_found_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
