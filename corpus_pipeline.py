"""Documents to training tokens: five stages, each one operator of ``counterfair.llm`` on what the one before kept.

Every stage but the last returns the columns of the documents it was given.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfair.llm import jaccard, lines, mixing, quality, sentencepieces
from counterfair.llm.common import staged
from counterfair.llm.queries import KEEP_SCORE, MIX_BLOCK, MIX_WEIGHTS, quality_model

ORACLE_SQL = None  # trees, near-duplicate classes and tokens have no SQL form


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of KEEP_SCORE or more).

    Null and empty texts have a score like others; equal texts have equal scores; an empty table stays empty.
    """
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.where(F.col("score") >= KEEP_SCORE).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents share, but for one document; no document goes.

    ``n_chars``, where there is one, is counted anew for the texts that changed.
    """
    out = lines.line_dedup(docs, min_chars=40, min_docs=5)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id.

    Rows without id all stay. Rows that repeat an id are one document, and go or stay together.
    """
    classes = jaccard.near_duplicates(docs)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixing schedule; those of sources that end early come again in later epochs.

    The files' names ascend with the schedule, and so do the rows of a file. Null sources and those without a weight of
    their own share one; rows that repeat an id or have none are rows like others; an empty table stays empty.
    """
    mixed = mixing.mix(docs, MIX_WEIGHTS, block_rows=MIX_BLOCK)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: 0, 1, ... by file name and the row's place in its file.

    One row per file is counted to find where each begins. A table that is not read from files is numbered as Spark
    holds it, with gaps.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn("position", F.monotonically_increasing_id())
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # of as many rows as there are files
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn("position", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and its ``position`` in the mix, which tells the repeats of a document apart.

    Null and empty texts have no tokens; rows that repeat an id or have none are rows like others; an empty table stays
    empty.
    """
    return sentencepieces.encode(in_file_order(docs), keep=("position",))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mix", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage returns is a Parquet table for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
