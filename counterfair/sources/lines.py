"""Line-oriented sources: run logs and sectioned CSV files, with a line number per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfair.operators.ordered import running_last

LINE_KEYS = ["file"]


def read_blocks(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, block, seq, line): lines with their input split and their order inside it."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, block, line_no, line) for every line of every file.

    A block is one input split, so numbering never needs a whole file in one task: lines are ranked
    inside their split and the counts of the earlier splits are added.
    """
    lines = read_blocks(spark, path, pattern)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))
    return (
        lines.withColumn("_rank", rank)
        .join(offsets, ["file", "block"])
        .select("file", "block", (F.col("_first") + F.col("_rank")).alias("line_no"), "line")
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines in file order, many files at once."""
    return read_lines(spark, path)


def split_sections(lines: DataFrame, columns: list[str], marker_column: int = 2, marker: str = "CF") -> DataFrame:
    """Rows of a sectioned CSV with the request that is in force for each of them.

    A line whose ``marker_column`` contains ``marker`` names the request for the lines after it. The
    first other line is the header and is skipped.
    """
    parsed = lines.filter(F.col("line") != "").withColumn(
        "_f", F.from_csv("line", ", ".join(f"_c{i} STRING" for i in range(max(len(columns), marker_column))))
    )
    second = F.coalesce(F.col(f"_f._c{marker_column - 1}"), F.lit(""))
    is_marker = second.contains(marker)
    request = F.when(is_marker, F.element_at(F.split(F.trim(second), r"\s+"), 2))
    filled = running_last(parsed.withColumn("_m", is_marker), request, LINE_KEYS, ["line_no"], "request", "block")
    body = filled.filter(~F.col("_m"))
    header = body.groupBy("file").agg(F.min("line_no").alias("_header"))
    rows = body.join(header, "file").filter(F.col("line_no") > F.col("_header"))
    fields = [F.col(f"_f._c{i}").alias(c) for i, c in enumerate(columns)]
    return rows.select("file", "line_no", *fields, "request")


def read_sectioned_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return split_sections(read_lines(spark, path), columns)
