"""Run-log analytics: marker sessions, per-call summaries and retry counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.operators.ordered import running_sum
from counterfair.session import cut_lineage

# Log messages of both generations. Each class counts lines that match any pattern.
CALL_PATTERN = r"M_INSTANCE CALL: (\d+)"
TRIES_PATTERN = r"Finished generating Counter Factual Successfully. Tries: (\d+)"
ERROR_PATTERNS = {
    "failed_features": r"(?i)missing one or more required features|missing required columns|invalid formatting",
    "failed_sensitive": r"(?i)didn't sufficiently change the sensitive attribute|FAILED TO CHANGE SENSITIVE PARAMETER",
    "failed_encoding": r"(?i)encoding.*failed.*invalid format",
    "failed_match": r"(?i)Failed to find a closest match for",
}
CRITICAL_PATTERN = r"CRITICAL - FAILED TO GENERATE COUNTER FACTUAL, MAX RETRIES HIT"


def regex_number(line: Column, pattern: str) -> Column:
    """First group as a number, NULL where the pattern is absent or the number is beyond 64 bits."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("bigint")


def sessionize_by_marker(
    lines: DataFrame, marker: Column, keys: list[str], order: list[str], block: str | None, out: str = "call"
) -> DataFrame:
    """Number the sessions a marker line starts; lines before the first marker are dropped."""
    numbered = running_sum(lines, marker.cast("int"), keys, order, out, block)
    return numbered.filter(F.col(out) > 0)


def session_summary(
    sessions: DataFrame, keys: list[str], call_id: Column, tries: Column, errors: dict[str, Column], critical: Column
) -> DataFrame:
    """Per session: id, tries, one count per error class, totals and the two outcome flags."""
    counts = [F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in errors.items()]
    summed = sessions.groupBy(*keys).agg(
        F.max(call_id).alias("call_id"),
        F.max(tries).alias("tries"),
        *counts,
        F.sum(F.coalesce(critical.cast("int"), F.lit(0))).alias("critical"),
    )
    total = sum((F.col(n) for n in errors), F.col("critical"))
    return summed.withColumns(
        {
            "total_errors": total,
            "had_error": (total > 0).cast("int"),
            "succeeded": F.col("tries").isNotNull().cast("int"),
        }
    )


def log_summary(lines: DataFrame, errors: dict[str, str] | None = None) -> DataFrame:
    """One row per call of each run log (lines as given by ``sources.lines.read_blocks``).

    Every line is parsed where it is read. Lines that match nothing are dropped there, and the others
    shrink to numbers and flags, so neither text nor noise is shuffled; the small rows are kept in the
    checkpoint folder because the session count reads them twice.
    """
    line = F.col("line")
    patterns = errors or ERROR_PATTERNS
    parsed = lines.select(
        "file",
        "block",
        "seq",
        regex_number(line, CALL_PATTERN).alias("call_id"),
        regex_number(line, TRIES_PATTERN).alias("tries"),
        *[line.rlike(p).alias(n) for n, p in patterns.items()],
        line.rlike(CRITICAL_PATTERN).alias("is_critical"),
    )
    matched = F.col("call_id").isNotNull() | F.col("tries").isNotNull() | F.col("is_critical")
    for n in patterns:
        matched = matched | F.col(n)
    events = cut_lineage(parsed.filter(matched))
    calls = sessionize_by_marker(events, F.col("call_id").isNotNull(), ["file"], ["seq"], "block")
    flags = {n: F.col(n) for n in patterns}
    return session_summary(calls, ["file", "call"], F.col("call_id"), F.col("tries"), flags, F.col("is_critical"))


def retry_counters(attempts: DataFrame, status: str = "status", max_retries: int = 5) -> DataFrame:
    """Totals over an attempts table (request_id, attempt, status)."""
    s = F.col(status)
    per_request = attempts.groupBy("request_id").agg(
        F.count_if(s == "missing_key").alias("retries"),
        F.count_if(s == "format_error").alias("format_errors"),
        F.count_if(s == "other_error").alias("other_errors"),
        F.count_if(F.col("attempt") <= max_retries).alias("used"),
        F.count_if((s == "ok") & (F.col("attempt") <= max_retries)).alias("good"),
    )
    spent = (F.col("used") >= max_retries) & (F.col("good") == 0)
    return per_request.agg(
        F.sum("retries").cast("bigint").alias("retries"),
        F.sum("format_errors").cast("bigint").alias("format_errors"),
        F.sum("other_errors").cast("bigint").alias("other_errors"),
        F.count_if(spent).alias("max_retries_hit"),
    )
