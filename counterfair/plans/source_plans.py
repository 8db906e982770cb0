"""Queries over sources, sinks, line order and run logs.

Each writes a table derived from the given ones to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import path_part
from counterfair.operators import logs, metrics, ordered
from counterfair.plans.base import APPLICANTS_SQL, FEATURES, applicants, query, rounded, table
from counterfair.plans.metric_plans import FOUND_SQL, REPORT_COLUMNS, TRIAL_REPORT_SQL, found_set
from counterfair.session import shared_path
from counterfair.sources import chat, lines, tables


@query("s1_read_encoded_csv", f"WITH {APPLICANTS_SQL} SELECT * FROM applicants")
def _(spark, sf):
    path = shared_path(spark, "encoded")
    applicants(spark, sf).write.csv(path, header=True)
    return tables.read_encoded_csv(spark, path)


@query(
    "s2_read_raw_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS "c.custkey", lower(c_name) AS c_name,
      CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) || '; x' END AS segment FROM customer""",
)
def _(spark, sf):
    path = shared_path(spark, "raw")
    segment = F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.concat("c_mktsegment", F.lit("; X")))
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c.custkey"), "c_name", segment.alias("segment")
    )
    rows.write.csv(path, header=True, sep=";")
    return tables.read_raw_csv(spark, path, sep=";", lower=True)


MESSAGES_SQL = "SELECT CAST(conv_id AS VARCHAR) AS doc, {pos} AS pos, role, text AS content FROM conversations"
RANKED = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


def _messages(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("pos"), "role", F.col("text").alias("content")
    )


@query("s3_read_chat_json", MESSAGES_SQL.format(pos=RANKED) + "")
def _(spark, sf):
    path = shared_path(spark, "chat")
    chat.write_chat_json(_messages(spark, sf), path, "file")
    return chat.read_chat_json(spark, path, "file")


@query("s3_read_chat_blocks", MESSAGES_SQL.format(pos=RANKED) + "")
def _(spark, sf):
    path = shared_path(spark, "chat")
    chat.write_chat_json(_messages(spark, sf), path, "file")
    return chat.read_chat_json(spark, path, "blocks")


@query("s6_write_chat_json", MESSAGES_SQL.format(pos="turn"))
def _(spark, sf):
    path = shared_path(spark, "chat")
    chat.write_chat_json(_messages(spark, sf), path, "messages")
    return chat.read_chat_json(spark, path, "messages")


@query("s6_write_chat_documents", MESSAGES_SQL.format(pos=RANKED) + "")
def _(spark, sf):
    path = shared_path(spark, "chat")
    chat.write_chat_json(_messages(spark, sf), path, "documents")
    return chat.read_chat_json(spark, path, "documents")


# Rows per generated file: files multiply with the data instead of growing.
ROWS_PER_FILE = 500


def write_ordered_files(rows: DataFrame, order: list[str], path: str) -> None:
    """Text files, one per ``bucket``, lines sorted by ``order``."""
    rows.repartition("bucket").sortWithinPartitions("bucket", *order).select("bucket", "value").write.partitionBy(
        "bucket"
    ).text(path)


@query(
    "s4_read_sectioned_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
      c_mktsegment AS request FROM customer""",
)
def _(spark, sf):
    path = shared_path(spark, "sectioned")
    customer = table(spark, sf, "customer").withColumn("bucket", F.floor(F.col("c_custkey") / ROWS_PER_FILE))
    body = customer.select(
        "bucket", F.col("c_mktsegment").alias("s"), F.lit(1).alias("kind"), F.col("c_custkey").alias("at"),
        F.concat_ws(",", F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("value"),
    )
    marks = customer.select("bucket", F.col("c_mktsegment").alias("s")).distinct().select(
        "bucket", "s", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"),
        F.concat(F.lit(",CF "), F.col("s"), F.lit(",")).alias("value"),
    )
    heads = customer.select("bucket").distinct().select(
        "bucket", F.lit("").alias("s"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"),
        F.lit("custkey,name,nation").alias("value"),
    )
    write_ordered_files(body.unionByName(marks).unionByName(heads), ["s", "kind", "at"], path)
    return lines.read_sectioned_csv(spark, path, ["custkey", "name", "nation"]).drop("file", "line_no")


# Events as run logs: sign-ups start a call, errors fall into classes by props.k, purchases finish a call.
K_SQL = "CAST(json_extract_string(props, '$.k') AS INT)"
LOG_TEXT = {
    "signup": "M_INSTANCE CALL: %s",
    "purchase": "Finished generating Counter Factual Successfully. Tries: %s",
    "error0": "The counterfactual generated is missing required columns %s",
    "error1": "FAILED TO CHANGE SENSITIVE PARAMETER. %s",
    "error2": "Encoding the generated counterfactual failed due to an invalid format %s",
    "error3": "Failed to find a closest match for: %s",
    "error4": "CRITICAL - FAILED TO GENERATE COUNTER FACTUAL, MAX RETRIES HIT %s",
    "other": "LLM RUN: %s",
}
EVENTS_PER_FILE = 2000
EVENT_KIND_SQL = f"CASE event_type WHEN 'signup' THEN 'signup' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'error' || ({K_SQL} % 5) ELSE 'other' END"
LOG_LINES_SQL = f"""log_lines AS (SELECT event_id, event_id // {EVENTS_PER_FILE} AS bucket, {K_SQL} AS n, {EVENT_KIND_SQL} AS kind,
  'INFO - ' || CASE {EVENT_KIND_SQL} {' '.join(f"WHEN '{k}' THEN replace('{t}', '%s', CAST({K_SQL} AS VARCHAR))" for k, t in LOG_TEXT.items())} END AS line
  FROM events)"""


def _kind(k):
    error = F.concat(F.lit("error"), (k % 5).cast("string"))
    kind = F.col("event_type")
    return F.when(kind.isin("signup", "purchase"), kind).when(kind == "error", error).otherwise(F.lit("other"))


def _event_lines(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf, "events").select("event_id", k.alias("n"), _kind(k).alias("kind"))
    text = F.lit(None).cast("string")
    for name, pattern in LOG_TEXT.items():
        text = F.when(F.col("kind") == name, F.format_string(pattern, F.col("n").cast("string"))).otherwise(text)
    return events.select(
        "event_id", F.floor(F.col("event_id") / EVENTS_PER_FILE).alias("bucket"), F.concat(F.lit("INFO - "), text).alias("value")
    )


def write_event_log(spark, sf) -> str:
    path = shared_path(spark, "logs")
    write_ordered_files(_event_lines(spark, sf), ["event_id"], path)
    return path


def _run_log(spark, sf) -> DataFrame:
    return lines.read_run_log(spark, write_event_log(spark, sf))


def _run():
    return path_part(F.col("file"), -2).alias("run")


@query(
    "s5_read_run_log",
    f"""WITH {LOG_LINES_SQL} SELECT 'bucket=' || bucket AS run,
      row_number() OVER (PARTITION BY bucket ORDER BY event_id) AS line_no, line FROM log_lines""",
)
def _(spark, sf):
    return _run_log(spark, sf).select(_run(), "line_no", "line")


@query("f14_path_part", f"WITH {LOG_LINES_SQL} SELECT 'bucket=' || bucket AS run, count(*) AS n FROM log_lines GROUP BY bucket")
def _(spark, sf):
    return _run_log(spark, sf).groupBy(_run()).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f13_regex_extract",
    f"""WITH {LOG_LINES_SQL} SELECT event_id, CASE WHEN kind = 'signup' THEN n ELSE -1 END AS call_id,
      CASE WHEN kind = 'purchase' THEN n ELSE -1 END AS tries, CAST(kind = 'error0' AS INT) AS failed_features,
      CAST(kind = 'error1' AS INT) AS failed_sensitive, CAST(kind = 'error2' AS INT) AS failed_encoding,
      CAST(kind = 'error3' AS INT) AS failed_match, CAST(kind = 'error4' AS INT) AS critical FROM log_lines""",
)
def _(spark, sf):
    line = F.col("value")
    return _event_lines(spark, sf).select(
        "event_id",
        F.coalesce(logs.regex_number(line, logs.CALL_PATTERN), F.lit(-1)).alias("call_id"),
        F.coalesce(logs.regex_number(line, logs.TRIES_PATTERN), F.lit(-1)).alias("tries"),
        *[line.rlike(p).cast("int").alias(n) for n, p in logs.ERROR_PATTERNS.items()],
        line.rlike(logs.CRITICAL_PATTERN).cast("int").alias("critical"),
    )


def _summary_sql(source: str, keys: str) -> str:
    errors = ["failed_features", "failed_sensitive", "failed_encoding", "failed_match"]
    counts = ", ".join(f"count(*) FILTER (kind = 'error{i}') AS {e}" for i, e in enumerate(errors))
    total = "count(*) FILTER (kind LIKE 'error%')"
    return f"""SELECT {keys}, CAST(max(CASE WHEN kind = 'signup' THEN n END) AS INT) AS call_id,
      CAST(coalesce(max(CASE WHEN kind = 'purchase' THEN n END), -1) AS INT) AS tries, {counts},
      count(*) FILTER (kind = 'error4') AS critical, {total} AS total_errors, CAST({total} > 0 AS INT) AS had_error,
      CAST(count(*) FILTER (kind = 'purchase') > 0 AS INT) AS succeeded FROM {source} GROUP BY {keys}"""


@query(
    "a21_log_summary",
    f"""WITH {LOG_LINES_SQL}, calls AS (SELECT *, 'bucket=' || bucket AS run,
        CAST(sum(CAST(kind = 'signup' AS INT)) OVER (PARTITION BY bucket ORDER BY event_id) AS BIGINT) AS call FROM log_lines),
      counted AS (SELECT * FROM calls WHERE call > 0)
      {_summary_sql('counted', 'run, call')}""",
)
def _(spark, sf):
    summary = logs.log_summary(lines.read_blocks(spark, write_event_log(spark, sf)))
    return summary.withColumns({"run": _run(), "tries": F.coalesce("tries", F.lit(-1))}).drop("file")


@query(
    "w1_sessionize_by_marker",
    """WITH s AS (SELECT user_id, event_id, event_type, CAST(sum(CAST(event_type = 'signup' AS INT))
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS call FROM events)
      SELECT user_id, event_id, event_type, call FROM s WHERE call > 0""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    blocked, block = ordered.with_blocks(events, ["user_id"], ["ts", "event_id"])
    marker = F.col("event_type") == "signup"
    sessions = logs.sessionize_by_marker(blocked, marker, ["user_id"], ["ts", "event_id"], block)
    return sessions.select("user_id", "event_id", "event_type", "call")


@query(
    "w3_forward_fill",
    """SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS filled FROM events""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    blocked, block = ordered.with_blocks(events, ["user_id"], ["ts", "event_id"])
    known = F.when(F.col("event_type") == "signup", F.col("value"))
    filled = ordered.running_last(blocked, known, ["user_id"], ["ts", "event_id"], "filled", block)
    return filled.select("user_id", "event_id", F.coalesce("filled", F.lit(-1.0)).alias("filled"))


STATS = " UNION ALL ".join(
    f"SELECT '{kind}' AS stat, " + ", ".join(f"{rounded(f'{fn}({c})', 4)} AS {c}" for c in REPORT_COLUMNS) + " FROM trials"
    for kind, fn in (("mean", "avg"), ("std", "stddev_pop"))
)


@query("s7_write_report", f"WITH {TRIAL_REPORT_SQL} {STATS}")
def _(spark, sf):
    path = shared_path(spark, "report")
    report = metrics.search_report(found_set(spark, sf), ["trial"])
    tables.write_report(metrics.mean_std_over_trials(report, REPORT_COLUMNS, 4), path)
    return spark.read.csv(path, header=True, schema="stat STRING, " + ", ".join(f"{c} DOUBLE" for c in REPORT_COLUMNS))


@query(
    "s8_write_found_set",
    f"""WITH {FOUND_SQL} SELECT 'customers' AS dataset, f.trial, f.phase, f.row_id, a.seg, a.reg, a.bal, a.n_ord, f.k, f.elapsed
      FROM found f JOIN applicants a USING (row_id) WHERE f.disc = 1""",
)
def _(spark, sf):
    path = shared_path(spark, "found")
    hits = found_set(spark, sf).filter(F.col("disc") == 1).select("row_id", "trial", "phase", "k", "elapsed")
    found = hits.join(applicants(spark, sf).select("row_id", *FEATURES), "row_id")
    tables.write_found_set(found.withColumn("dataset", F.lit("customers")), path)
    return tables.read_found_set(spark, path)
