"""Queries over counterfactual records: requests, answers, validation, pairs and schema text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.functions import scalar
from counterfair.functions.models import LogisticModel
from counterfair.functions.scalar import hash_int
from counterfair.operators import counterfactual as cf
from counterfair.operators import logs, profile
from counterfair.operators.metrics import add_bin
from counterfair.operators.prepare import label_encode, label_encoder
from counterfair.operators.score import score_logistic
from counterfair.plans.base import EPS, bin_sql, digest_sql, double, query, rounded, table

COLUMNS = ["Segment", "Nation", "Balance"]
CATEGORICAL = ["Segment"]
SENSITIVE = ["Segment"]
MAX_RETRIES = 3
NO_MATCH = "zzzzzzzzzzzzzzzzzz"


def typo(col, at):
    """Drop the character at a one-based position."""
    return F.concat(F.substr(col, F.lit(1), at - 1), F.substr(col, at + 1, F.length(col)))


def _part_values(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    at = hash_int(F.lit("typo"), F.col("p_partkey")) % 4 + 2
    return part.withColumns({"wrong_type": typo(F.col("p_type"), at.cast("int")), "wrong_name": typo(F.col("p_name"), at.cast("int"))})


TYPO_AT = f"({digest_sql(chr(39) + 'typo' + chr(39), 'CAST(p_partkey AS VARCHAR)')} % 4 + 2)"
PART_VALUES_SQL = f"""part_values AS (SELECT p_partkey, p_type, p_name,
  substr(p_type, 1, {TYPO_AT} - 1) || substr(p_type, {TYPO_AT} + 1) AS wrong_type,
  substr(p_name, 1, {TYPO_AT} - 1) || substr(p_name, {TYPO_AT} + 1) AS wrong_name FROM part)"""


def closest_sql(values: str, choices: str) -> str:
    """CTE ``closest(value, choice)``: fewest edits to a substring of a choice, the first on ties."""
    return f"""starts AS (SELECT c.choice, c.code, unnest(range(1, length(c.choice) + 1)) AS i FROM {choices} c),
pieces AS (SELECT choice, code, substr(choice, i, j - i + 1) AS piece
  FROM (SELECT choice, code, i, unnest(range(i, length(choice) + 1)) AS j FROM starts)),
distances AS (SELECT v.value, p.choice, p.code, least(min(levenshtein(v.value, p.piece)), length(v.value)) AS d
  FROM {values} v CROSS JOIN pieces p GROUP BY v.value, p.choice, p.code),
closest AS (SELECT value, choice, code FROM distances
  QUALIFY row_number() OVER (PARTITION BY value ORDER BY d, code) = 1 AND d <= 10)"""


@query(
    "f7_fuzzy_closest",
    f"""WITH {PART_VALUES_SQL}, vals AS (SELECT DISTINCT wrong_type AS value FROM part_values UNION SELECT '{NO_MATCH}'),
      choices AS (SELECT p_type AS choice, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
      {closest_sql('vals', 'choices')}
      SELECT value, coalesce(choice, 'none') AS closest, CAST(coalesce(code, -1) AS INT) AS code
      FROM vals LEFT JOIN closest USING (value)""",
)
def _(spark, sf):
    values = _part_values(spark, sf).select(F.lit("p_type").alias("col"), F.col("wrong_type").alias("value"))
    unmatched = values.groupBy("col").agg(F.lit(NO_MATCH).alias("value"))
    encoder = label_encoder(table(spark, sf, "part"), "p_type").select(F.lit("p_type").alias("col"), "value", "code")
    matched = cf.closest_values(values.unionByName(unmatched), encoder)
    return matched.select(
        "value", F.coalesce("closest", F.lit("none")).alias("closest"), F.coalesce(F.col("code").cast("int"), F.lit(-1)).alias("code")
    )


@query(
    "f8_too_similar",
    f"""WITH {PART_VALUES_SQL} SELECT p_partkey,
      CAST(list_min([levenshtein(p_name, substr(wrong_name, 1, i)) for i in range(0, length(wrong_name) + 1)]) <= 2 AS INT) AS near_name,
      CAST(list_min([levenshtein(p_name, substr(p_type, 1, i)) for i in range(0, length(p_type) + 1)]) <= 2 AS INT) AS near_type
      FROM part_values""",
)
def _(spark, sf):
    return _part_values(spark, sf).select(
        "p_partkey",
        scalar.too_similar(F.col("p_name"), F.col("wrong_name")).cast("int").alias("near_name"),
        scalar.too_similar(F.col("p_name"), F.col("p_type")).cast("int").alias("near_type"),
    )


def originals(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_nationkey").alias("Nation"),
        F.floor("c_acctbal").alias("Balance"),
    )


ORIGINALS_SQL = """originals AS (SELECT c_custkey AS request_id, c_mktsegment AS segment, c_nationkey AS nation,
  CAST(floor(c_acctbal) AS BIGINT) AS balance FROM customer)"""
REQUEST_SQL = """('{"Segment":"' || segment || '","Nation":' || nation || ',"Balance":' || balance || ',"Counterfactual.request":"Segment"}')"""


@query(
    "f11_format_request",
    f"""WITH {ORIGINALS_SQL} SELECT request_id, {REQUEST_SQL} AS request FROM originals""",
)
def _(spark, sf):
    return originals(spark, sf).select("request_id", scalar.format_request(COLUMNS, SENSITIVE).alias("request"))


PROMPT = "Change only the attributes named in Counterfactual.request."


@query(
    "g7_build_requests",
    f"""WITH {ORIGINALS_SQL} SELECT 0 AS pos, 'system' AS role, '{PROMPT}' AS content
      UNION ALL SELECT request_id + 1, 'user', {REQUEST_SQL} FROM originals""",
)
def _(spark, sf):
    requests = cf.build_requests(originals(spark, sf), "request_id", COLUMNS, SENSITIVE, PROMPT)
    return cf.request_messages(requests).drop("doc")


# Answers made from the customers with hashed faults, three attempts each.
FAULTS = ["dropped_key", "bad_json", "unchanged", "typo", "no_match", "no_answer", "reordered", "array"]
FAULTS += ["trailing", "single_quotes", "two_objects", "fine", "fine"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def attempts(spark, sf) -> DataFrame:
    rows = originals(spark, sf).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(MAX_RETRIES + 1))))
    fault = F.element_at(
        F.array(*[F.lit(f) for f in FAULTS]),
        (hash_int(F.lit("fault"), F.col("request_id"), F.col("attempt")) % len(FAULTS)).cast("int") + 1,
    )
    following = F.element_at(
        F.create_map(*[F.lit(x) for s, t in zip(SEGMENTS, [*SEGMENTS[1:], SEGMENTS[0]]) for x in (s, t)]), F.col("Segment")
    )
    named = rows.withColumn("fault", fault).withColumn("_new", following)
    answer = (
        F.when(F.col("fault") == "unchanged", F.col("Segment"))
        .when(F.col("fault") == "typo", typo(F.col("_new"), F.lit(2)))
        .when(F.col("fault") == "no_match", F.lit(NO_MATCH))
        .otherwise(F.col("_new"))
    )
    segment = F.concat(F.lit('"Segment":"'), answer, F.lit('"'))
    nation = F.concat(F.lit('"Nation":'), F.col("Nation").cast("string"))
    balance = F.concat(F.lit('"Balance":'), F.col("Balance").cast("string"))

    def obj(*parts):
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    response = (
        F.when(F.col("fault") == "no_answer", F.lit(None).cast("string"))
        .when(F.col("fault") == "bad_json", F.concat(F.lit("Sure: "), obj(segment, nation, balance)))
        .when(F.col("fault") == "array", F.concat(F.lit("["), obj(segment, nation, balance), F.lit("]")))
        .when(F.col("fault") == "dropped_key", obj(segment, nation))
        .when(F.col("fault") == "reordered", obj(balance, segment, nation))
        .when(F.col("fault") == "trailing", F.concat(obj(segment, nation, balance), F.lit(" trailing text")))
        .when(F.col("fault") == "single_quotes", F.translate(obj(segment, nation, balance), '"', "'"))
        .when(F.col("fault") == "two_objects", F.concat(obj(segment, nation, balance), obj(balance)))
        .otherwise(obj(segment, nation, balance))
    )
    return named.select("request_id", F.col("attempt").cast("int").alias("attempt"), response.alias("response"))


_FAULT = digest_sql("'fault'", "CAST(request_id AS VARCHAR)", "CAST(attempt AS VARCHAR)")
ATTEMPTS_SQL = f"""{ORIGINALS_SQL},
tries AS (SELECT *, unnest(range(1, {MAX_RETRIES + 2})) AS attempt FROM originals),
faulty AS (SELECT *, {FAULTS}[{_FAULT} % {len(FAULTS)} + 1] AS fault,
  {SEGMENTS}[list_position({SEGMENTS}, segment) % 5 + 1] AS next_segment FROM tries),
named AS (SELECT *, CASE fault WHEN 'unchanged' THEN segment WHEN 'typo' THEN substr(next_segment, 1, 1) || substr(next_segment, 3)
  WHEN 'no_match' THEN '{NO_MATCH}' ELSE next_segment END AS answer FROM faulty),
fields AS (SELECT *, '"Segment":"' || answer || '"' AS s, '"Nation":' || nation AS n, '"Balance":' || balance AS b FROM named),
attempts AS (SELECT request_id, CAST(attempt AS INT) AS attempt, segment AS original, CASE fault WHEN 'no_answer' THEN NULL
  WHEN 'bad_json' THEN 'Sure: {{' || s || ',' || n || ',' || b || '}}' WHEN 'array' THEN '[{{' || s || ',' || n || ',' || b || '}}]'
  WHEN 'dropped_key' THEN '{{' || s || ',' || n || '}}' WHEN 'reordered' THEN '{{' || b || ',' || s || ',' || n || '}}'
  WHEN 'trailing' THEN '{{' || s || ',' || n || ',' || b || '}} trailing text'
  WHEN 'single_quotes' THEN translate('{{' || s || ',' || n || ',' || b || '}}', '"', chr(39))
  WHEN 'two_objects' THEN '{{' || s || ',' || n || ',' || b || '}}{{' || b || '}}'
  ELSE '{{' || s || ',' || n || ',' || b || '}}' END AS response FROM fields)"""

IS_OBJECT = "(coalesce(json_valid(response), false) AND coalesce(CASE WHEN json_valid(response) THEN json_type(response) END = 'OBJECT', false))"


@query(
    "f9_has_all_keys",
    f"""WITH {ATTEMPTS_SQL} SELECT request_id, attempt, CAST(CASE WHEN {IS_OBJECT}
      THEN list_has_all(json_keys(response), {COLUMNS}) ELSE false END AS INT) AS complete FROM attempts""",
)
def _(spark, sf):
    complete = scalar.has_all_keys(F.col("response"), COLUMNS).cast("int")
    return attempts(spark, sf).select("request_id", "attempt", complete.alias("complete"))


@query(
    "f10_json_parse_status",
    f"""WITH {ATTEMPTS_SQL} SELECT request_id, attempt, CASE WHEN response IS NULL THEN 'other_error'
      WHEN {IS_OBJECT} THEN 'ok' ELSE 'format_error' END AS status FROM attempts""",
)
def _(spark, sf):
    return attempts(spark, sf).select(
        "request_id", "attempt", scalar.json_parse_status(F.col("response")).alias("status")
    )


def _validated(spark, sf) -> DataFrame:
    encoder = label_encoder(table(spark, sf, "customer"), "c_mktsegment")
    named = encoder.select(F.lit("Segment").alias("col"), "value", "code")
    return cf.validate_responses(
        attempts(spark, sf), originals(spark, sf), named, COLUMNS, CATEGORICAL, SENSITIVE, MAX_RETRIES
    )


VALIDATED_SQL = f"""{ATTEMPTS_SQL},
parsed AS (SELECT *, {IS_OBJECT} AS is_object,
  CASE WHEN {IS_OBJECT} THEN json_extract_string(response, '$.Segment') END AS value,
  CASE WHEN {IS_OBJECT} THEN try_cast(json_extract_string(response, '$.Nation') AS DOUBLE) END AS nation,
  CASE WHEN {IS_OBJECT} THEN try_cast(json_extract_string(response, '$.Balance') AS DOUBLE) END AS balance
  FROM attempts WHERE attempt <= {MAX_RETRIES}),
vals AS (SELECT DISTINCT value FROM parsed WHERE value IS NOT NULL),
choices AS (SELECT c_mktsegment AS choice, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
{closest_sql('vals', 'choices')},
judged AS (SELECT p.*, c.code, CASE WHEN response IS NULL THEN 'other_error' WHEN NOT is_object THEN 'format_error'
    WHEN NOT list_has_all(json_keys(response), {COLUMNS}) THEN 'missing_key'
    WHEN c.code IS NULL OR nation IS NULL OR balance IS NULL THEN 'not_encodable'
    WHEN list_min([levenshtein(original, substr(p.value, 1, i)) for i in range(0, length(p.value) + 1)]) <= 2 THEN 'unchanged'
    ELSE 'ok' END AS status
  FROM parsed p LEFT JOIN closest c ON c.value = p.value),
validated AS (SELECT request_id, attempt, status, CASE WHEN status = 'ok' THEN code || ',' || CAST(nation AS BIGINT) || ',' || CAST(balance AS BIGINT)
  ELSE 'none' END AS encoded FROM judged)"""


def _text(encoded):
    return F.coalesce(F.array_join(F.transform(encoded, lambda v: v.cast("bigint").cast("string")), ","), F.lit("none"))


@query("g8_validate_responses", f"WITH {VALIDATED_SQL} SELECT request_id, attempt, status, encoded FROM validated")
def _(spark, sf):
    return _validated(spark, sf).withColumn("encoded", _text(F.col("encoded")))


@query(
    "g8_first_valid",
    f"""WITH {VALIDATED_SQL} SELECT request_id, CAST(coalesce(min(attempt) FILTER (status = 'ok'), -1) AS INT) AS tries,
      coalesce(arg_min(encoded, attempt) FILTER (status = 'ok'), 'none') AS encoded FROM validated GROUP BY request_id""",
)
def _(spark, sf):
    return cf.first_valid(_validated(spark, sf)).select(
        "request_id", F.coalesce("tries", F.lit(-1)).alias("tries"), _text(F.col("encoded")).alias("encoded")
    )


@query(
    "a22_retry_counters",
    f"""WITH {VALIDATED_SQL}, spent AS (SELECT request_id FROM validated GROUP BY request_id
        HAVING count(*) >= {MAX_RETRIES} AND count(*) FILTER (status = 'ok') = 0)
      SELECT count(*) FILTER (status = 'missing_key') AS retries, count(*) FILTER (status = 'format_error') AS format_errors,
        count(*) FILTER (status = 'other_error') AS other_errors, (SELECT count(*) FROM spent) AS max_retries_hit FROM validated""",
)
def _(spark, sf):
    return logs.retry_counters(_validated(spark, sf), max_retries=MAX_RETRIES)


def next_segment(batches):
    """A caller's generator: answers each request with the segment that follows."""
    for batch in batches:
        answers = []
        for content in batch["content"]:
            row = json.loads(content)
            row.pop("Counterfactual.request")
            row["Segment"] = SEGMENTS[(SEGMENTS.index(row["Segment"]) + 1) % len(SEGMENTS)]
            answers.append(json.dumps(row, separators=(",", ":")))
        yield pd.DataFrame({"request_id": batch["request_id"], "attempt": 1, "response": answers})


@query(
    "g9_generate_counterfactuals",
    f"""WITH {ORIGINALS_SQL} SELECT request_id, 1 AS attempt, '{{"Segment":"' ||
      {SEGMENTS}[list_position({SEGMENTS}, segment) % 5 + 1] || '","Nation":' || nation || ',"Balance":' || balance || '}}' AS response
      FROM originals""",
)
def _(spark, sf):
    requests = cf.build_requests(originals(spark, sf), "request_id", COLUMNS, SENSITIVE)
    return cf.generate_counterfactuals(requests, next_segment)


def faulty_segment(batches):
    """A generator with the hashed faults of ``attempts``: some answers are right only when asked again."""
    for batch in batches:
        answers = []
        for number, content, attempt in zip(batch["request_id"], batch["content"], batch["attempt"]):
            row = json.loads(content)
            digest = hashlib.md5(f"fault|{number}|{attempt}".encode()).hexdigest()
            fault = FAULTS[int(digest[:8], 16) % len(FAULTS)]
            new = SEGMENTS[(SEGMENTS.index(row["Segment"]) + 1) % len(SEGMENTS)]
            wrong = {"unchanged": row["Segment"], "typo": new[0] + new[2:], "no_match": NO_MATCH}
            fields = {"Segment": wrong.get(fault, new), "Nation": row["Nation"], "Balance": row["Balance"]}
            if fault == "dropped_key":
                del fields["Balance"]
            good = json.dumps(fields)
            forms = {
                "no_answer": None,
                "bad_json": f"Sure: {good}",
                "array": f"[{good}]",
                "trailing": f"{good} trailing text",
                "single_quotes": good.replace('"', "'"),
                "two_objects": f"{good}{good}",
            }
            answers.append(forms.get(fault, good))
        yield pd.DataFrame({"request_id": batch["request_id"], "attempt": 1, "response": answers})


def _until_valid(spark, sf) -> DataFrame:
    rows = originals(spark, sf)
    encoder = label_encoder(table(spark, sf, "customer"), "c_mktsegment")
    named = encoder.select(F.lit("Segment").alias("col"), "value", "code")
    requests = cf.build_requests(rows, "request_id", COLUMNS, SENSITIVE)
    return cf.generate_until_valid(requests, rows, faulty_segment, named, COLUMNS, CATEGORICAL, SENSITIVE, MAX_RETRIES)


UNTIL_SQL = f"""{VALIDATED_SQL},
until_valid AS (SELECT v.* FROM validated v LEFT JOIN (SELECT request_id, min(attempt) AS tries FROM validated
    WHERE status = 'ok' GROUP BY request_id) f USING (request_id) WHERE v.attempt <= coalesce(f.tries, {MAX_RETRIES}))"""


@query("g9_generate_until_valid", f"WITH {UNTIL_SQL} SELECT request_id, attempt, status, encoded FROM until_valid")
def _(spark, sf):
    return _until_valid(spark, sf).withColumn("encoded", _text(F.col("encoded")))


ANSWER_MODEL = LogisticModel(tuple(COLUMNS), (0.35, -0.04, 0.0002), -0.5)
ANSWER_P_SQL = rounded(
    f"1e0 / (1e0 + exp(-({double(ANSWER_MODEL.bias)} + "
    + " + ".join(f"CAST(split_part(enc, ',', {i + 1}) AS DOUBLE) * {double(w)}" for i, w in enumerate(ANSWER_MODEL.weights))
    + ")))",
    9,
)


@query(
    "g9_answer_variants",
    f"""WITH {UNTIL_SQL},
both_variants AS (SELECT o.request_id AS row_id, 0 AS variant_id, c.code || ',' || o.nation || ',' || o.balance AS enc
    FROM originals o JOIN choices c ON c.choice = o.segment
  UNION ALL SELECT request_id, 1, encoded FROM until_valid WHERE status = 'ok'),
scored AS (SELECT *, {ANSWER_P_SQL} AS p FROM both_variants), binned AS (SELECT *, {bin_sql()} AS bin FROM scored)
SELECT row_id, CAST(count(*) AS INT) AS n_variants, CAST(count(DISTINCT bin) AS INT) AS k,
  CAST(max(bin) - min(bin) AS INT) AS spread FROM binned GROUP BY row_id""",
)
def _(spark, sf):
    rows = originals(spark, sf)
    encoded = label_encode(rows, "Segment", label_encoder(table(spark, sf, "customer"), "c_mktsegment"))
    variants = cf.answer_variants(encoded, _until_valid(spark, sf), "request_id", COLUMNS)
    binned = add_bin(score_logistic(variants, ANSWER_MODEL), EPS)
    return binned.groupBy("row_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_variants"),
        F.count_distinct("bin").cast("int").alias("k"),
        (F.max("bin") - F.min("bin")).alias("spread"),
    )


@query(
    "g10_flatten_pairs",
    f"""WITH {ATTEMPTS_SQL}, firsts AS (SELECT a.request_id, o.segment, o.nation, o.balance, a.response
        FROM attempts a JOIN originals o USING (request_id) WHERE attempt = 1)
      SELECT request_id AS pair_id, 'original' AS side, segment AS "Segment", CAST(nation AS VARCHAR) AS "Nation",
        CAST(balance AS VARCHAR) AS "Balance" FROM firsts
      UNION ALL SELECT request_id, 'counterfactual',
        CASE WHEN {IS_OBJECT} THEN coalesce(json_extract_string(response, '$.Segment'), 'absent') ELSE 'NaN' END,
        CASE WHEN {IS_OBJECT} THEN coalesce(json_extract_string(response, '$.Nation'), 'absent') ELSE 'NaN' END,
        CASE WHEN {IS_OBJECT} THEN coalesce(json_extract_string(response, '$.Balance'), 'absent') ELSE 'NaN' END FROM firsts""",
)
def _(spark, sf):
    requests = cf.build_requests(originals(spark, sf), "request_id", COLUMNS, SENSITIVE)
    asked = requests.select(F.lit("all").alias("doc"), (F.col("request_id") * 2 + 1).alias("pos"), "content")
    first = attempts(spark, sf).filter(F.col("attempt") == 1)
    answered = first.select(
        F.lit("all").alias("doc"), (F.col("request_id") * 2 + 2).alias("pos"), F.col("response").alias("content")
    )
    flat = cf.flatten_pairs(asked.unionByName(answered), COLUMNS)
    return flat.select("pair_id", "side", *[F.coalesce(c, F.lit("absent")).alias(c) for c in COLUMNS])


@query(
    "f12_schema_prompt",
    """WITH v AS (SELECT string_agg(DISTINCT c_mktsegment, ''', ''' ORDER BY c_mktsegment) AS s,
        CAST(floor(min(c_acctbal)) AS BIGINT) AS b0, CAST(ceil(max(c_acctbal)) AS BIGINT) AS b1,
        min(c_nationkey) AS n0, max(c_nationkey) AS n1 FROM customer)
      SELECT ' c_mktsegment ([''' || s || ''']) c_acctbal (numerical value, range is ' || b0 || ' - ' || b1 ||
        ') c_nationkey (numerical value, range is ' || n0 || ' - ' || n1 || ')' AS attributes,
        '{"c_mktsegment":..., "c_acctbal":..., "c_nationkey":...}' AS template FROM v""",
)
def _(spark, sf):
    names = ["c_mktsegment", "c_acctbal", "c_nationkey"]
    customer = table(spark, sf, "customer")
    shape = profile.column_profile(customer, names, ["c_mktsegment"])
    return profile.schema_prompt(shape, profile.category_values(customer, ["c_mktsegment"]))
