"""Counterfactual records: requests, generated answers, validation and pair tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import (
    format_request,
    has_all_keys,
    is_json_object,
    json_parse_status,
    q,
    too_similar,
)
from counterfair.operators.fuzzy import closest_values
from counterfair.operators.joins import pair_by_position
from counterfair.operators.prepare import union_tables
from counterfair.session import cut_lineage

ATTEMPT_SCHEMA = "request_id BIGINT, attempt INT, response STRING"


def build_requests(
    rows: DataFrame, row_id: str, columns: list[str], protected: list[str], prompt: str = ""
) -> DataFrame:
    """(request_id, system, content): one JSON request per row under a shared system prompt."""
    return rows.select(
        q(row_id).alias("request_id"),
        F.lit(prompt).alias("system"),
        format_request(columns, protected).alias("content"),
    )


def request_messages(requests: DataFrame, doc: str = "requests") -> DataFrame:
    """Requests as user messages (doc, pos, role, content), one document per system prompt.

    Positions are the request ids + 1; position 0 is the system message.
    """
    users = requests.select(
        F.lit(doc).alias("doc"), (F.col("request_id") + 1).alias("pos"), F.lit("user").alias("role"), "content"
    )
    system = requests.agg(F.max("system").alias("content")).select(
        F.lit(doc).alias("doc"), F.lit(0).cast("bigint").alias("pos"), F.lit("system").alias("role"), "content"
    )
    return system.unionByName(users)


def generate_counterfactuals(
    requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Attempts table from the caller's generator, which sees batches of (request_id, system, content).

    Where ``requests`` has a column ``attempt``, the generator sees that too.
    """
    seen = [c for c in ("request_id", "system", "content", "attempt") if c in requests.columns]
    return requests.select(*seen).mapInPandas(fn, ATTEMPT_SCHEMA)


def generate_until_valid(
    requests: DataFrame,
    originals: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    encoder: DataFrame,
    columns: list[str],
    categorical: list[str],
    protected: list[str],
    max_retries: int = 5,
    max_errors: int = 10,
) -> DataFrame:
    """All attempts with their status: round n asks again only for requests still without a valid answer.

    (request_id, attempt, status, encoded) as ``validate_responses`` gives it; the number of the round is
    the attempt, whatever the generator says. Answers are written once per round, because a generator may
    answer differently when asked again; a request it leaves out is open in the next round too.
    """
    waiting, rounds = requests, []
    for attempt in range(1, max_retries + 1):
        asked = waiting.withColumn("attempt", F.lit(attempt))
        answers = cut_lineage(generate_counterfactuals(asked, fn)).withColumn("attempt", F.lit(attempt))
        judged = validate_responses(
            answers, originals, encoder, columns, categorical, protected, max_retries, max_errors
        )
        rounds.append(cut_lineage(judged))
        done = rounds[-1].filter(F.col("status") == "ok").select("request_id")
        waiting = waiting.join(done, "request_id", "left_anti")
        if attempt < max_retries and waiting.isEmpty():
            break
    return union_tables(*rounds)


def answer_variants(originals: DataFrame, validated: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """(row_id, variant_id, features…): each row as variant 0, its first valid answer as variant 1.

    The shape of ``expand_protected``, so scores and partition metrics apply. ``originals`` is encoded;
    the answers' ``encoded`` follows ``features``. A row without a valid answer has variant 0 only.
    """
    answered = first_valid(validated).filter(F.col("encoded").isNotNull())
    own = originals.select(
        q(row_id).alias("row_id"), F.lit(0).alias("variant_id"), *[q(f).cast("double").alias(f) for f in features]
    )
    other = answered.select(
        F.col("request_id").alias("row_id"),
        F.lit(1).alias("variant_id"),
        *[F.col("encoded")[i].alias(f) for i, f in enumerate(features)],
    )
    return union_tables(own, other)


def attribute(response: Column, name: str) -> Column:
    """One value of a JSON answer as text."""
    return F.try_element_at(F.from_json(response, "map<string,string>"), F.lit(name))


def validate_responses(
    attempts: DataFrame,
    originals: DataFrame,
    encoder: DataFrame,
    columns: list[str],
    categorical: list[str],
    protected: list[str],
    max_retries: int = 5,
    max_errors: int = 10,
) -> DataFrame:
    """(request_id, attempt, status, encoded) for every attempt within ``max_retries``.

    Checks run in order: answer parses, holds every column, every category finds a close value and
    every other column a number, every protected value really changed. ``encoded`` follows ``columns``.
    ``originals`` is (request_id, columns…) in decoded form.
    """
    kept = attempts.filter(F.col("attempt") <= max_retries)
    fields = F.from_json("response", "map<string,string>")
    parsed = kept.withColumn("_parse", json_parse_status(F.col("response"))).withColumns(
        {f"_v{i}": F.try_element_at(fields, F.lit(c)) for i, c in enumerate(columns)}
    )
    slot = {c: f"_v{i}" for i, c in enumerate(columns)}
    # Only the distinct answers of each category column are matched against the choices.
    if categorical:
        pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(slot[c]).alias("value")) for c in categorical])
        seen = parsed.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        matches = cut_lineage(closest_values(seen, encoder, max_errors))
    for c in columns:
        if c in categorical:
            side = matches.filter(F.col("col") == c).select(
                F.col("value").alias(slot[c]), F.col("code").cast("double").alias(f"_e{slot[c]}")
            )
            parsed = parsed.join(side, slot[c], "left")
        else:
            parsed = parsed.withColumn(f"_e{slot[c]}", F.col(slot[c]).try_cast("double"))
    before = originals.select("request_id", *[q(p).cast("string").alias(f"_o{i}") for i, p in enumerate(protected)])
    joined = parsed.join(before, "request_id")
    encoded = [F.col(f"_e{slot[c]}") for c in columns]
    unencodable = F.lit(False)
    for e in encoded:
        unencodable = unencodable | e.isNull()
    unchanged = F.lit(False)
    for i, p in enumerate(protected):
        unchanged = unchanged | too_similar(F.col(f"_o{i}"), F.coalesce(F.col(slot[p]), F.lit("")))
    status = (
        F.when(F.col("_parse") != "ok", F.col("_parse"))
        .when(~has_all_keys(F.col("response"), columns), "missing_key")
        .when(unencodable, "not_encodable")
        .when(unchanged, "unchanged")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).select(
        "request_id",
        "attempt",
        "status",
        F.when(F.col("status") == "ok", F.array(*encoded)).alias("encoded"),
    )


def first_valid(validated: DataFrame) -> DataFrame:
    """The first valid attempt of each request: (request_id, tries, encoded); NULLs when none is."""
    good = F.when(F.col("status") == "ok", F.col("attempt"))
    return validated.groupBy("request_id").agg(
        F.min(good).alias("tries"), F.min_by("encoded", good).alias("encoded")
    )


def flatten_pairs(messages: DataFrame, columns: list[str], doc: str = "doc", first: int = 1) -> DataFrame:
    """(doc, pair_id, side, columns…): original and counterfactual of each pair, one row per side.

    Content that is not a JSON object gives a row of 'NaN'.
    """
    pairs = pair_by_position(messages, doc, "pos", ["content"], first)
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.col(s)["content"].alias("content"))
            for s in ("original", "counterfactual")
        ]
    )
    rows = pairs.select(doc, "pair_id", F.inline(sides))
    values = F.from_json("content", "map<string,string>")
    is_object = is_json_object(F.col("content"))
    return rows.withColumn("_m", F.when(is_object, values)).select(
        doc,
        "pair_id",
        "side",
        *[
            F.when(F.col("_m").isNull(), F.lit("NaN")).otherwise(F.try_element_at("_m", F.lit(c))).alias(c)
            for c in columns
        ],
    )
