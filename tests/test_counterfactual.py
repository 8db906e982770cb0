import json

import pandas as pd
from pyspark.sql import functions as F

from counterfair.operators import counterfactual as cf
from counterfair.operators import logs

COLUMNS = ["age", "sex", "job"]
ENCODER = [("sex", "Female", 0), ("sex", "Male", 1), ("job", "Private", 0), ("job", "Self-emp-inc", 1)]


def answer(**kw):
    return json.dumps({"age": 39, "sex": "Female", "job": "Private"} | kw)


CASES = [
    (answer(), "ok", [39.0, 0.0, 0.0]),
    (answer(job="Privte"), "ok", [39.0, 0.0, 0.0]),
    (json.dumps({"job": "Self-emp-inc", "sex": "Female", "age": "41", "extra": 1}), "ok", [41.0, 0.0, 1.0]),
    (json.dumps({"age": 39, "sex": "Female"}), "missing_key", None),
    ("not json", "format_error", None),
    ("[1, 2]", "format_error", None),
    (None, "other_error", None),
    (answer(sex="Male"), "unchanged", None),
    (answer(sex="Mle"), "unchanged", None),
    (answer(job="qqqqqqqqqqqqqqqq"), "not_encodable", None),
    (answer(age="young"), "not_encodable", None),
    (answer(age=None), "not_encodable", None),
]


def test_every_fault_has_its_status(spark):
    attempts = spark.createDataFrame([(i, 1, c[0]) for i, c in enumerate(CASES)], cf.ATTEMPT_SCHEMA)
    originals = spark.createDataFrame([(i, "39", "Male", "Private") for i in range(len(CASES))], "request_id BIGINT, age STRING, sex STRING, job STRING")
    encoder = spark.createDataFrame(ENCODER, "col STRING, value STRING, code INT")
    rows = cf.validate_responses(attempts, originals, encoder, COLUMNS, ["sex", "job"], ["sex"]).orderBy("request_id").collect()
    assert [(r["status"], r["encoded"]) for r in rows] == [(s, e) for _, s, e in CASES]


def test_first_valid_attempt_within_the_limit(spark):
    tries = [(0, 1, None), (0, 2, answer()), (0, 3, answer(age=50)), (1, 1, "x"), (1, 2, "x"), (1, 3, "x"), (1, 4, answer())]
    attempts = spark.createDataFrame(tries, cf.ATTEMPT_SCHEMA)
    originals = spark.createDataFrame([(i, "39", "Male", "Private") for i in range(2)], "request_id BIGINT, age STRING, sex STRING, job STRING")
    encoder = spark.createDataFrame(ENCODER, "col STRING, value STRING, code INT")
    checked = cf.validate_responses(attempts, originals, encoder, COLUMNS, ["sex", "job"], ["sex"], max_retries=3)
    got = {r["request_id"]: (r["tries"], r["encoded"]) for r in cf.first_valid(checked).collect()}
    assert got == {0: (2, [39.0, 0.0, 0.0]), 1: (None, None)}
    totals = logs.retry_counters(checked, max_retries=3).first()
    assert (totals["other_errors"], totals["format_errors"], totals["max_retries_hit"]) == (1, 3, 1)


def test_request_generation_and_pairs(spark):
    rows = spark.createDataFrame([(0, "39", "Male", 'a "b"'), (1, "x", "Female", "c")], "id BIGINT, age STRING, sex STRING, job STRING")
    requests = cf.build_requests(rows, "id", COLUMNS, ["sex"], "be brief")
    sent = {r["request_id"]: json.loads(r["content"]) for r in requests.collect()}
    assert sent[0] == {"age": 39, "sex": "Male", "job": 'a "b"', "Counterfactual.request": "sex"}
    messages = cf.request_messages(requests).orderBy("pos").collect()
    assert [m["role"] for m in messages] == ["system", "user", "user"] and messages[0]["content"] == "be brief"

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"request_id": b["request_id"], "attempt": 1, "response": "bad" + b["content"].str.slice(0, 0)})

    made = cf.generate_counterfactuals(requests, fn)
    chat = requests.select(F.lit("d").alias("doc"), (F.col("request_id") * 2 + 1).alias("pos"), "content").unionByName(
        made.select(F.lit("d").alias("doc"), (F.col("request_id") * 2 + 2).alias("pos"), F.col("response").alias("content"))
    )
    flat = {(r["pair_id"], r["side"]): (r["age"], r["sex"]) for r in cf.flatten_pairs(chat, COLUMNS).collect()}
    assert flat == {(0, "original"): ("39", "Male"), (0, "counterfactual"): ("NaN", "NaN"),
                    (1, "original"): ("x", "Female"), (1, "counterfactual"): ("NaN", "NaN")}


def test_open_requests_are_asked_again(spark):
    rows = spark.createDataFrame([(i, "39", "Male", "Private") for i in range(4)], "request_id BIGINT, age STRING, sex STRING, job STRING")
    encoder = spark.createDataFrame(ENCODER, "col STRING, value STRING, code INT")
    requests = cf.build_requests(rows, "request_id", COLUMNS, ["sex"])
    good = answer()

    def fn(batches):  # request i is answered well in round i + 1; request 3 is left out at first
        for b in batches:
            said = [good if t > i else "sorry" for i, t in zip(b["request_id"], b["attempt"])]
            yield pd.DataFrame({"request_id": b["request_id"], "attempt": 9, "response": said})[(b["request_id"] < 3) | (b["attempt"] > 1)]

    args = (requests, rows, fn, encoder, COLUMNS, ["sex", "job"], ["sex"])
    tried = cf.generate_until_valid(*args, max_retries=3)
    got = sorted((r["request_id"], r["attempt"], r["status"]) for r in tried.collect())
    bad = "format_error"
    assert got == [(0, 1, "ok"), (1, 1, bad), (1, 2, "ok"), (2, 1, bad), (2, 2, bad), (2, 3, "ok"), (3, 2, bad), (3, 3, bad)]
    assert cf.generate_until_valid(*args, max_retries=9).filter("status = 'ok'").count() == 4

    coded = spark.createDataFrame([(i, 39, 1, 0) for i in range(4)], "request_id BIGINT, age INT, sex INT, job INT")
    variants = cf.answer_variants(coded, tried, "request_id", COLUMNS).collect()
    assert sorted((r["row_id"], r["variant_id"], r["sex"]) for r in variants) == sorted(
        [(i, 0, 1.0) for i in range(4)] + [(i, 1, 0.0) for i in range(3)]
    )
    nothing = cf.generate_until_valid(requests.limit(0), *args[1:], max_retries=3)
    assert nothing.count() == 0
