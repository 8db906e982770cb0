import json
import math
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from counterfair.functions import scalar


def values(df):
    return [r[0] for r in df.collect()]


EDGE_SCORES = [0.0, 0.024999, 0.025, 0.075, 0.15, 0.3, 0.35, 0.475, 0.5, 0.575, 0.7, 0.8, 0.975, 0.99999, 1.0]


@pytest.mark.parametrize("eps", [0.025, 0.1, 0.05, 1 / 3])
def test_score_bin_is_digitize(spark, eps):
    scores = EDGE_SCORES + [float(e) for e in np.arange(0, 1, eps)] + list(np.random.default_rng(1).random(500))
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(scores)], "i INT, p DOUBLE").orderBy("i")
    got = values(df.select(scalar.score_bin(F.col("p"), eps)))
    assert got == (np.digitize(scores, np.arange(0, 1, eps)) - 1).tolist()


def test_softmax_handles_large_values(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0],)], "v ARRAY<DOUBLE>")
    soft = values(df.select(scalar.softmax(F.col("v"))))[0]
    e = np.exp(np.array([-1.0, 0.0, -2.0]))
    assert soft == pytest.approx((e / e.sum()).tolist())


MOVES = [
    ([1.0, -2.0, 3.0], [2.0, -1.0, -1.0], [1.0, -1.0, 0.0]),
    ([0.0, 0.0, 0.0], [2.0, -1.0, 0.0], [0.0, 0.0, 0.0]),
    ([1.0, -2.0, 3.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
]


def test_sign_move_zero_sides(spark):
    df = spark.createDataFrame([(g, h) for g, h, _ in MOVES], "g ARRAY<DOUBLE>, h ARRAY<DOUBLE>")
    free = F.array(*[F.lit(1.0)] * 3)
    got = values(df.select(scalar.sign_move(F.col("g"), F.col("h"), free)))
    assert sorted(got) == sorted(m for _, _, m in MOVES)


def test_protected_features_never_move(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0])], "g ARRAY<DOUBLE>, h ARRAY<DOUBLE>")
    frozen = F.array(F.lit(0.0), F.lit(1.0))
    assert values(df.select(scalar.sign_move(F.col("g"), F.col("h"), frozen))) == [[0.0, 1.0]]
    assert values(df.select(scalar.inverse_gradient_prob(F.col("g"), F.col("h"), frozen))) == [[0.0, 1.0]]


def test_inverse_gradient_prob_is_uniform_without_gradient(spark):
    df = spark.createDataFrame([([0.0] * 4, [0.0] * 4)], "g ARRAY<DOUBLE>, h ARRAY<DOUBLE>")
    movable = F.array(*[F.lit(x) for x in (0.0, 1.0, 1.0, 1.0)])
    got = values(df.select(scalar.inverse_gradient_prob(F.col("g"), F.col("h"), movable)))[0]
    assert got == pytest.approx([0.0, 1 / 3, 1 / 3, 1 / 3])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6).filter(lambda p: sum(p) > 0.01), st.floats(0, 0.999))
def test_weighted_choice(spark, probs, unit):
    df = spark.range(1).select(F.array(*[F.lit(p) for p in probs]).alias("p"))
    at = values(df.select(scalar.weighted_choice(F.col("p"), F.lit(unit))))[0]
    acc = np.cumsum(probs)
    assert probs[at] > 0 and acc[at] > unit * acc[-1] - 1e-12


def test_hash_unit_range_and_repeatability(spark):
    df = spark.range(2000).select(scalar.hash_unit(F.lit("a"), F.col("id")).alias("u"))
    first, second = values(df), values(df)
    assert first == second and 0 <= min(first) and max(first) < 1 and abs(np.mean(first) - 0.5) < 0.03


def test_mixed_numbers_are_those_of_the_array_form_and_even(spark):
    df = spark.range(-3000, 3000).select("id", scalar.mix_int("sign", F.lit(7), F.col("id") * (1 << 29), F.lit(3)).alias("v"))
    rows = sorted((r["id"], r["v"]) for r in df.collect())
    ids = np.array([i for i, _ in rows], dtype=np.int64) * (1 << 29)
    state = scalar.mixed_state(scalar.mixed_state(crc32(b"sign"), 7), ids)
    assert scalar.mixed_numbers(state, 3).tolist() == [v for _, v in rows]
    by_step = np.array([scalar.mixed_numbers(state, n) for n in range(50)])
    assert abs(by_step.mean() / 2**32 - 0.5) < 0.005 and abs((by_step % 2).mean() - 0.5) < 0.005
    units = by_step / 2**32  # neither neighbouring walkers nor neighbouring steps go together
    assert abs(np.corrcoef(units[0], units[1])[0, 1]) < 0.05 and abs(np.corrcoef(units[:, :-1].ravel(), units[:, 1:].ravel())[0, 1]) < 0.02
    assert all(0.05 < (units[0] < (b + 1) / 10).mean() - (units[0] < b / 10).mean() < 0.15 for b in range(10))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TEXTS = ["Male", "Female", "male", "", "Private", "Self-emp-inc", "Self-emp-not-inc", "Privat", "State"]


def test_substring_distance_and_prefix_test_against_brute_force(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    rows = df.select(
        "a", "b", scalar.substring_distance(F.col("a"), F.col("b")), scalar.too_similar(F.col("a"), F.col("b"))
    ).collect()
    for a, b, distance, near in rows:
        pieces = {b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)}
        assert distance == min(edits(a, p) for p in pieces)
        assert near == (min(edits(a, b[:i]) for i in range(len(b) + 1)) <= 2)


def test_fuzzy_closest_prefers_exact_then_first(spark):
    df = spark.createDataFrame(
        [("Private",), ("Privte",), ("emp",), ("zzzzzzzzzzzzzzzz",)], "v STRING"
    ).withColumn("c", F.array(*[F.lit(x) for x in ("Private", "Self-emp-inc", "Self-emp-not-inc")]))
    got = {r["v"]: r["x"] for r in df.select("v", scalar.fuzzy_closest(F.col("v"), F.col("c")).alias("x")).collect()}
    assert got == {"Private": "Private", "Privte": "Private", "emp": "Self-emp-inc", "zzzzzzzzzzzzzzzz": None}


def test_json_status_and_keys(spark):
    texts = [('{"a":1,"b":2}', "ok", True), ('{"b":2,"c":0,"a":1}', "ok", True), ('{"a":1}', "ok", False)]
    texts += [("[1]", "format_error", False), ("nope", "format_error", False), (None, "other_error", False)]
    df = spark.createDataFrame([(t,) for t, _, _ in texts], "t STRING")
    rows = df.select("t", scalar.json_parse_status(F.col("t")), scalar.has_all_keys(F.col("t"), ["a", "b"])).collect()
    assert {(r[0], r[1], r[2]) for r in rows} == set(texts)


def test_format_request_quotes_text_and_keeps_whole_numbers(spark):
    df = spark.createDataFrame([("39", 'say "hi"', "12.5", "007")], "`age.now` STRING, job STRING, x STRING, zip STRING")
    text = values(df.select(scalar.format_request(df.columns, ["age.now", "job"])))[0]
    assert json.loads(text) == {
        "age.now": 39, "job": 'say "hi"', "x": "12.5", "zip": "007", "Counterfactual.request": "age.now,job",
    }


def test_fixed_and_l1(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert values(df.select(scalar.l1_mean(F.col("a"), F.col("b")))) == [1.5]
    assert values(df.select(scalar.fixed(F.lit(math.pi), 3))) == [3.142]


def test_only_one_whole_json_object_is_ok(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} trailing', "{'a':1}", '{"a":1}{"b":2}', '[{"a":1}]', "1", "", '{"a":1},{"b":2}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [tuple(r) for r in rows.select(scalar.json_parse_status(F.col("t")), scalar.has_all_keys(F.col("t"), ["a"])).collect()]
    assert got == [("ok", True)] * 2 + [("format_error", False)] * 7 + [("other_error", False)]
