import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterfair.functions import scalar
from counterfair.operators import fuzzy


def distance(value, text):
    """Plain edit table with a free start and end in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(value):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(rng, n, alphabet="abcdé ", longest=14):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_automaton_is_the_edit_table():
    rng = random.Random(1)
    values = [*words(rng, 300), "", "x" * 64, "ab" * 40, "q" * 65, "日本語😀"]
    texts = [*words(rng, 300, longest=30), "", "x" * 70, "ba" * 60, "", "の日本話😀"]
    want = [distance(v, t) for v, t in zip(values, texts)]
    assert fuzzy.pair_distances(values, texts).tolist() == want
    text, length = fuzzy.letters(texts)
    for v in (*values[:20], *values[-5:]):
        assert fuzzy.value_distances(v, text, length, texts).tolist() == [distance(v, t) for t in texts]


def closest(value, choices, most):
    found = min(((distance(value, c), c) for c in choices), default=None)
    return found[1] if found and found[0] <= most else None


@pytest.mark.parametrize("block", [fuzzy.CHOICES, 40])
def test_closest_values_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(fuzzy, "CHOICES", block)
    monkeypatch.setattr(fuzzy, "VALUES", block)
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 16))) for _ in range(400)]
    choices = {"a": sorted(set(names)), "b": ["x", "xy", "yes", "no"]}
    values = [("a", n[: rng.randint(2, 20)].replace(rng.choice("abc"), rng.choice("xyz"), 1)) for n in names[:150]]
    values += [("a", v) for v in words(rng, 20)] + [("b", v) for v in ("ye", "n", "zzzzzzzzzzzzzzzzz", "")]
    values += [("c", "no choices"), ("a", None), ("a", "long " * 30), ("a", names[0]), ("a", names[0])]
    rows = [(c, v, i) for c, held in choices.items() for i, v in enumerate(held)]
    encoder = spark.createDataFrame(rows, "col STRING, value STRING, code BIGINT")
    got = fuzzy.closest_values(spark.createDataFrame(values, "col STRING, value STRING"), encoder, 6).collect()
    assert len(got) == len(set(values))
    for r in got:
        want = None if r["value"] is None else closest(r["value"], choices.get(r["col"], []), 6)
        assert (r["closest"], r["code"]) == (want, None if want is None else choices[r["col"]].index(want)), r


def test_index_settles_typos_among_many_choices(spark):
    """100,000 choices in one column: what the index settles is right, and no list of choices is made."""
    ids = spark.range(100_000).select(F.lit("c").alias("col"), F.md5(F.col("id").cast("string")).alias("choice"), F.col("id").alias("code"))
    typed = ids.where("code % 500 = 7").select("col", F.concat(F.substring("choice", 1, 9), F.lit("x"), F.substring("choice", 11, 12)).alias("value"), "choice")
    values = typed.select("col", "value")
    got = fuzzy._indexed(values, ids)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    best = {r["value"]: (r["d"], r["closest"]) for r in got.collect()}
    assert best == {r["value"]: (1, r["choice"]) for r in typed.collect()}
    few = typed.limit(5)
    whole = fuzzy.closest_values(few.select("col", "value"), ids.select("col", F.col("choice").alias("value"), "code"))
    assert {r["value"]: r["closest"] for r in whole.collect()} == {r["value"]: r["choice"] for r in few.collect()}


def test_column_form_agrees(spark):
    rng = random.Random(4)
    choices = sorted(set(words(rng, 12)))
    df = spark.createDataFrame([(v,) for v in words(rng, 30)], "v STRING")
    column = df.select("v", scalar.fuzzy_closest(F.col("v"), F.array(*map(F.lit, choices)), 3).alias("x")).collect()
    assert {r["v"]: r["x"] for r in column} == {r["v"]: closest(r["v"], choices, 3) for r in column}
    assert np.array_equal(fuzzy.pair_distances([], []), np.zeros(0))
