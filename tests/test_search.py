import numpy as np
import pytest
from pyspark.sql import functions as F

from counterfair.functions.scalar import mix_unit
from counterfair.operators import picks, score, search
from counterfair.plans.base import FEATURES, LOGISTIC, formula_mlp

BOUNDS = {"seg": (0, 4), "reg": (0, 4), "bal": (1, 10), "n_ord": (1, 20)}
BOTH = search.SearchSpace(BOUNDS, ("seg", "reg"))
REG = search.SearchSpace(BOUNDS, ("reg",))


@pytest.fixture(scope="module")
def seeds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *[int(rng.integers(lo, hi + 1)) for lo, hi in BOUNDS.values()]) for i in range(40)]
    return spark.createDataFrame(rows, "seed_id BIGINT, " + ", ".join(f"{f} INT" for f in FEATURES)).cache()


def in_bounds(rows, names):
    return all(BOUNDS[f][0] <= r[f] <= BOUNDS[f][1] for r in rows for f in names)


@pytest.mark.parametrize("model", [LOGISTIC, formula_mlp()])
def test_global_and_local_finds(seeds, model):
    rows = search.global_search(seeds, model, BOTH, max_iter=2, local_rounds=2).collect()
    keys = [(r["bal"], r["n_ord"]) for r in rows]
    assert len(keys) == len(set(keys)) and in_bounds(rows, ["bal", "n_ord"])
    assert {r["phase"] for r in rows} <= {"global", "local"} and all(r["seg"] == r["reg"] == 0 for r in rows)
    edges = np.arange(0, 1, 0.025)
    grid = BOTH.domain.grid()
    for r in rows:
        x = np.column_stack([grid, np.full(25, r["bal"]), np.full(25, r["n_ord"])]).astype(float)
        bins = np.digitize(model.proba(x), edges)
        assert (r["k"], r["spread"]) == (len(set(bins)), bins.max() - bins.min())


def test_search_repeats(seeds):
    first = search.global_search(seeds, LOGISTIC, BOTH, 1, 1).drop("elapsed")
    second = search.global_search(seeds, LOGISTIC, BOTH, 1, 1).drop("elapsed")
    assert sorted(first.collect()) == sorted(second.collect())


def flips(model, r):
    x = np.array([[r["seg"], v, r["bal"], r["n_ord"]] for v in range(5)], float)
    classes = model.proba(x) > 0.5
    return classes.any() and not classes.all()


@pytest.mark.parametrize("kind", ["adf", "neuron", "random"])
def test_single_attribute_searches(spark, seeds, kind):
    model = formula_mlp()
    if kind == "adf":
        found = search.adf_search(seeds, model, REG, max_iter=2, local_rounds=2)
    elif kind == "neuron":
        mask = [i % 2 for i in range(model.width(2))]
        found = search.neuron_guided_search(seeds, model, REG, 2, mask, max_iter=3, local_rounds=2)
    else:
        found = search.random_search(spark, model, REG, 60, local_rounds=2)
    rows = found.collect()
    keys = [(r["seg"], r["bal"], r["n_ord"]) for r in rows]
    assert rows and len(keys) == len(set(keys)) and in_bounds(rows, ["seg", "bal", "n_ord"])
    assert all(bool(r["disc"]) == flips(model, r) for r in rows)
    assert sum(r["disc"] for r in rows) > 0
    global_hits = [r["seed_id"] for r in rows if r["phase"] == "global" and r["disc"]]
    assert kind == "random" or len(global_hits) == len(set(global_hits))


def test_single_attribute_searches_reject_more(seeds):
    with pytest.raises(ValueError):
        search.adf_search(seeds, LOGISTIC, BOTH, 1)


def test_walk_weights_stay_probabilities():
    w = search.WalkWeights.uniform(3)
    w.update([(0, -1, 900, 0), (1, 1, 0, 900), (2, 1, 5, 0)])
    assert sum(w.feature) == pytest.approx(1) and w.feature[1] == 0 and all(0 <= d <= 1 for d in w.down)
    assert w.down[0] == 1.0 and w.down[2] < 0.5


def test_random_rows_cover_the_bounds(spark):
    rows = search.random_rows(spark, 2000, REG).collect()
    assert in_bounds(rows, FEATURES)
    for f in FEATURES:
        assert {r[f] for r in rows} == set(range(BOUNDS[f][0], BOUNDS[f][1] + 1))


def test_walkers_leave_a_find_only_when_their_hash_allows(spark):
    rows = [(i, 5, was, now, 4) for i, (was, now) in enumerate([(a, b) for a in (True, False) for b in (True, False)] * 50)]
    done = spark.createDataFrame(rows, "seed_id BIGINT, bal INT, _was_flips BOOLEAN, flips BOOLEAN, _was_bal INT")
    parts = [F.lit(0), F.col("seed_id"), F.lit(search.WALK), F.lit(3)]
    unit = mix_unit("accept", *parts)
    marked = done.withColumns({"lost": F.col("_was_flips") & ~F.col("flips"), "chance": unit, "tried": F.col("flips")})
    out = search._kept_position(marked, ["bal"], parts).collect()
    assert {r["lost"] and r["chance"] >= search.LEAVE for r in out} == {True, False}
    for r in out:
        stays = r["lost"] and r["chance"] >= search.LEAVE
        assert (r["bal"], r["flips"]) == ((4, True) if stays else (5, r["tried"]))


def test_guided_paths_hold_every_step_of_every_seed(seeds):
    def mover():
        return lambda x, twin, h: np.tile([0.0, 0.0, 1.0, 0.0], (len(x), 1))

    rows = search.guided_paths(seeds, LOGISTIC, REG, 2, ("feature",), mover).collect()
    start = {r["seed_id"]: r["bal"] for r in seeds.collect()}
    assert sorted((r["seed_id"], r["step"], r["bal"]) for r in rows) == [
        (i, n, min(bal + n, BOUNDS["bal"][1])) for i, bal in sorted(start.items()) for n in range(3)
    ]


@pytest.mark.parametrize("model", [LOGISTIC, formula_mlp()])
def test_paths_in_one_pass_are_the_steps_repeated(seeds, model):
    names = ["seed_id", "step", *FEATURES, "k", "spread", "low", "high"]
    got = search.search_paths(seeds, model, BOTH, 3, 0.0).select(*names).collect()
    state, want = seeds.withColumn("step", F.lit(0)), []
    for step in range(4):
        done = search.search_step(state, model, BOTH).cache()
        want += done.select(*names).collect()
        state = done.select("seed_id", F.lit(step + 1).alias("step"), *[F.col(f"next_{f}").alias(f) for f in FEATURES])
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_seed_with_a_null_feature_has_no_path(spark):
    rows = spark.createDataFrame([(1, 2, 2, 5, None), (2, 2, 2, 5, 9)], "seed_id BIGINT, seg INT, reg INT, bal INT, n_ord INT")
    assert {r["seed_id"] for r in search.search_paths(rows, LOGISTIC, BOTH, 2, 0.0).collect()} == {2}
    assert search.search_paths(rows.limit(0), LOGISTIC, BOTH, 2, 0.0).count() == 0
    measured = {r["seed_id"]: r["k"] for r in score.row_metrics(rows, LOGISTIC, BOTH.domain).collect()}
    assert measured[1] is None and measured[2] > 0
    picked = {r["seed_id"]: r["member"] for r in picks.partition_picks(rows, LOGISTIC, BOTH.domain, 0.025, F.col("seed_id")).collect()}
    assert picked[1] is None and picked[2] is not None


@pytest.mark.parametrize("model", [LOGISTIC, formula_mlp()])
def test_local_walks_in_one_pass_are_the_steps_repeated(seeds, model):
    state = seeds.select("seed_id", F.lit(0).alias("origin"), F.lit(1).alias("spread"), *FEATURES, F.lit(1).alias("_t_seg"), F.lit(3).alias("_t_reg"))
    got = search.local_search(state, model, BOTH, 5).collect()
    want = {}
    for step in range(5):
        done = search.local_step(state, model, BOTH, step).cache()
        for r in done.collect():
            key = (r["bal"], r["n_ord"])
            want[key] = min(want.get(key, (9,)), (step, r["seed_id"], r["k"], r["spread"]))
        back = [F.when(F.col("_keep"), F.col(f)).otherwise(F.col(f"_at_{f}")).alias(f) for f in FEATURES]
        spread = F.when(F.col("_keep"), F.col("spread")).otherwise(F.col("_spread")).alias("spread")
        state = done.select("seed_id", "origin", spread, *back, "_t_seg", "_t_reg")
    mine = {}
    for r in got:
        key = (r["bal"], r["n_ord"])
        mine[key] = min(mine.get(key, (9,)), (r["step"], r["seed_id"], r["k"], r["spread"]))
    assert mine == want


def test_trials_in_one_pass_are_searches_with_their_salts(spark, seeds):
    names = ["phase", "seed_id", "step", *FEATURES]
    got = search.search_trials(seeds, LOGISTIC, BOTH, 2, 2, 3).select("trial", *names).collect()
    want = []
    for t in range(2):
        space = search.SearchSpace(BOTH.bounds, BOTH.protected, BOTH.eps, salt=t)
        found = search.global_search(seeds, LOGISTIC, space, 2, 3).select(*names).collect()
        want += [(t, *r) for r in found]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[1:] for r in want if r[0] == 0} != {r[1:] for r in want if r[0] == 1}
    assert search.search_trials(seeds.limit(0), LOGISTIC, BOTH, 2, 1, 2).count() == 0
    assert search.search_trials(seeds, LOGISTIC, BOTH, 0, 1, 2).count() == 0


def test_local_walks_take_all_steps_of_the_reference(seeds):
    from counterfair.plans import search_plans

    assert search_plans.LOCAL_STEPS == 1000
    few = search.adf_search(seeds, formula_mlp(), REG, 1, search_plans.LOCAL_ROUNDS)
    rows = search.adf_search(seeds, formula_mlp(), REG, 1, search_plans.LOCAL_STEPS).filter("phase = 'local'").collect()
    assert max(r["step"] for r in rows) >= 50 and all(bool(r["disc"]) == flips(formula_mlp(), r) for r in rows)
    assert sum(r["disc"] for r in rows) > few.filter("phase = 'local' AND disc = 1").count()


@pytest.mark.parametrize("few, walkers", [(True, 1), (False, 6), (False, 1000)])
def test_adaptive_walk_in_one_stage_is_the_rounds_repeated(spark, seeds, monkeypatch, few, walkers):
    monkeypatch.setattr(search, "WALKERS", walkers)
    model, rounds = formula_mlp(), 6
    starts = seeds.where("seed_id < 2") if few else seeds
    got = search.adaptive_walk(starts, model, REG, rounds).collect()
    weights, want = search.WalkWeights.uniform(len(FEATURES)), {}
    walkers = starts.withColumn("flips", F.lit(True))
    for step in range(rounds):
        done = search.random_step(walkers, model, REG, weights, step).cache()
        rows = done.orderBy("seed_id").collect()
        counts = {}
        for r in rows:
            held = counts.setdefault((r["at"], r["direction"]), [0, 0])
            held[not r["flips"]] += 1
            key = (r["seg"], r["bal"], r["n_ord"])
            want[key] = min(want.get(key, (99,)), (step, r["seed_id"], r["flips"]))
        weights.update([(*k, *v) for k, v in sorted(counts.items())])
        walkers = search._kept_position(done, FEATURES, search._walk_parts(REG, step)).drop("at", "direction")
    mine = {}
    for r in got:
        key = (r["seg"], r["bal"], r["n_ord"])
        mine[key] = min(mine.get(key, (99,)), (r["step"], r["seed_id"], r["flips"]))
    assert mine == want


def test_earliest_matches_are_those_of_one_pass_in_order(spark):
    rng = np.random.default_rng(3)
    edges = {(int(rng.integers(0, 12)), int(s), int(rng.integers(0, 25))) for s in rng.integers(0, 40, 300)}
    edges = {(t, s): k for t, s, k in edges}  # one key per seed and step
    frame = spark.createDataFrame([(t, s, k) for (t, s), k in edges.items()], "step INT, seed_id INT, k INT")
    seeds_taken, keys_taken, want = set(), set(), set()
    for (t, s), k in sorted(edges.items()):
        if s not in seeds_taken and k not in keys_taken:
            seeds_taken.add(s)
            keys_taken.add(k)
            want.add((t, s, k))
    assert {tuple(r) for r in search.earliest_matches(frame, ["seed_id"], ["k"], ["step", "seed_id"]).collect()} == want
    assert search.earliest_matches(frame.limit(0), ["seed_id"], ["k"], ["step", "seed_id"]).count() == 0


def test_a_guided_seed_stops_at_its_first_new_find(spark, seeds):
    model = formula_mlp()
    rows = search.adf_search(seeds, model, REG, max_iter=6).collect()
    hits = [(r["step"], r["seed_id"]) for r in rows if r["disc"]]
    stop = {s: t for t, s in hits}
    assert len(stop) == len(hits) and all(r["step"] <= stop.get(r["seed_id"], 99) for r in rows)
    odd = spark.createDataFrame([(1, 2, None, 5, 9), (2, 2, 2, 5, 9)], "seed_id BIGINT, seg INT, reg INT, bal INT, n_ord INT")
    assert {r["seed_id"] for r in search.adf_search(odd, model, REG, 2).collect()} == {2}
    assert search.adf_search(odd.limit(0), model, REG, 2).count() == 0
