import math

from counterfair.operators import metrics, picks


def test_absent_ranks_are_zero(spark):
    df = spark.createDataFrame([(1, 4), (2, 4)], "row_id INT, k INT")
    row = metrics.top_k_frequencies(df).first()
    assert (row["ik1f"], row["ik2f"], row["ik3f"]) == (2, 0, 0)


def test_mixed_groups_need_both_labels(spark):
    rows = [(g, label) for g, labels in enumerate(([0, 0, 1], [1, 1, 1], [0, 0, 0])) for label in labels]
    df = spark.createDataFrame(rows, "g INT, label INT")
    assert metrics.mixed_group_count(df, ["g"], 3).first()[0] == 2
    row = metrics.mixed_group_instances(df, ["g"], 3).first()
    assert (row["mixed"], row["success_pct"]) == (1, 33.3)


def test_success_rate_forms(spark):
    df = spark.createDataFrame([("local", 1), ("local", 0), ("local", 0)], "phase STRING, hit INT")
    row = metrics.success_rate(df, "hit").first()
    assert (row["found"], row["tried"], row["rate"], row["rate_plus_one"]) == (1, 3, 33.3, 25.0)


def test_mean_and_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x DOUBLE")
    got = {r["stat"]: r["x"] for r in metrics.mean_std_over_trials(df, ["x"]).collect()}
    assert got == {"mean": 2.0, "std": 1.0}


def test_report_without_local_phase(spark):
    df = spark.createDataFrame([(0, "global", 1, 2.0), (0, "global", 0, 3.0)], "trial INT, phase STRING, disc INT, elapsed DOUBLE")
    row = metrics.compare_report(df, ["trial"], 2).first()
    assert (row["g_disc"], row["l_disc"], row["tot_disc"], row["local_succ"]) == (1, 0, 1, None)
    assert (row["time_to_first"], row["time_to_n"]) == (2.0, None)


def test_first_flipping_value(spark):
    rows = [("a", 2, v, int(v >= 2)) for v in range(4)] + [("b", 0, v, 1) for v in range(4)]
    df = spark.createDataFrame(rows, "id STRING, own INT, v INT, label INT")
    got = {r["id"]: (r["disc"], r["first_value"]) for r in metrics.discriminatory_label(df, "id", "v", "own").collect()}
    assert got == {"a": (1, 0), "b": (0, None)}


def test_entropy_of_one_bin_is_zero(spark):
    df = spark.createDataFrame([(1, 5, 0.2), (1, 5, 0.21), (2, 1, 0.1), (2, 2, 0.2)], "row_id INT, bin INT, p DOUBLE")
    got = {r["row_id"]: r["sh_entropy"] for r in metrics.shannon_entropy(df, "row_id").collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_top_neurons_missing_places_are_null(spark):
    df = spark.createDataFrame([(0, 0.5), (1, -0.25), (2, 0.0), (3, 0.75)], "neuron INT, effect DOUBLE")
    got = {(r["direction"], r["place"]): r["neuron"] for r in picks.top_neurons(df).collect()}
    assert got == {("neg", 1): 3, ("neg", 2): 0, ("neg", 3): None, ("pos", 1): 1, ("pos", 2): None, ("pos", 3): None}


def test_partition_members_cover_all_variants(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 4)], "row_id INT, v INT, bin INT")
    parts = metrics.score_partitions(df, "row_id", ["v"]).collect()
    assert {(p["bin"], p["n"], tuple(m["v"] for m in p["members"])) for p in parts} == {(3, 2, (0, 1)), (4, 1, (2,))}
    assert math.isclose(sum(p["n"] for p in parts), 3)
