import numpy as np
import pytest
from pyspark.sql import functions as F

from counterfair.functions.models import LogisticModel, MlpModel, mlp_from_table
from counterfair.operators import debug, metrics, picks, score
from counterfair.operators.expand import Domain, expand_protected, neighbour_join
from counterfair.plans.base import EPS, FEATURES, LOGISTIC, formula_mlp, weights_table

DOMAIN = Domain.of({"seg": (0, 4), "reg": (0, 4)})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(a), int(b), int(c), int(d), int(e)) for i, (a, b, c, d, e) in enumerate(
        zip(rng.integers(0, 5, 60), rng.integers(0, 5, 60), rng.integers(1, 11, 60), rng.integers(1, 21, 60), rng.integers(0, 2, 60))
    )]
    return spark.createDataFrame(data, "row_id BIGINT, seg INT, reg INT, bal INT, n_ord INT, label INT").cache()


def matrix(rows):
    return np.array([[r[f] for f in FEATURES] for r in rows.orderBy("row_id").collect()], float)


def off_lattice(rows):
    """Inputs away from the kinks of the ReLUs, where the slope is defined."""
    x = matrix(rows)
    return x + np.random.default_rng(9).uniform(0.01, 0.2, x.shape)


def own_class_loss(model, x, target):
    p = model.softmax(model.activations(x)[-1])
    return -np.log(p[np.arange(len(x)), target])


def test_network_gradient_matches_finite_differences(rows):
    model, x = formula_mlp(), off_lattice(rows)
    target = model.activations(x)[-1].argmax(axis=1)
    got = model.gradient(x)
    for i in range(x.shape[1]):
        up, down = x.copy(), x.copy()
        up[:, i] += 1e-6
        down[:, i] -= 1e-6
        slope = (own_class_loss(model, up, target) - own_class_loss(model, down, target)) / 2e-6
        assert got[:, i] == pytest.approx(slope, abs=1e-4)


def test_pair_gradient_matches_finite_differences(rows):
    model, x, layer = formula_mlp(), off_lattice(rows), 2
    other = x.copy()
    other[:, 1] = 4 - other[:, 1]
    mask = (np.arange(model.width(layer)) % 2).astype(float)
    labels = model.activations(other, layer)[-1] * mask

    def loss(v):
        logits = model.activations(v, layer)[-1] * mask
        # d/dz of this is softmax(z) - labels, the gradient the operator propagates.
        return np.log(np.exp(logits).sum(axis=1)) - (labels * logits).sum(axis=1)

    got = model.pair_gradient(x, other, layer, mask)
    for i in range(x.shape[1]):
        up, down = x.copy(), x.copy()
        up[:, i] += 1e-6
        down[:, i] -= 1e-6
        assert got[:, i] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-3, abs=1e-3)


def test_weights_table_round_trip(spark, rows):
    widths = [w.shape[1] for w, _ in formula_mlp().layers]
    model = mlp_from_table(weights_table(spark), FEATURES, widths)
    assert np.allclose(model.proba(matrix(rows)), formula_mlp().proba(matrix(rows)))
    for wrong in (widths[:-1], [*widths, 2], [widths[0] + 1, *widths[1:]], [widths[0] - 1, *widths[1:]]):
        with pytest.raises(ValueError):
            mlp_from_table(weights_table(spark), FEATURES, wrong)


@pytest.mark.parametrize("layer", [1, 3, 5])
def test_forced_neurons_by_rank_one_updates(rows, layer):
    model, x = formula_mlp(), matrix(rows)
    hidden = model.activations(x, layer)[-1]
    cells = [(n, v) for n in range(model.width(layer)) for v in (0.0, 0.7, 3.0)]
    for (n, v), p in zip(cells, model.forced_probas(hidden, layer, cells)):
        assert np.allclose(p, model.proba_forced(hidden, layer, n, v), atol=2e-9)


def test_logistic_column_equals_matrix_form(rows):
    got = [r["p"] for r in score.score_logistic(rows, LOGISTIC).orderBy("row_id").collect()]
    assert got == LOGISTIC.proba(matrix(rows)).tolist()


def test_expansion_size_and_variant_numbers(rows):
    wide = expand_protected(rows, DOMAIN)
    assert wide.count() == rows.count() * DOMAIN.size
    sample = wide.filter("row_id = 0").select("variant_id", "seg", "reg", DOMAIN.value("seg", F.col("variant_id")).alias("s"),
                                               DOMAIN.value("reg", F.col("variant_id")).alias("r")).collect()
    assert sorted(r["variant_id"] for r in sample) == list(range(25))
    assert all(r["seg"] == r["s"] and r["reg"] == r["r"] for r in sample)
    assert [tuple(g) for g in DOMAIN.grid()[:6]] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0)]


def test_neighbours_stay_in_bounds(rows):
    near = neighbour_join(rows, {"bal": (1, 10), "n_ord": (1, 20)}).collect()
    assert len(near) == rows.count() * 4 and all(1 <= r["bal"] <= 10 and 1 <= r["n_ord"] <= 20 for r in near)


@pytest.mark.parametrize("model", [LOGISTIC, formula_mlp()])
def test_narrow_metrics_equal_grouped_metrics(rows, model):
    narrow = score.row_metrics(rows, model, DOMAIN, EPS).orderBy("row_id").collect()
    variants = metrics.add_bin(score.score(expand_protected(rows, DOMAIN), model), EPS)
    grouped = metrics.partition_report(variants, "row_id").orderBy("row_id").collect()
    for a, b in zip(narrow, grouped):
        assert (a["k"], a["spread"]) == (b["k"], b["spread"])
        assert a["sh_entropy"] == pytest.approx(b["sh_entropy"], abs=1e-9)
        assert 1 <= a["k"] <= min(40, DOMAIN.size) and a["sh_entropy"] <= np.log2(a["k"]) + 1e-9
        assert int(a["p_max"] > 0.5 and a["p_min"] < 0.5) == b["disc"]


def test_large_batches_are_cut_without_changing_results(rows, monkeypatch):
    whole = score.variant_scores(matrix(rows), FEATURES, formula_mlp(), DOMAIN)
    monkeypatch.setattr(score, "MATRIX_ROWS", 30)
    assert np.array_equal(whole, score.variant_scores(matrix(rows), FEATURES, formula_mlp(), DOMAIN))


def test_pairwise_distance_against_all_pairs(rows):
    model = formula_mlp()
    got = debug.pairwise_max_distance(rows, model, DOMAIN).orderBy("row_id").collect()
    x = matrix(rows)
    for r, row in list(zip(got, x))[:10]:
        wide = np.repeat(row[None, :], 25, axis=0)
        wide[:, :2] = DOMAIN.grid()
        for layer, act in enumerate(model.activations(wide)[:-1]):
            best = max(np.abs(act[i] - act[j]).mean() for i in range(25) for j in range(i))
            assert r["distance"][layer] == pytest.approx(best)


def test_group_distance_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(v)], "g INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = {r["g"]: r["distance"] for r in debug.group_max_distance(df, "g", [F.col(c) for c in "abcd"]).collect()}
    for g in range(3):
        part = v[g::3]
        assert got[g] == pytest.approx(max(np.abs(p - q).mean() for p in part for q in part))


def test_picks_against_plain_python():
    bins = np.array([[3, 1, 1, 3, 7], [2, 2, 2, 2, 2], [0, 5, 4, 3, 9]])
    hashes = np.array([[0, 1, 0, 0], [3, 4, 7, 9], [5, 6, 7, 8]])
    got = picks.pick_variants(bins, hashes).tolist()
    # Row 0: bins 3 and 1 both hold two variants; 3 comes first.
    assert got == [[3, 6, 0, 3, 1, 4], [1, 0, 3, 4, 2, 4], [5, 9, 0, 0, 0, 4]]


def test_forcing_a_neuron(rows):
    model, x = formula_mlp(), matrix(rows)
    hidden = model.activations(x, 3)[-1]
    kept = hidden[:, 5]
    same = np.array([model.proba_forced(hidden[i : i + 1], 3, 5, kept[i])[0] for i in range(len(x))])
    assert np.allclose(same, model.proba(x))
    forced = score.forced_accuracy(rows, model, "label", 3, [[0.0] * 16, [1.0] * 16]).collect()
    truth = np.array([r["label"] for r in rows.orderBy("row_id").collect()])
    for r in forced:
        p = model.proba_forced(hidden, 3, r["neuron"], float(r["force"]))
        assert r["acc"] == pytest.approx(round(((p > 0.5) == (truth > 0.5)).mean(), 3), abs=1e-9)


def test_debug_run_reports(rows):
    found = score.row_metrics(rows, formula_mlp(), DOMAIN, EPS)
    parts = debug.neuron_debug(rows, found, formula_mlp(), DOMAIN, "row_id", "label", samples=20)
    layer = parts["layer"].first()["layer"]
    width = formula_mlp().width(layer)
    assert 2 <= layer <= 5 and parts["grid"].count() == 20 * 2 * width and parts["top"].count() == 6
    assert parts["report"].first()["k"] > 1


def test_biased_layer_tie_goes_to_the_lower_layer(spark):
    df = spark.createDataFrame([([9.0, 1.0, 0.0],), ([9.0, 0.0, 1.0],)], "rate ARRAY<DOUBLE>")
    row = debug.biased_layer(df).first()
    assert (row["layer"], row["layer_rate"]) == (2, 1.0)


def test_two_class_tie_is_class_zero(spark):
    assert spark.range(1).select(score.predict_class(F.lit(0.5))).first()[0] == 0
    half = LogisticModel(("a",), (0.0,), 0.0)
    assert half.proba(np.array([[1.0]])).tolist() == [0.5]
    assert isinstance(formula_mlp(), MlpModel)


@pytest.mark.parametrize("eps", [0.025, 0.1, 0.01, 1 / 3])
def test_array_bins_are_digitize(eps):
    edges = np.arange(0, 1, eps)
    p = np.concatenate([edges, np.nextafter(edges, 2), np.nextafter(edges, -1)[1:], [1.0], np.random.default_rng(2).random(4000)])
    assert np.array_equal(score.score_bins(p, eps), np.digitize(p, edges) - 1)
    rows = score.score_bins(np.random.default_rng(3).random((50, 30)), eps)
    assert score.distinct_bins(rows, score.bin_count(eps)).tolist() == [len(set(r)) for r in rows]


@pytest.mark.parametrize("size", [1, 2, 25, 200])
def test_widest_pair_by_pivots_is_that_of_all_pairs(size):
    rng = np.random.default_rng(size)
    model = formula_mlp()
    x = np.column_stack([rng.integers(lo, hi, 12 * size) for lo, hi in ((0, 5), (0, 5), (1, 11), (1, 21))]).astype(float)
    for act in [*model.activations(x)[:-1], rng.random((12 * size, 6)), np.zeros((12 * size, 4))]:
        a = act.reshape(12, size, -1)
        got, made = debug.widest_pair(a)
        want = np.array([max((np.abs(r[i] - r[j]).mean() for i in range(size) for j in range(i)), default=0.0) for r in a])
        assert np.allclose(got, want, rtol=1e-12, atol=0)
        assert made <= 12 * (size * (size - 1) // 2 + debug.PIVOTS * size)
        if size == 200 and act is not x and act.shape[1] > 6:
            assert made < 0.5 * 12 * size * (size - 1) / 2  # 19,900 pairs a row
