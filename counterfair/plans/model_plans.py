"""Queries over the network: scores, activations, gradients, layers and neurons."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterfair.functions.scalar import fixed
from counterfair.operators import debug, metrics, picks, score, train
from counterfair.operators.expand import expand_protected, flip_protected
from counterfair.operators.joins import attach_by_key
from counterfair.plans.base import (
    APPLICANTS_SQL,
    EPS,
    FEATURES,
    LOGISTIC,
    VARIANTS_SQL,
    WIDTHS,
    applicant_bounds,
    applicants,
    bin_sql,
    digest_sql,
    double,
    formula_mlp,
    probability_sql,
    protected_domain,
    query,
    rounded,
    table,
    weights_table,
)
from counterfair.session import broadcast_if_small, cut_lineage

HIDDEN_COUNT = len(WIDTHS) - 1
LAYER = 3
DIGITS = 6


def _cell(layer, i, j):
    return f"(((7 * {i} + 13 * {j} + 3 * {layer} + 77) % 11) - 5) / 10e0"


def _net_sql() -> str:
    """One row with w1…, b1… (per unit) and t1… (transposed, for gradients)."""
    columns, inputs = [], len(FEATURES)
    for n, width in enumerate(WIDTHS, start=1):
        w = _cell(n, "i", "j")
        columns.append(f"[[{w} for i in range(0, {inputs})] for j in range(0, {width})] AS w{n}")
        columns.append(f"[[{w} for j in range(0, {width})] for i in range(0, {inputs})] AS t{n}")
        columns.append(f"[{_cell(n, -1, 'j')} for j in range(0, {width})] AS b{n}")
        inputs = width
    return "net AS (SELECT " + ", ".join(columns) + ")"


def layer_sql(n: int, source: str) -> str:
    """List expression of layer n from the previous layer's list column."""
    z = f"list_dot_product({source}, w{n}[j]) + b{n}[j]"
    return f"[{f'greatest({z}, 0e0)' if n < len(WIDTHS) else z} for j in range(1, {WIDTHS[n - 1] + 1})]"


def forward_sql(source: str, name: str, start: int = 1, inputs: str | None = None) -> str:
    """CTEs name0…name6 that add h0…h6 to ``source``."""
    listed = inputs or f"[CAST(x AS DOUBLE) for x in [{', '.join(FEATURES)}]]"
    steps = [f"{name}{start - 1} AS (SELECT *, {listed} AS h{start - 1} FROM {source})"] if start == 1 else []
    for n in range(start, len(WIDTHS) + 1):
        steps.append(f"{name}{n} AS (SELECT s.*, {layer_sql(n, f'h{n - 1}')} AS h{n} FROM {name}{n - 1} s, net)")
    return ", ".join(steps)


P_SQL = rounded("1e0 / (1e0 + exp(h6[1] - h6[2]))", 9)
NET = _net_sql()
ROWS_SQL = f"{VARIANTS_SQL}, {NET}, {forward_sql('applicants', 'r')}"
WIDE_SQL = f"{VARIANTS_SQL}, {NET}, {forward_sql('raw_variants', 'f')}, mlp_scored AS (SELECT *, {P_SQL} AS mp FROM f6)"
K_SQL = f"""{WIDE_SQL}, mlp_binned AS (SELECT *, {bin_sql('mp')} AS mbin FROM mlp_scored),
mlp_k AS (SELECT row_id, CAST(count(DISTINCT mbin) AS INT) AS k, max(mp) AS p_max, min(mp) AS p_min FROM mlp_binned GROUP BY row_id)"""


@query("m1_score_mlp", f"WITH {WIDE_SQL} SELECT row_id, variant_id, mp AS p FROM mlp_scored")
def _(spark, sf):
    wide = expand_protected(applicants(spark, sf), protected_domain(spark, sf))
    return score.score_mlp(wide, formula_mlp()).select("row_id", "variant_id", "p")


@query(
    "m1_row_metrics",
    f"""WITH {K_SQL}, c AS (SELECT row_id, mbin, count(*) * 1e0 / (SELECT count(*) FROM segs, regs) AS share
        FROM mlp_binned GROUP BY row_id, mbin),
      e AS (SELECT row_id, {rounded('abs(-sum(share * log2(share)))', DIGITS)} AS sh_entropy,
        CAST(max(mbin) - min(mbin) AS INT) AS spread FROM c GROUP BY row_id)
      SELECT row_id, k, spread, sh_entropy, p_min, p_max FROM mlp_k JOIN e USING (row_id)""",
)
def _(spark, sf):
    measured = score.row_metrics(applicants(spark, sf), formula_mlp(), protected_domain(spark, sf), EPS)
    return measured.select(
        "row_id", "k", "spread", fixed(F.abs("sh_entropy"), DIGITS).alias("sh_entropy"), "p_min", "p_max"
    )


ACTS_SQL = f"""{ROWS_SQL}, acts AS ({' UNION ALL '.join(
    f'SELECT row_id, {n} AS layer, unnest(range(0, {WIDTHS[n - 1]})) AS neuron, unnest(h{n}) AS act FROM r6'
    for n in range(1, HIDDEN_COUNT + 1))})"""


@query(
    "m4_layer_outputs",
    f"WITH {ACTS_SQL} SELECT row_id, layer, CAST(neuron AS INT) AS neuron, {rounded('act', DIGITS)} AS act FROM acts",
)
def _(spark, sf):
    acts = score.layer_outputs(applicants(spark, sf), formula_mlp(), ["row_id"])
    return acts.select("row_id", "layer", F.posexplode("act").alias("neuron", "a")).select(
        "row_id", "layer", "neuron", fixed(F.col("a"), DIGITS).alias("act")
    )


@query(
    "m4_layer_outputs_relational",
    f"""WITH {ACTS_SQL}, outs AS (SELECT row_id, 6 AS layer, unnest(range(0, 2)) AS neuron, unnest(h6) AS act FROM r6)
      SELECT row_id, layer, CAST(neuron AS INT) AS neuron, {rounded('act', DIGITS)} AS act
      FROM (SELECT * FROM acts UNION ALL SELECT * FROM outs)""",
)
def _(spark, sf):
    long = score.layer_outputs_relational(applicants(spark, sf), weights_table(spark), FEATURES, "row_id")
    return long.withColumn("act", fixed(F.col("act"), DIGITS))


# Gradients: softmax minus target at the logits, pushed down through the transposed weights.
def backward_sql(source: str, name: str, top: int, delta: str) -> str:
    steps = [f"{name}{top} AS (SELECT *, {delta} AS d{top} FROM {source})"]
    for n in range(top, 0, -1):
        step = f"list_dot_product(d{n}, t{n}[i])"
        if n > 1:
            step = f"CASE WHEN h{n - 1}[i] > 0 THEN {step} ELSE 0e0 END"
        inputs = WIDTHS[n - 2] if n > 1 else len(FEATURES)
        steps.append(f"{name}{n - 1} AS (SELECT s.*, [{step} for i in range(1, {inputs + 1})] AS d{n - 1} FROM {name}{n} s, net)")
    return ", ".join(steps)


SOFT_SQL = "1e0 / (1e0 + exp(h6[2] - h6[1]))"
GRAD_SQL = f"""{ROWS_SQL}, soft AS (SELECT *, {SOFT_SQL} AS s0 FROM r6),
targeted AS (SELECT *, CASE WHEN s0 > 0.5 THEN 1e0 WHEN s0 = 0.5 THEN 0.5e0 ELSE 0e0 END AS y0 FROM soft),
{backward_sql('targeted', 'g', 6, '[s0 - y0, y0 - s0]')}"""


def _long_gradient(df, column="grad"):
    return df.select("row_id", F.posexplode(column).alias("pos", "g")).select(
        "row_id", "pos", fixed(F.col("g"), DIGITS).alias("g")
    )


def _long_gradient_sql(source: str) -> str:
    return (
        f"SELECT row_id, CAST(pos AS INT) AS pos, {rounded('g', DIGITS)} AS g FROM (SELECT row_id,"
        f" unnest(range(0, {len(FEATURES)})) AS pos, unnest(d0) AS g FROM {source})"
    )


@query("m6_input_gradient", f"WITH {GRAD_SQL} {_long_gradient_sql('g0')}")
def _(spark, sf):
    return _long_gradient(score.input_gradient(applicants(spark, sf), formula_mlp()))


@query(
    "m6_input_gradient_logistic",
    f"WITH {VARIANTS_SQL}, s AS (SELECT row_id, {probability_sql()} AS p FROM applicants), "
    f"l AS (SELECT row_id, unnest(range(0, {len(FEATURES)})) AS pos, "
    f"unnest([(p - CASE WHEN p > 0.5 THEN 1e0 ELSE 0e0 END) * w for w in [{', '.join(double(w) for w in LOGISTIC.weights)}]]) AS g FROM s) "
    f"SELECT row_id, CAST(pos AS INT) AS pos, {rounded('g', DIGITS)} AS g FROM l",
)
def _(spark, sf):
    return _long_gradient(score.input_gradient(applicants(spark, sf), LOGISTIC))


# Neuron scores of one layer under a flip of reg, and the mask of its upper half.
MASK_LAYER = 2
MASK_SQL = f"""reg_ends AS (SELECT min(reg) AS lo, max(reg) AS hi FROM applicants),
flipped AS (SELECT row_id, seg, CASE WHEN reg = lo THEN hi ELSE lo END AS reg, bal, n_ord FROM applicants, reg_ends),
{forward_sql('flipped', 'x')},
neuron_scores AS (SELECT neuron, round(avg(s), 9) AS score FROM (
    SELECT unnest(range(0, {WIDTHS[MASK_LAYER - 1]})) AS neuron, unnest(r.h{MASK_LAYER}) + unnest(x.h{MASK_LAYER}) AS s
    FROM r6 r JOIN x6 x USING (row_id)) GROUP BY neuron),
masked AS (SELECT neuron, score, CAST(score >= (SELECT score FROM neuron_scores ORDER BY score DESC LIMIT 1
    OFFSET {max(WIDTHS[MASK_LAYER - 1] // 2 - 1, 0)}) AS INT) AS mask FROM neuron_scores)"""
FLIPPED_SQL = f"{ROWS_SQL}, {MASK_SQL}"


def _mask(spark, sf):
    lo, hi = applicant_bounds(spark, sf)["reg"]
    scores = debug.neuron_scores(applicants(spark, sf), formula_mlp(), MASK_LAYER, "reg", lo, hi)
    return debug.neuron_mask(scores, WIDTHS[MASK_LAYER - 1])


@query("a16_neuron_mask", f"WITH {FLIPPED_SQL} SELECT CAST(neuron AS INT) AS neuron, {rounded('score', DIGITS)} AS score, mask FROM masked")
def _(spark, sf):
    return _mask(spark, sf).withColumn("score", fixed(F.col("score"), DIGITS))


def mask_values(spark, sf) -> list[int]:
    """The mask on the driver: one number per neuron of a layer."""
    return [r["mask"] for r in _mask(spark, sf).orderBy("neuron").collect()]


_W = WIDTHS[MASK_LAYER - 1]
PAIR_SQL = f"""{FLIPPED_SQL}, mask_list AS (SELECT list(mask ORDER BY neuron) AS m FROM masked),
pairs AS (SELECT r.*, [r.h{MASK_LAYER}[i] * m[i] for i in range(1, {_W + 1})] AS mine,
    [x.h{MASK_LAYER}[i] * m[i] for i in range(1, {_W + 1})] AS theirs, m
  FROM r6 r JOIN x6 x USING (row_id), mask_list),
exps AS (SELECT *, [exp(v - list_max(mine)) for v in mine] AS e FROM pairs),
deltas AS (SELECT *, list_sum(e) AS e_sum FROM exps),
{backward_sql('deltas', 'n', MASK_LAYER,
    f'[CASE WHEN h{MASK_LAYER}[i] > 0 THEN (e[i] / e_sum - theirs[i]) * m[i] ELSE 0e0 END for i in range(1, {_W + 1})]')}"""


@query("m7_pair_gradient_masked", f"WITH {PAIR_SQL} {_long_gradient_sql('n0')}")
def _(spark, sf):
    lo, hi = applicant_bounds(spark, sf)["reg"]
    rows = applicants(spark, sf).withColumn("reg2", flip_protected(F.col("reg"), lo, hi))
    others = ["reg2" if f == "reg" else f for f in FEATURES]
    mask = mask_values(spark, sf)
    return _long_gradient(score.pair_gradient_masked(rows, formula_mlp(), others, MASK_LAYER, mask, "grad"))


@query("m8_train_classifier")
def _(spark, sf):
    rows = applicants(spark, sf)
    model = train.train_classifier(rows, FEATURES, "label")
    return train.predict(rows, FEATURES, model).select("row_id", "label", F.col("prediction").cast("int").alias("cls"))


# Training on data with a known answer: what the model must say follows from the rows.
@query("m8_train_separable", f"WITH {APPLICANTS_SQL} SELECT row_id, CAST(bal > 5 AS INT) AS cls FROM applicants")
def _(spark, sf):
    side = F.when(F.col("bal") > 5, 1.0).otherwise(-1.0)
    rows = applicants(spark, sf).select("row_id", side.alias("x"), (F.col("seg") / 10).alias("y"), (F.col("bal") > 5).cast("int").alias("label"))
    model = train.train_classifier(rows, ["x", "y"], "label", hidden=[4])
    return train.predict(rows, ["x", "y"], model).select("row_id", F.col("prediction").cast("int").alias("cls"))


@query(
    "m10_separate_groups",
    f"WITH {APPLICANTS_SQL} SELECT row_id, min(row_id) OVER (PARTITION BY row_id % 4) AS first_mate FROM applicants",
)
def _(spark, sf):
    rows = applicants(spark, sf).select("row_id", (F.col("row_id") % 4 * 1000.0).alias("x"), F.col("bal").alias("y"))
    clustered, _ = train.seed_clusters(rows, ["x", "y"])
    firsts = clustered.groupBy("cluster").agg(F.min("row_id").alias("first_mate"))
    return clustered.join(F.broadcast(firsts), "cluster").select("row_id", "first_mate")


@query("m10_kmeans_seed_clusters")
def _(spark, sf):
    rows, _ = train.seed_clusters(applicants(spark, sf), FEATURES)
    return rows.select("row_id", "cluster")


DISTANCE_SQL = f"""{WIDE_SQL}, dist AS (SELECT a.row_id, {', '.join(
    f'max(list_sum([abs(a.h{n}[i] - b.h{n}[i]) for i in range(1, {WIDTHS[n - 1] + 1})]) / {WIDTHS[n - 1]}) AS d{n}'
    for n in range(1, HIDDEN_COUNT + 1))}
  FROM f6 a JOIN f6 b ON a.row_id = b.row_id AND a.variant_id < b.variant_id GROUP BY a.row_id)"""


def _earlier(n: int) -> str:
    return "0e0" if n == 1 else f"greatest({', '.join(f'd{i}' for i in range(1, n))}, 0e0)"


RATE_SQL = f"""{DISTANCE_SQL}, rates AS (SELECT row_id, {', '.join(
    f'(d{n} - {_earlier(n)}) / ({_earlier(n)} + 1e-7) AS r{n}' for n in range(1, HIDDEN_COUNT + 1))} FROM dist)"""


def _distances(spark, sf):
    return debug.pairwise_max_distance(applicants(spark, sf), formula_mlp(), protected_domain(spark, sf))


@query(
    "j6_pairwise_max_distance",
    f"WITH {DISTANCE_SQL} " + " UNION ALL ".join(
        f"SELECT row_id, {n} AS layer, {rounded(f'd{n}', 9)} AS distance FROM dist" for n in range(1, HIDDEN_COUNT + 1)
    ),
)
def _(spark, sf):
    long = _distances(spark, sf).select("row_id", F.posexplode("distance").alias("pos", "d"))
    return long.select("row_id", (F.col("pos") + 1).alias("layer"), fixed(F.col("d"), 9).alias("distance"))


@query(
    "j6_group_max_distance",
    f"""WITH {APPLICANTS_SQL}
      SELECT a.label, {rounded(f"max({' + '.join(f'abs(a.{f} - b.{f})' for f in FEATURES)}) / {len(FEATURES)}e0", DIGITS)} AS distance
      FROM applicants a JOIN applicants b ON a.label = b.label AND a.row_id <= b.row_id GROUP BY a.label""",
)
def _(spark, sf):
    dims = [F.col(f) for f in FEATURES]
    return debug.group_max_distance(applicants(spark, sf), "label", dims).withColumn("distance", fixed(F.col("distance"), DIGITS))


@query(
    "a17_layer_change_rate",
    f"WITH {RATE_SQL} " + " UNION ALL ".join(
        f"SELECT row_id, {n} AS layer, {rounded(f'r{n}', 4)} AS rate FROM rates" for n in range(2, HIDDEN_COUNT + 1)
    ),
)
def _(spark, sf):
    rated = _distances(spark, sf).withColumn("rate", debug.layer_change_rate(F.col("distance")))
    long = rated.select("row_id", F.posexplode("rate").alias("pos", "r")).filter(F.col("pos") > 0)
    return long.select("row_id", (F.col("pos") + 1).alias("layer"), fixed(F.col("r"), 4).alias("rate"))


_LATER = ", ".join(f"r{n}" for n in range(2, HIDDEN_COUNT + 1))


@query(
    "a18_biased_layer",
    f"""WITH {RATE_SQL}, best AS (SELECT greatest({_LATER}) AS top, {_LATER} FROM rates),
      picked AS (SELECT top, CASE {' '.join(f'WHEN r{n} = top THEN {n}' for n in range(2, HIDDEN_COUNT + 1))} END AS layer FROM best)
      SELECT (SELECT layer FROM picked GROUP BY layer ORDER BY count(*) DESC, layer LIMIT 1) AS layer,
        {rounded('avg(top)', 4)} AS layer_rate FROM picked""",
)
def _(spark, sf):
    rated = _distances(spark, sf).withColumn("rate", debug.layer_change_rate(F.col("distance")))
    return debug.biased_layer(rated).withColumn("layer_rate", fixed(F.col("layer_rate"), 4))


STATS_SQL = f"""{ACTS_SQL}, stats AS (SELECT layer, CAST(neuron AS INT) AS neuron, {rounded('min(act)', DIGITS)} AS act_min,
    {rounded('avg(act)', DIGITS)} AS act_mean FROM acts GROUP BY layer, neuron)"""


def _stats(spark, sf):
    stats = debug.neuron_stats(applicants(spark, sf), formula_mlp())
    return stats.withColumns({c: fixed(F.col(c), DIGITS) for c in ("act_min", "act_mean")})


@query("a15_neuron_stats", f"WITH {STATS_SQL} SELECT layer, neuron, act_min, act_mean FROM stats")
def _(spark, sf):
    return _stats(spark, sf)


@query("a15_neuron_stats_long", f"WITH {STATS_SQL} SELECT layer, neuron, act_min, act_mean FROM stats")
def _(spark, sf):
    acts = score.layer_outputs(applicants(spark, sf), formula_mlp(), ["row_id"])
    return debug.neuron_stats_long(acts).withColumns({c: fixed(F.col(c), DIGITS) for c in ("act_min", "act_mean")})


# Force grid of one layer over all applicants.
_FW = WIDTHS[LAYER - 1]
CONSTANTS_SQL = f"""{STATS_SQL}, constants AS (
  SELECT neuron, 0 AS force, act_min AS c FROM stats WHERE layer = {LAYER}
  UNION ALL SELECT neuron, 1, act_mean FROM stats WHERE layer = {LAYER})"""
_HELD = f"[CASE WHEN i - 1 = c.neuron THEN c.c ELSE s.h{LAYER}[i] END for i in range(1, {_FW + 1})]"


def _forced_sql(source: str, name: str, keep: str) -> str:
    head = f"{name}{LAYER} AS (SELECT {keep}, c.force, c.neuron, {_HELD} AS h{LAYER} FROM {source} s CROSS JOIN constants c)"
    return f"{head}, {forward_sql('', name, LAYER + 1)}"


GRID_SQL = f"""{CONSTANTS_SQL}, {forward_sql('raw_variants', 'f')},
{_forced_sql('f6', 'k', 's.row_id, s.variant_id')},
forced AS (SELECT row_id, force, neuron, CAST(count(DISTINCT {bin_sql('mp')}) AS INT) AS k
  FROM (SELECT row_id, force, neuron, {P_SQL} AS mp FROM k6) GROUP BY row_id, force, neuron),
{_forced_sql('r6', 'a', 's.row_id, s.label')},
forced_acc AS (SELECT force, neuron, round(avg(CAST((mp > 0.5) = (label > 0.5) AS INT)), 3) AS acc
  FROM (SELECT force, neuron, label, {P_SQL} AS mp FROM a6) GROUP BY force, neuron),
init AS (SELECT row_id, CAST(count(DISTINCT mbin) AS INT) AS init_k
  FROM (SELECT row_id, {bin_sql('mp')} AS mbin FROM (SELECT row_id, {P_SQL} AS mp FROM f6)) GROUP BY row_id),
base AS (SELECT round(avg(CAST(({P_SQL} > 0.5) = (label > 0.5) AS INT)), 3) AS acc FROM r6),
grid AS (SELECT row_id AS sample, force, neuron, k, acc, init_k
  FROM forced JOIN forced_acc USING (force, neuron) JOIN init USING (row_id))"""
EFFECTS_SQL = f"""kept AS (SELECT neuron, avg(CASE WHEN force = 0 THEN k END) AS k0, avg(CASE WHEN force = 1 THEN k END) AS k1, avg(init_k) AS ki
  FROM grid WHERE acc >= (SELECT acc FROM base) - 0.05e0 GROUP BY neuron),
effects AS (SELECT neuron, {rounded('(k1 - ki) / ki - (k0 - ki) / ki', DIGITS)} AS effect FROM kept)"""
FORCED_SQL = f"{GRID_SQL}, {EFFECTS_SQL}"


def _constants(spark, sf):
    rows = _stats(spark, sf).filter(F.col("layer") == LAYER).orderBy("neuron").collect()
    return [[r["act_min"] for r in rows], [r["act_mean"] for r in rows]]


@query("m5_force_neuron", f"WITH {FORCED_SQL} SELECT row_id, force, neuron, k FROM forced")
def _(spark, sf):
    rows = applicants(spark, sf)
    forced = score.forced_metrics(rows, formula_mlp(), protected_domain(spark, sf), LAYER, _constants(spark, sf), EPS)
    return forced.select("row_id", "force", "neuron", "k")


@query("m5_force_neuron_accuracy", f"WITH {FORCED_SQL} SELECT force, neuron, acc FROM forced_acc")
def _(spark, sf):
    return score.forced_accuracy(applicants(spark, sf), formula_mlp(), "label", LAYER, _constants(spark, sf))


def _grid(spark, sf, rows):
    model, domain, forces = formula_mlp(), protected_domain(spark, sf), _constants(spark, sf)
    measured = score.row_metrics(rows, model, domain, EPS).select(
        F.col("row_id").alias("sample"), *FEATURES, F.col("k").alias("init_k")
    )
    grid = score.forced_metrics(measured, model, domain, LAYER, forces, EPS)
    acc = cut_lineage(score.forced_accuracy(rows, model, "label", LAYER, forces))
    return attach_by_key(grid, broadcast_if_small(acc), ["force", "neuron"])


def _base_accuracy(rows) -> float:
    scored = score.score_mlp(rows, formula_mlp())
    return score.accuracy(scored.withColumn("cls", score.predict_class(F.col("p"))), "cls", "label").first()["accuracy"]


def _grid_effects(spark, sf):
    """The force grid of all applicants, their accuracy, and the effect of each neuron.

    Applicants are read by every part, and effects, a row per neuron, by every later step: both are written once, so that
    no plan holds them twice.
    """
    rows = cut_lineage(applicants(spark, sf))
    grid, base = _grid(spark, sf, rows), _base_accuracy(rows)
    return grid, base, cut_lineage(debug.neuron_effect(grid, base).withColumn("effect", fixed(F.col("effect"), DIGITS)))


def _effects(spark, sf):
    return _grid_effects(spark, sf)[2].filter(F.col("effect").isNotNull())


@query("a19_neuron_effect", f"WITH {FORCED_SQL} SELECT neuron, effect FROM effects WHERE effect IS NOT NULL")
def _(spark, sf):
    return _effects(spark, sf)


PLACES_SQL = """signed AS (SELECT neuron, effect, CASE WHEN effect < 0 THEN 'pos' ELSE 'neg' END AS direction
  FROM effects WHERE effect <> 0),
places AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(effect) DESC, neuron DESC) AS place FROM signed),
slots AS (SELECT direction, place FROM (VALUES ('pos'), ('neg')) d(direction), (VALUES (1), (2), (3)) p(place)),
ranked AS (SELECT slots.direction, slots.place, coalesce(neuron, -1) AS neuron, effect FROM slots LEFT JOIN places USING (direction, place))"""
TOP_SQL = f"{FORCED_SQL}, {PLACES_SQL}"


@query("t2_top_neurons", f"WITH {TOP_SQL} SELECT direction, place, neuron, effect FROM ranked")
def _(spark, sf):
    top = picks.top_neurons(_effects(spark, sf))
    return top.withColumn("neuron", F.coalesce("neuron", F.lit(-1)))


REPORT = ["a", "k", "a_deactivated", "k_deactivated", "a_activated", "k_activated"]


def _chosen(direction: str, force: int, value: str) -> str:
    worst = f"neuron = (SELECT neuron FROM ranked WHERE direction = '{direction}' AND place = 1)"
    return f"avg(CASE WHEN force = {force} AND {worst} THEN {value} END)"


REPORTED_SQL = (
    f"reported AS (SELECT (SELECT acc FROM base) AS a, avg(init_k) AS k,"
    f" {_chosen('neg', 0, 'acc')} AS a_deactivated, {_chosen('neg', 0, 'k')} AS k_deactivated,"
    f" {_chosen('pos', 1, 'acc')} AS a_activated, {_chosen('pos', 1, 'k')} AS k_activated FROM grid)"
)


@query(
    "a20_debug_report",
    f"WITH {TOP_SQL}, {REPORTED_SQL} SELECT " + ", ".join(f"{rounded(c, DIGITS)} AS {c}" for c in REPORT) + " FROM reported",
)
def _(spark, sf):
    grid, base, effects = _grid_effects(spark, sf)
    report = debug.debug_report(grid, picks.top_neurons(effects), base)
    return report.select(*[fixed(F.col(c), DIGITS).alias(c) for c in REPORT])


# The whole debugging run on a sample of the discriminatory rows; the biased layer is found, so the
# grid is written for every later layer and only the found one gets constants.
SAMPLES = 200
TOP = SAMPLES // 5


def _debug_run_sql() -> str:
    parts, grids, accs = [], [], []
    for layer in range(2, HIDDEN_COUNT + 1):
        held = f"[CASE WHEN i - 1 = c.neuron THEN c.c ELSE s.h{layer}[i] END for i in range(1, {WIDTHS[layer - 1] + 1})]"
        parts.append(f"""con{layer} AS (SELECT neuron, 0 AS force, act_min AS c FROM raw_stats WHERE layer = {layer} AND layer = (SELECT layer FROM biased)
  UNION ALL SELECT neuron, 1, act_mean FROM raw_stats WHERE layer = {layer} AND layer = (SELECT layer FROM biased)),
v{layer}_{layer} AS (SELECT s.row_id, s.variant_id, c.force, c.neuron, {held} AS h{layer}
  FROM f6 s CROSS JOIN con{layer} c WHERE s.row_id IN (SELECT row_id FROM samples)),
{forward_sql('', f'v{layer}_', layer + 1)},
u{layer}_{layer} AS (SELECT s.row_id, s.label, c.force, c.neuron, {held} AS h{layer} FROM r6 s CROSS JOIN con{layer} c),
{forward_sql('', f'u{layer}_', layer + 1)}""")
        grids.append(f"SELECT row_id, force, neuron, {P_SQL} AS mp FROM v{layer}_6")
        accs.append(f"SELECT force, neuron, label, {P_SQL} AS mp FROM u{layer}_6")
    return f"""{RATE_SQL}, {forward_sql('applicants', 'r')},
acts AS ({' UNION ALL '.join(
    f'SELECT {n} AS layer, unnest(range(0, {WIDTHS[n - 1]})) AS neuron, unnest(h{n}) AS act FROM r6' for n in range(1, HIDDEN_COUNT + 1))}),
raw_stats AS (SELECT layer, CAST(neuron AS INT) AS neuron, min(act) AS act_min, avg(act) AS act_mean FROM acts GROUP BY layer, neuron),
mlp_k AS (SELECT row_id, CAST(count(DISTINCT {bin_sql('mp')}) AS INT) AS k, max(mp) AS p_max, min(mp) AS p_min FROM mlp_scored GROUP BY row_id),
found AS (SELECT * FROM mlp_k WHERE p_max > 0.5 AND p_min < 0.5),
samples AS (SELECT row_id, row_id * 2 AS sample, k AS init_k FROM (SELECT * FROM found ORDER BY k DESC, row_id LIMIT {TOP})
  UNION ALL SELECT row_id, row_id * 2 + 1, k FROM (SELECT * FROM found ORDER BY {digest_sql("'0'", "CAST(row_id AS VARCHAR)")}, row_id LIMIT {SAMPLES - TOP})),
best AS (SELECT greatest({_LATER}) AS top, {_LATER} FROM samples JOIN rates USING (row_id)),
picked AS (SELECT CASE {' '.join(f'WHEN r{n} = top THEN {n}' for n in range(2, HIDDEN_COUNT + 1))} END AS layer FROM best),
biased AS (SELECT layer FROM picked GROUP BY layer ORDER BY count(*) DESC, layer LIMIT 1),
{', '.join(parts)},
forced AS (SELECT row_id, force, neuron, CAST(count(DISTINCT {bin_sql('mp')}) AS INT) AS k FROM ({' UNION ALL '.join(grids)}) GROUP BY row_id, force, neuron),
forced_acc AS (SELECT force, neuron, round(avg(CAST((mp > 0.5) = (label > 0.5) AS INT)), 3) AS acc FROM ({' UNION ALL '.join(accs)}) GROUP BY force, neuron),
base AS (SELECT round(avg(CAST(({P_SQL} > 0.5) = (label > 0.5) AS INT)), 3) AS acc FROM r6),
grid AS (SELECT sample, force, neuron, k, acc, init_k FROM samples JOIN forced USING (row_id) JOIN forced_acc USING (force, neuron)),
{EFFECTS_SQL}, {PLACES_SQL}, {REPORTED_SQL}"""


@query("g6_neuron_debug", f"WITH {_debug_run_sql()} SELECT (SELECT layer FROM biased) AS layer, " + ", ".join(f"{rounded(c, DIGITS)} AS {c}" for c in REPORT) + " FROM reported")
def _(spark, sf):
    rows, model, domain = applicants(spark, sf), formula_mlp(), protected_domain(spark, sf)
    measured = score.row_metrics(rows, model, domain, EPS)
    found = measured.filter(metrics.discriminatory_score(F.col("p_min"), F.col("p_max")) == 1)
    run = debug.neuron_debug(rows, found, model, domain, "row_id", "label", samples=SAMPLES, eps=EPS)
    layer = run["layer"].select("layer").scalar()
    return run["report"].select(layer.alias("layer"), *[fixed(F.col(c), DIGITS).alias(c) for c in REPORT])
