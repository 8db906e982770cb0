"""Queries over the searches. Their SQL unrolls the rounds as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.operators import metrics, search, train
from counterfair.plans.base import (
    APPLICANTS_SQL,
    DOMAIN_SQL,
    FEATURES,
    FREE,
    LOGISTIC,
    PROTECTED,
    WIDTHS,
    applicants,
    bin_sql,
    digest_sql,
    double,
    formula_mlp,
    mix_sql,
    probability_sql,
    query,
    rounded,
    space,
    table,
)
from counterfair.plans.metric_plans import REPORT_COLUMNS
from counterfair.plans.model_plans import (
    MASK_LAYER,
    MASK_SQL,
    NET,
    P_SQL,
    SOFT_SQL,
    backward_sql,
    forward_sql,
    mask_values,
)
from counterfair.session import shared_path
from counterfair.sources import tables

MAX_ITER = 10
GUIDED_MOVES = 40
LOCAL_ROUNDS = 4  # of the queries whose SQL unrolls the rounds
SALT = "/*salt*/ 0"  # of a search without trials; that of a trial takes its place
LOCAL_STEPS = 1000  # of a walker in the reference


def seeds(spark, sf) -> DataFrame:
    return applicants(spark, sf).select(F.col("row_id").alias("seed_id"), *FEATURES)


# SQL building blocks shared by the searches.
HEAD_SQL = f"""{APPLICANTS_SQL}, {DOMAIN_SQL},
limits AS (SELECT {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in FEATURES)},
  max(reg) - min(reg) + 1 AS reg_span FROM applicants),
seeds AS (SELECT row_id AS seed_id, 0 AS step, seg, reg, bal, n_ord FROM applicants)"""


def _hash(tag: str, *parts: str) -> str:
    return digest_sql(f"'{tag}'", f"CAST({SALT} AS VARCHAR)", *[f"CAST({p} AS VARCHAR)" for p in parts])


def _unit(tag: str, *parts: str) -> str:
    return f"({mix_sql(tag, SALT, *parts)} / 4294967296e0)"


def _clip(feature: str, expr: str) -> str:
    return f"CAST(least(greatest({expr}, lo_{feature}), hi_{feature}) AS INT)"


class LogisticSql:
    """Scores and gradients of the logistic model as SQL expressions over feature columns."""

    ctes = ""

    def prob(self, **names: str) -> str:
        sql = probability_sql("@")
        for f in FEATURES:
            sql = sql.replace(f"@{f} ", f"{names.get(f, f)} ")
        return sql

    def gradient(self, feature: str, **names: str) -> str:
        p = self.prob(**names)
        return f"(({p} - CAST({p} > 0.5 AS INT)) * {double(LOGISTIC.weights[FEATURES.index(feature)])})"


SPAN = {f: f"(SELECT hi_{f} - lo_{f} + 1 FROM limits)" for f in FEATURES}
GRID = ", ".join(f"(SELECT unnest(range(lo_{f}, hi_{f} + 1)) AS {f} FROM limits) d_{f}" for f in FEATURES)


def _code(**names: str) -> str:
    """Place of a state in the lists of the lookup row, counted like an odometer from 1."""
    number = "0"
    for f in FEATURES:
        number = f"({number}) * {SPAN[f]} + {names.get(f, f)} - (SELECT lo_{f} FROM limits)"
    return f"{number} + 1"


class NetworkSql:
    """The same for the network: every state within bounds is scored once, then looked up."""

    ctes = f""", {NET}, states AS (SELECT * FROM {GRID}), {forward_sql('states', 'sf')},
{backward_sql(f'(SELECT *, CASE WHEN s0 > 0.5 THEN 1e0 WHEN s0 = 0.5 THEN 0.5e0 ELSE 0e0 END AS y0 FROM (SELECT *, {SOFT_SQL} AS s0 FROM sf6))',
    'sg', 6, '[s0 - y0, y0 - s0]')},
lookup AS (SELECT list(mp ORDER BY code) AS ps, {', '.join(f'list({rounded(f"d0[{i + 1}]", 12)} ORDER BY code) AS g_{f}' for i, f in enumerate(FEATURES))}
  FROM (SELECT *, {P_SQL} AS mp, {_code()} AS code FROM sg0))"""

    def prob(self, **names: str) -> str:
        return f"(SELECT ps FROM lookup)[{_code(**names)}]"

    def gradient(self, feature: str, **names: str) -> str:
        return f"(SELECT g_{feature} FROM lookup)[{_code(**names)}]"


class PairSql(NetworkSql):
    """Gradients between masked hidden vectors of a state and its twin under another reg."""

    ctes = NetworkSql.ctes + f""", {forward_sql('applicants', 'own')}, {MASK_SQL.replace('FROM r6 r', 'FROM own6 r')},
mask_list AS (SELECT list(mask ORDER BY neuron) AS m FROM masked),
twins AS (SELECT a.*, b.reg AS t_reg, b.h{MASK_LAYER} AS th FROM sf{MASK_LAYER} a JOIN sf{MASK_LAYER} b
  ON a.seg = b.seg AND a.bal = b.bal AND a.n_ord = b.n_ord),
twin_mine AS (SELECT t.*, m, [h{MASK_LAYER}[i] * m[i] for i in range(1, {WIDTHS[MASK_LAYER - 1] + 1})] AS mine,
    [th[i] * m[i] for i in range(1, {WIDTHS[MASK_LAYER - 1] + 1})] AS theirs FROM twins t, mask_list),
twin_exp AS (SELECT *, [exp(v - list_max(mine)) for v in mine] AS e FROM twin_mine),
twin_sum AS (SELECT *, list_sum(e) AS e_sum FROM twin_exp),
{backward_sql('twin_sum', 'tw', MASK_LAYER,
    f'[CASE WHEN h{MASK_LAYER}[i] > 0 THEN (e[i] / e_sum - theirs[i]) * m[i] ELSE 0e0 END for i in range(1, {WIDTHS[MASK_LAYER - 1] + 1})]')},
pair_lookup AS (SELECT {', '.join(f'list({rounded(f"d0[{i + 1}]", 12)} ORDER BY code, t_reg) AS g_{f}' for i, f in enumerate(FEATURES))}
  FROM (SELECT *, {_code()} AS code FROM tw0))"""

    def pair_gradient(self, feature: str, reg: str, t_reg: str) -> str:
        at = f"({_code(reg=reg)} - 1) * {SPAN['reg']} + {t_reg} - (SELECT lo_reg FROM limits) + 1"
        return f"(SELECT g_{feature} FROM pair_lookup)[{at}]"


LOG, NETWORK, PAIR = LogisticSql(), NetworkSql(), PairSql()


def _gradients(model, free: list[str], **twin: str) -> str:
    """Columns g_<f> and h_<f>: gradients at the row and at its twin; whether each side is all zero."""
    if model is PAIR:
        mine = {f: model.pair_gradient(f, "reg", twin["reg"]) for f in FEATURES}
        theirs = {f: model.pair_gradient(f, twin["reg"], "reg") for f in FEATURES}
    else:
        mine = {f: model.gradient(f) for f in FEATURES}
        theirs = {f: model.gradient(f, **twin) for f in FEATURES}
    return ", ".join([*[f"{mine[f]} AS g_{f}" for f in FEATURES], *[f"{theirs[f]} AS h_{f}" for f in FEATURES]])


ZERO_S, ZERO_N = (" AND ".join(f"{side}_{f} = 0" for f in FEATURES) for side in "gh")


def _agreeing_moves(free: list[str]) -> str:
    return ", ".join(
        f"sign(g_{f}) * CASE WHEN {ZERO_S} THEN sign(h_{f}) WHEN {ZERO_N} THEN sign(g_{f})"
        f" ELSE CAST(sign(g_{f}) = sign(h_{f}) AS INT) END AS mv_{f}"
        for f in free
    )


def _moved(free: list[str], at: tuple[str, ...], prefix: str = "") -> str:
    """Next value of each free feature; a zero move becomes one hashed feature, up or down."""
    still = " AND ".join(f"mv_{f} = 0" for f in free)
    return ", ".join(
        _clip(
            f,
            f"{f} + CASE WHEN {still} THEN CASE WHEN {_hash('feature', *at)} % {len(free)} = {i}"
            f" THEN CASE WHEN {_hash('sign', *at)} % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END ELSE mv_{f} END",
        )
        + f" AS {prefix}{f}"
        for i, f in enumerate(free)
    )


def _drawn(free: list[str], at: tuple[str, ...]) -> str:
    """Name of the feature drawn with probability inverse to |g| + |h|."""
    size = {f: f"(abs(g_{f}) + abs(h_{f}))" for f in free}
    any_zero = " OR ".join(f"{size[f]} = 0" for f in free)
    total = " + ".join(f"1e0 / {size[f]}" for f in free)
    share = [f"CASE WHEN {any_zero} THEN 1e0 / {len(free)} ELSE (1e0 / {size[f]}) / ({total}) END" for f in free]
    cases = " ".join(
        f"WHEN {' + '.join(f'({x})' for x in share[: i + 1])} > {_unit('feature', *at)} THEN '{f}'" for i, f in enumerate(free[:-1])
    )
    return f"CASE {cases} ELSE '{free[-1]}' END"


def _sign(at: tuple[str, ...]) -> str:
    return f"CASE WHEN {mix_sql('sign', SALT, *at)} % 2 = 0 THEN 1 ELSE -1 END"


def _variants_sql(model, n: str, source: str, keys: str) -> str:
    """v<n>: all (seg, reg) variants of each row of ``source``; m<n>: members per bin."""
    return f"""
v{n} AS (SELECT *, {bin_sql()} AS bin FROM (SELECT {keys}, CAST((s.seg - lo_seg) * reg_span + r.reg - lo_reg AS INT) AS variant_id,
    {model.prob(seg='s.seg', reg='r.reg', bal='x.bal', n_ord='x.n_ord')} AS p FROM {source} x CROSS JOIN segs s CROSS JOIN regs r CROSS JOIN limits)),
m{n} AS (SELECT {keys.replace('x.', '')}, bin, list(variant_id ORDER BY variant_id) AS ids, count(*) AS n, min(variant_id) AS first
  FROM v{n} GROUP BY ALL)"""


def _pick(tag: str, parts: tuple[str, ...]) -> str:
    return f"ids[{_hash(tag, *parts)} % len(ids) + 1]"


def _step_sql(model, n: int, source: str) -> str:
    """r<n>: one global round over ``source``(seed_id, step, features)."""
    at = ("seed_id", "step")
    return f"""{_variants_sql(model, str(n), source, 'x.seed_id, x.step, x.bal, x.n_ord')},
big{n} AS (SELECT seed_id, step, {_pick('member', at)} AS member, {_pick('partner', at)} AS partner FROM m{n}
  QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY n DESC, first) = 1),
low{n} AS (SELECT seed_id, {_pick('low', at)} AS low FROM m{n} QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY bin) = 1),
high{n} AS (SELECT seed_id, {_pick('high', at)} AS high FROM m{n} QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY bin DESC) = 1),
k{n} AS (SELECT seed_id, bal, n_ord, CAST(count(*) AS INT) AS k, CAST(max(bin) - min(bin) AS INT) AS spread FROM m{n} GROUP BY ALL),
j{n} AS (SELECT k.*, b.step, CAST(low AS INT) AS low, CAST(high AS INT) AS high,
    CAST(member // reg_span + lo_seg AS INT) AS seg, CAST(member % reg_span + lo_reg AS INT) AS reg,
    CAST(partner // reg_span + lo_seg AS INT) AS t_seg, CAST(partner % reg_span + lo_reg AS INT) AS t_reg
  FROM k{n} k JOIN big{n} b USING (seed_id) JOIN low{n} USING (seed_id) JOIN high{n} USING (seed_id) CROSS JOIN limits),
g{n} AS (SELECT *, {_gradients(model, FREE, seg='t_seg', reg='t_reg')} FROM j{n}),
y{n} AS (SELECT *, {_agreeing_moves(FREE)} FROM g{n}),
r{n} AS (SELECT y.*, {_moved(FREE, at, 'next_')}, seg AS next_seg, reg AS next_reg FROM y{n} y CROSS JOIN limits)"""


STEP_COLUMNS = ["seed_id", "k", "spread", "seg", "reg", "bal", "n_ord", "low", "high", "next_bal", "next_n_ord"]


@query("g1_search_step", f"WITH {HEAD_SQL}, {_step_sql(LOG, 0, 'seeds')} SELECT {', '.join(STEP_COLUMNS)} FROM r0")
def _(spark, sf):
    start = seeds(spark, sf).withColumn("step", F.lit(0))
    return search.search_step(start, LOGISTIC, space(spark, sf, PROTECTED)).select(*STEP_COLUMNS)


def _global_sql(model, rounds: int, head: str = HEAD_SQL) -> str:
    """paths and uniq: every position of every seed, and the earliest one per masked key."""
    steps = [_step_sql(model, 0, "seeds")]
    for n in range(1, rounds + 1):
        names = ", ".join(f"next_{f} AS {f}" for f in FEATURES)
        steps.append(f"st{n} AS (SELECT seed_id, {n} AS step, {names} FROM r{n - 1})")
        steps.append(_step_sql(model, n, f"st{n}"))
    columns = "seed_id, step, seg, reg, bal, n_ord, k, spread, low, high"
    paths = " UNION ALL ".join(f"SELECT {columns} FROM r{n}" for n in range(rounds + 1))
    return f"""{head}{model.ctes}, {', '.join(steps)}, paths AS ({paths}),
uniq AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY bal, n_ord ORDER BY step, seed_id) = 1)"""


GLOBAL_SQL = _global_sql(LOG, MAX_ITER)


@query(
    "g1_global_search",
    f"WITH {GLOBAL_SQL} SELECT 'global' AS phase, seed_id, step, 0 AS seg, 0 AS reg, bal, n_ord, k, spread FROM uniq",
)
def _(spark, sf):
    return search.global_search(seeds(spark, sf), LOGISTIC, space(spark, sf, PROTECTED), MAX_ITER).drop("elapsed")


def _local_sql(model, rounds: int) -> str:
    ctes = []
    for n in range(rounds):
        at = ("seed_id", "origin", str(n))
        ctes.append(f"""
lg{n} AS (SELECT *, {_gradients(model, FREE, seg='t_seg', reg='t_reg')} FROM wk{n}),
lc{n} AS (SELECT *, {_drawn(FREE, at)} AS pick, {_sign(at)} AS sgn FROM lg{n}),
lt{n} AS (SELECT seed_id, origin, spread AS old_spread, seg, reg, t_seg, t_reg, bal AS old_bal, n_ord AS old_n_ord,
    {', '.join(_clip(f, f"{f} + CASE WHEN pick = '{f}' THEN sgn ELSE 0 END") + f' AS {f}' for f in FREE)} FROM lc{n}, limits),
{_variants_sql(model, f'l{n}', f'lt{n}', 'x.seed_id, x.origin, x.bal, x.n_ord')},
lk{n} AS (SELECT seed_id, origin, CAST(count(*) AS INT) AS k, CAST(max(bin) - min(bin) AS INT) AS spread FROM ml{n} GROUP BY ALL),
ld{n} AS (SELECT t.*, k, spread, spread >= old_spread OR {_unit('accept', *at)} < exp(spread - old_spread) AS keep
  FROM lt{n} t JOIN lk{n} USING (seed_id, origin)),
wk{n + 1} AS (SELECT seed_id, origin, CASE WHEN keep THEN spread ELSE old_spread END AS spread, seg, reg, t_seg, t_reg,
    {', '.join(f'CASE WHEN keep THEN {f} ELSE old_{f} END AS {f}' for f in FREE)} FROM ld{n})""")
    tried = " UNION ALL ".join(f"SELECT seed_id, {n} AS step, bal, n_ord, k, spread FROM ld{n}" for n in range(rounds))
    return ", ".join(ctes) + f""", tried AS ({tried}),
fresh AS (SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM uniq u WHERE u.bal = t.bal AND u.n_ord = t.n_ord)
  QUALIFY row_number() OVER (PARTITION BY bal, n_ord ORDER BY step, seed_id) = 1)"""


def _starts_sql(source: str) -> str:
    return f"""wk0 AS (SELECT seed_id, step AS origin, spread, CAST(low // reg_span + lo_seg AS INT) AS seg,
    CAST(low % reg_span + lo_reg AS INT) AS reg, CAST(high // reg_span + lo_seg AS INT) AS t_seg,
    CAST(high % reg_span + lo_reg AS INT) AS t_reg, bal, n_ord FROM {source} CROSS JOIN limits WHERE k >= 2)"""


def _both_phases_sql(model, rounds: int, local_rounds: int) -> str:
    return f"""WITH {_global_sql(model, rounds)}, {_starts_sql('uniq')}, {_local_sql(model, local_rounds)}
      SELECT 'global' AS phase, seed_id, step, 0 AS seg, 0 AS reg, bal, n_ord, k, spread FROM uniq
      UNION ALL SELECT 'local', seed_id, step, 0, 0, bal, n_ord, k, spread FROM fresh"""


@query("g2_local_search", _both_phases_sql(LOG, 0, LOCAL_ROUNDS))
def _(spark, sf):
    found = search.global_search(seeds(spark, sf), LOGISTIC, space(spark, sf, PROTECTED), 0, LOCAL_ROUNDS)
    return found.drop("elapsed")


@query("g1_global_search_network", _both_phases_sql(NETWORK, MAX_ITER, LOCAL_ROUNDS))
def _(spark, sf):
    found = search.global_search(seeds(spark, sf), formula_mlp(), space(spark, sf, PROTECTED), MAX_ITER, LOCAL_ROUNDS)
    return found.drop("elapsed")


def _searched_report_sql(model, rounds: int, local_rounds: int, by: str = "") -> str:
    """Finds of both phases, scored again and reported per phase; the step stands for the time."""
    totals = {
        "k_init": "avg(init_k)",
        "k_final": "avg(k)",
        "t_final": "avg(elapsed)",
        "q_inf": "avg(CASE WHEN disc = 1 THEN min_entropy END)",
        "q_1": "avg(CASE WHEN disc = 1 THEN sh_entropy END)",
    }
    return f"""WITH {_global_sql(model, rounds)}, {_starts_sql('uniq')}, {_local_sql(model, local_rounds)},
finds AS (SELECT {by or "'global'"} AS phase, seed_id, step, bal, n_ord FROM uniq
  UNION ALL SELECT {by or "'local'"}, seed_id, step, bal, n_ord FROM fresh),
{_variants_sql(model, 'q', 'finds', 'x.phase, x.seed_id, x.step, x.bal, x.n_ord')},
find_bins AS (SELECT phase, seed_id, step, bal, n_ord, bin, count(*) AS n, min(p) AS p_min, max(p) AS p_max FROM vq GROUP BY ALL),
find_shares AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY bal, n_ord) AS share FROM find_bins),
measured AS (SELECT phase, seed_id, step, bal, n_ord, count(*) AS k, {rounded('-sum(share * log2(share))', 6)} AS sh_entropy,
  {rounded('log2(count(*))', 2)} AS min_entropy, CAST(max(p_max) > 0.5 AND min(p_min) < 0.5 AS INT) AS disc FROM find_shares GROUP BY ALL),
rescored AS (SELECT m.*, CAST(m.step AS DOUBLE) AS elapsed, s.k AS init_k FROM measured m JOIN k0 s USING (seed_id)),
tops AS (SELECT phase, k, count(*) AS n, row_number() OVER (PARTITION BY phase ORDER BY k DESC) AS r FROM rescored GROUP BY phase, k),
top_counts AS (SELECT phase, {', '.join(f"CAST(coalesce(sum(CASE WHEN r = {i} THEN n END), 0) AS BIGINT) AS ik{i}f" for i in (1, 2, 3))}
  FROM tops GROUP BY phase),
report AS (SELECT phase, count(*) AS n_found, {', '.join(f'{rounded(e, 6)} AS {n}' for n, e in totals.items())}
  FROM rescored GROUP BY phase)
SELECT * FROM report JOIN top_counts USING (phase)"""


@query("a12_report_of_search", _searched_report_sql(NETWORK, MAX_ITER, LOCAL_ROUNDS))
def _(spark, sf):
    where, start = space(spark, sf, PROTECTED), seeds(spark, sf)
    found = search.global_search(start, formula_mlp(), where, MAX_ITER, LOCAL_ROUNDS)
    scored = search.rescored(found, start, formula_mlp(), where)
    return metrics.search_report(scored.withColumn("elapsed", F.col("step").cast("double")), ["phase"])


TRIALS = 3
TRIAL_ROUNDS = 3  # global rounds of a trial


def _trials_sql() -> str:
    """The report of each trial's search, then its mean and deviation."""
    one = _searched_report_sql(LOG, TRIAL_ROUNDS, LOCAL_ROUNDS, by="'all'")
    trials = " UNION ALL ".join(f"SELECT * FROM ({one.replace(SALT, str(t))})" for t in range(TRIALS))
    stats = " UNION ALL ".join(
        f"SELECT '{kind}' AS stat, " + ", ".join(f"{rounded(f'{fn}({c})', 4)} AS {c}" for c in REPORT_COLUMNS) + " FROM trials"
        for kind, fn in (("mean", "avg"), ("std", "stddev_pop"))
    )
    return f"WITH trials AS MATERIALIZED ({trials}) {stats}"


@query("g1_search_trials", _trials_sql())
def _(spark, sf):
    where, start = space(spark, sf, PROTECTED), seeds(spark, sf)
    scored = search.search_trials(start, LOGISTIC, where, TRIALS, TRIAL_ROUNDS, LOCAL_ROUNDS)
    report = metrics.search_report(scored.withColumn("elapsed", F.col("step").cast("double")), ["trial"])
    path = shared_path(spark, "trials")
    tables.write_report(metrics.mean_std_over_trials(report, REPORT_COLUMNS, 4), path)
    return spark.read.csv(path, header=True, schema="stat STRING, " + ", ".join(f"{c} DOUBLE" for c in REPORT_COLUMNS))


@query("g1_clustered_seeds_search")
def _(spark, sf):
    rows, _ = train.seed_clusters(applicants(spark, sf), FEATURES)
    order = metrics.round_robin_seeds(rows, "cluster", "row_id", 1000)
    start = order.select(F.col("row_id").alias("seed_id"), *FEATURES)
    return search.global_search(start, formula_mlp(), space(spark, sf, PROTECTED), MAX_ITER).drop("elapsed")


# Single-attribute searches on reg: the masked key is (seg, bal, n_ord).
KEY = ["seg", "bal", "n_ord"]


def _flip_sql(model, n: str, source: str, keep: str) -> str:
    """f<n>: each row of ``source`` with its partner value and whether some reg changes the class."""
    own = dict(seg="x.seg", bal="x.bal", n_ord="x.n_ord")
    return f"""
fv{n} AS (SELECT {keep}, x.seg, x.reg, x.bal, x.n_ord, r.reg AS other, {model.prob(reg='x.reg', **own)} AS own_p,
    {model.prob(reg='r.reg', **own)} AS p FROM {source} x CROSS JOIN regs r),
fd{n} AS (SELECT *, (p > 0.5) <> (own_p > 0.5) AS flip, abs(greatest(p, 1e0 - p) - greatest(own_p, 1e0 - own_p)) AS diff FROM fv{n}),
f{n} AS (SELECT * EXCLUDE (other, own_p, p, flip, diff), coalesce(min(other) FILTER (flip),
    arg_max(other, diff * 1e12 - other * 1e-3) FILTER (other <> reg AND diff > 0), any_value(reg)) AS n_value,
    coalesce(bool_or(flip), false) AS flips FROM fd{n} GROUP BY ALL)"""


def _befores(names: list[str]) -> str:
    return ", ".join(f"{f} AS b_{f}" for f in names)


def _olds(names: list[str]) -> str:
    return ", ".join(f"x.b_{f}" for f in names)


def _accept(at: tuple[str, ...]) -> str:
    """Whether a walker takes the position tried: a flip is given up with probability exp(-1) only."""
    return f"(flips OR NOT was OR {_unit('accept', *at)} < {double(search.LEAVE)})"


def _kept(names: list[str]) -> str:
    back = ", ".join(f"CASE WHEN keep THEN {f} ELSE b_{f} END AS {f}" for f in names)
    return f"{back}, CASE WHEN keep THEN flips ELSE was END AS was"


def _flip_walk_sql(model, rounds: int) -> str:
    ctes = []
    for n in range(rounds):
        at = ("seed_id", str(search.LOCAL), str(n))
        ctes.append(f"""
wg{n} AS (SELECT *, {_gradients(model, KEY, reg='n_value')} FROM ww{n}),
wc{n} AS (SELECT *, {_drawn(KEY, at)} AS pick, {_sign(at)} AS sgn FROM wg{n}),
wm{n} AS (SELECT seed_id, n_value AS old_n, reg, was, {_befores(KEY)},
    {', '.join(_clip(f, f"{f} + CASE WHEN pick = '{f}' THEN sgn ELSE 0 END") + f' AS {f}' for f in KEY)}
  FROM wc{n}, limits),
{_flip_sql(model, f'w{n}', f'wm{n}', f'x.seed_id, x.old_n, x.was, {_olds(KEY)}')},
ww{n + 1} AS (SELECT seed_id, old_n AS n_value, reg, {_kept(KEY)} FROM (SELECT *, {_accept(at)} AS keep FROM fw{n}))""")
    tried = " UNION ALL ".join(f"SELECT seed_id, {n} AS step, seg, bal, n_ord, flips FROM fw{n}" for n in range(rounds))
    return ", ".join(ctes) + f", walked AS ({tried})"


MEMORY = "x.m1, x.m2, x.m3"
ALL_ZERO = " AND ".join(f"g_{f} = 0" for f in FEATURES)


def _restarting_moves(at: tuple[str, ...]) -> str:
    """Signs of the gradient, or hashed -1, 0, 1 when it is zero or the last moves swing."""
    return ", ".join(
        f"CASE WHEN ({ALL_ZERO}) OR m1 = m3 THEN {digest_sql(f"'{f}'", "'0'", *[f'CAST({p} AS VARCHAR)' for p in at])} % 3 - 1"
        f" ELSE sign(g_{f}) END AS mv_{f}"
        for f in KEY
    )


def _guided_sql(model, rounds: int, local_rounds: int) -> str:
    """Rounds of a single-attribute search; the pair model remembers its last three moves."""
    at, guided = ("seed_id", "step"), model is PAIR
    ctes = []
    if guided:
        start = ", ".join(f"[{', '.join([v] * len(FEATURES))}] AS {m}" for m, v in (("m1", "0e0"), ("m2", "1e0"), ("m3", "-1e0")))
        ctes.append(f"first_state AS (SELECT seed_id, seg, reg, bal, n_ord, {start} FROM seeds)")
    for n in range(rounds + 1):
        source = ("first_state" if guided else "seeds") if n == 0 else f"as{n}"
        keep = f"x.seed_id, {n} AS step" + (f", {MEMORY}" if guided else "")
        ctes.append(_flip_sql(model, f"a{n}", source, keep))
        seen = f"WHERE NOT EXISTS (SELECT 1 FROM found{n - 1} d WHERE d.seg = h.seg AND d.bal = h.bal AND d.n_ord = h.n_ord)" if n else ""
        ctes.append(f"""hit{n} AS (SELECT seed_id, step, seg, reg, bal, n_ord, n_value FROM fa{n} WHERE flips),
new{n} AS (SELECT * FROM hit{n} h {seen} QUALIFY row_number() OVER (PARTITION BY seg, bal, n_ord ORDER BY seed_id) = 1),
found{n} AS (SELECT * FROM new{n}{f' UNION ALL SELECT * FROM found{n - 1}' if n else ''})""")
        if n == rounds:
            break
        if guided:
            moves = _restarting_moves(at)
            last = ", ".join("0e0" if f not in KEY else f"CAST(mv_{f} AS DOUBLE)" for f in FEATURES)
            shifted = ", ".join(_clip(f, f"{f} + mv_{f}") + f" AS {f}" for f in KEY) + f", m2 AS m1, m3 AS m2, [{last}] AS m3"
        else:
            moves, shifted = _agreeing_moves(KEY), _moved(KEY, at)
        ctes.append(f"""
al{n} AS (SELECT a.*, {_gradients(model, KEY, reg='n_value')} FROM fa{n} a WHERE seed_id NOT IN (SELECT seed_id FROM found{n})),
am{n} AS (SELECT *, {moves} FROM al{n}),
as{n + 1} AS (SELECT seed_id, reg, {shifted} FROM am{n} CROSS JOIN limits)""")
    tried = " UNION ALL ".join(f"SELECT seed_id, step, seg, bal, n_ord, flips FROM fa{n}" for n in range(rounds + 1))
    local = f"""ww0 AS (SELECT seed_id, n_value, seg, reg, bal, n_ord, true AS was FROM found{rounds}), {_flip_walk_sql(model, local_rounds)},"""
    first = "row_number() OVER (PARTITION BY seg, bal, n_ord ORDER BY NOT flips, step, seed_id) = 1"
    return f"""{HEAD_SQL}{model.ctes}, {', '.join(ctes)}, {local}
tried AS ({tried}),
visited AS (SELECT * FROM tried QUALIFY {first}),
visited_local AS (SELECT * FROM walked w WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.seg = w.seg AND v.bal = w.bal AND v.n_ord = w.n_ord)
  QUALIFY {first}),
searched AS (SELECT 'global' AS phase, seed_id, step, seg, bal, n_ord, CAST(flips AS INT) AS disc FROM visited
  UNION ALL SELECT 'local', seed_id, step, seg, bal, n_ord, CAST(flips AS INT) FROM visited_local)"""


@query("g4_adf_search", f"WITH {_guided_sql(LOG, MAX_ITER, LOCAL_ROUNDS)} SELECT * FROM searched")
def _(spark, sf):
    return search.adf_search(seeds(spark, sf), LOGISTIC, space(spark, sf, ["reg"]), MAX_ITER, LOCAL_ROUNDS)


NETWORK_ADF_SQL = _guided_sql(NETWORK, MAX_ITER, LOCAL_ROUNDS)


@query("g4_adf_search_network", f"WITH {NETWORK_ADF_SQL} SELECT * FROM searched")
def _(spark, sf):
    return search.adf_search(seeds(spark, sf), formula_mlp(), space(spark, sf, ["reg"]), MAX_ITER, LOCAL_ROUNDS)


def _draw_sql() -> str:
    columns = ", ".join(
        f"CAST(lo_{f} + {digest_sql(chr(39) + '0' + chr(39), chr(39) + f + chr(39), 'CAST(id AS VARCHAR)')} % (hi_{f} - lo_{f} + 1) AS INT) AS {f}"
        for f in FEATURES
    )
    return f"drawn AS (SELECT id AS seed_id, {columns} FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS id), limits)"


@query(
    "g3_random_search",
    f"""WITH {HEAD_SQL}, {_draw_sql()}, {_flip_sql(LOG, 'q', 'drawn', 'x.seed_id')}
      SELECT 'global' AS phase, seed_id, 0 AS step, seg, bal, n_ord, CAST(flips AS INT) AS disc FROM fq
      QUALIFY row_number() OVER (PARTITION BY seg, bal, n_ord ORDER BY NOT flips, seed_id) = 1""",
)
def _(spark, sf):
    samples = table(spark, sf, "customer").count()
    return search.random_search(spark, LOGISTIC, space(spark, sf, ["reg"]), samples)


def _walk_sql(model, rounds: int) -> str:
    """Adaptive walk from the finds: the probabilities of each round come from the counts of the last."""
    n_features = len(FEATURES)
    ctes = [
        f"""fresh_found AS (SELECT * FROM fq WHERE flips QUALIFY row_number() OVER (PARTITION BY seg, bal, n_ord ORDER BY seed_id) = 1),
wa0 AS (SELECT seed_id, seg, reg, bal, n_ord, true AS was FROM fresh_found),
pw0 AS (SELECT [{', '.join([double(1.0 / n_features)] * n_features)}] AS fp, [{', '.join(['0.5e0'] * n_features)}] AS dp)"""
    ]
    for n in range(rounds):
        at = ("seed_id", str(search.WALK), str(n))
        cases = " ".join(
            f"WHEN fp[{i + 1}] > 0 AND {' + '.join(f'fp[{j + 1}]' for j in range(i + 1))} > u * list_sum(fp) THEN {i}"
            for i in range(n_features)
        )
        edge = " OR ".join(f"(pick = {i} AND ({f} = lo_{f} OR {f} = hi_{f}))" for i, f in enumerate(FEATURES))
        gain = {
            (i, d): f"coalesce((SELECT (sum(CAST(flips AS INT)) - sum(1 - CAST(flips AS INT))) * 0.001e0 FROM fz{n} WHERE pick = {i} AND direction = {d}), 0e0)"
            for i in range(n_features)
            for d in (-1, 1)
        }
        up = [f"greatest(greatest(fp[{i + 1}] + {gain[i, -1]}, 0e0) + {gain[i, 1]}, 0e0)" for i in range(n_features)]
        down = [
            f"least(greatest(least(greatest(dp[{i + 1}] + {gain[i, -1]}, 0e0), 1e0) - {gain[i, 1]}, 0e0), 1e0)" for i in range(n_features)
        ]
        ctes.append(f"""
wb{n} AS (SELECT *, {_unit('feature', *at)} AS u FROM wa{n}, pw{n}),
wd{n} AS (SELECT *, CASE {cases} ELSE -1 END AS pick FROM wb{n}),
we{n} AS (SELECT *, CASE WHEN {_unit('direction', *at)} < CASE WHEN {edge} THEN 0.5e0 ELSE dp[pick + 1] END THEN -1 ELSE 1 END AS direction
  FROM wd{n}, limits),
wf{n} AS (SELECT seed_id, pick, direction, was, {_befores(FEATURES)}, {', '.join(_clip(f, f'{f} + CASE WHEN pick = {i} THEN direction ELSE 0 END') + f' AS {f}' for i, f in enumerate(FEATURES))} FROM we{n}),
{_flip_sql(model, f'z{n}', f'wf{n}', f'x.seed_id, x.pick, x.direction, x.was, {_olds(FEATURES)}')},
wa{n + 1} AS (SELECT seed_id, {_kept(FEATURES)} FROM (SELECT *, {_accept(at)} AS keep FROM fz{n})),
pu{n} AS (SELECT [{', '.join(up)}] AS fp, [{', '.join(down)}] AS dp FROM pw{n}),
pw{n + 1} AS (SELECT [v / list_sum(fp) for v in fp] AS fp, dp FROM pu{n})""")
    walked = " UNION ALL ".join(f"SELECT seed_id, {n} AS step, seg, bal, n_ord, flips FROM fz{n}" for n in range(rounds))
    first = "row_number() OVER (PARTITION BY seg, bal, n_ord ORDER BY NOT flips, step, seed_id) = 1"
    return f"""{HEAD_SQL}{model.ctes}, {_draw_sql()}, {_flip_sql(model, 'q', 'drawn', 'x.seed_id')}, {', '.join(ctes)},
walked AS ({walked}),
visited AS (SELECT seed_id, 0 AS step, seg, bal, n_ord, flips FROM fq QUALIFY {first}),
visited_local AS (SELECT * FROM walked w WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.seg = w.seg AND v.bal = w.bal AND v.n_ord = w.n_ord)
  QUALIFY {first})
SELECT 'global' AS phase, seed_id, step, seg, bal, n_ord, CAST(flips AS INT) AS disc FROM visited
UNION ALL SELECT 'local', seed_id, step, seg, bal, n_ord, CAST(flips AS INT) FROM visited_local"""


@query("g3_random_search_walk", f"WITH {_walk_sql(NETWORK, LOCAL_ROUNDS)}")
def _(spark, sf):
    samples = table(spark, sf, "customer").count()
    return search.random_search(spark, formula_mlp(), space(spark, sf, ["reg"]), samples, LOCAL_ROUNDS)


@query("g5_neuron_guided_search", f"WITH {_guided_sql(PAIR, GUIDED_MOVES, LOCAL_ROUNDS)} SELECT * FROM searched")
def _(spark, sf):
    mask = mask_values(spark, sf)
    where = space(spark, sf, ["reg"])
    return search.neuron_guided_search(seeds(spark, sf), formula_mlp(), where, MASK_LAYER, mask, GUIDED_MOVES, LOCAL_ROUNDS)


@query(
    "a13_search_comparison",
    f"""WITH {NETWORK_ADF_SQL} SELECT 0 AS trial, CAST(sum(disc) FILTER (phase = 'global') AS BIGINT) AS g_disc,
      CAST(sum(disc) FILTER (phase = 'local') AS BIGINT) AS l_disc, CAST(sum(disc) AS BIGINT) AS tot_disc,
      {rounded("sum(disc) FILTER (phase = 'local') * 100e0 / count(*) FILTER (phase = 'local')", 1)} AS local_succ,
      CAST(min(step) FILTER (disc = 1) AS DOUBLE) AS time_to_first,
      CAST((SELECT step FROM searched WHERE disc = 1 ORDER BY step OFFSET 99 LIMIT 1) AS DOUBLE) AS time_to_n FROM searched""",
)
def _(spark, sf):
    adf = search.adf_search(seeds(spark, sf), formula_mlp(), space(spark, sf, ["reg"]), MAX_ITER, LOCAL_ROUNDS)
    timed = adf.withColumns({"trial": F.lit(0), "elapsed": F.col("step").cast("double")})
    return metrics.compare_report(timed, ["trial"], 100)


# The searches at the reference's number of local steps. Their rounds are those that the SQL of the queries above checks.
@query("g2_local_search_full")
def _(spark, sf):
    found = search.global_search(seeds(spark, sf), LOGISTIC, space(spark, sf, PROTECTED), 0, LOCAL_STEPS)
    return found.drop("elapsed")


@query("g1_global_search_network_full")
def _(spark, sf):
    found = search.global_search(seeds(spark, sf), formula_mlp(), space(spark, sf, PROTECTED), MAX_ITER, LOCAL_STEPS)
    return found.drop("elapsed")


@query("a12_report_of_search_full")
def _(spark, sf):
    where, start = space(spark, sf, PROTECTED), seeds(spark, sf)
    found = search.global_search(start, formula_mlp(), where, MAX_ITER, LOCAL_STEPS)
    scored = search.rescored(found, start, formula_mlp(), where)
    return metrics.search_report(scored.withColumn("elapsed", F.col("step").cast("double")), ["phase"])


@query("g4_adf_search_full")
def _(spark, sf):
    return search.adf_search(seeds(spark, sf), LOGISTIC, space(spark, sf, ["reg"]), MAX_ITER, LOCAL_STEPS)


@query("g4_adf_search_network_full")
def _(spark, sf):
    return search.adf_search(seeds(spark, sf), formula_mlp(), space(spark, sf, ["reg"]), MAX_ITER, LOCAL_STEPS)


@query("g5_neuron_guided_search_full")
def _(spark, sf):
    mask = mask_values(spark, sf)
    where = space(spark, sf, ["reg"])
    return search.neuron_guided_search(seeds(spark, sf), formula_mlp(), where, MASK_LAYER, mask, GUIDED_MOVES, LOCAL_STEPS)


@query("a13_search_comparison_full")
def _(spark, sf):
    adf = search.adf_search(seeds(spark, sf), formula_mlp(), space(spark, sf, ["reg"]), MAX_ITER, LOCAL_STEPS)
    timed = adf.withColumns({"trial": F.lit(0), "elapsed": F.col("step").cast("double")})
    return metrics.compare_report(timed, ["trial"], 100)


@query("g3_random_search_walk_full")
def _(spark, sf):
    samples = table(spark, sf, "customer").count()
    return search.random_search(spark, formula_mlp(), space(spark, sf, ["reg"]), samples, LOCAL_STEPS)
