"""Queries over scores, partitions, reports, windows, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterfair.functions import scalar
from counterfair.functions.scalar import fixed, hash_unit
from counterfair.operators import metrics, picks, prepare, score
from counterfair.operators.expand import expand_protected
from counterfair.plans.base import (
    APPLICANTS_SQL,
    EPS,
    FEATURES,
    FREE,
    LOGISTIC,
    PROTECTED,
    VARIANTS_SQL,
    applicant_bounds,
    applicants,
    digest_sql,
    probability_sql,
    protected_domain,
    query,
    rounded,
    table,
    variants,
)

WITH = f"WITH {VARIANTS_SQL}"

# Per-row partition metrics in SQL, shared by several queries.
METRICS_SQL = f"""{VARIANTS_SQL},
bin_counts AS (SELECT row_id, bin, count(*) AS n, min(p) AS p_min, max(p) AS p_max FROM variants GROUP BY row_id, bin),
shares AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY row_id) AS share FROM bin_counts),
metrics AS (SELECT row_id, CAST(count(*) AS INT) AS k, CAST(max(bin) - min(bin) AS INT) AS spread,
    {rounded('-sum(share * log2(share))', 6)} AS sh_entropy, {rounded('log2(count(*))', 2)} AS min_entropy,
    CAST(max(p_max) > 0.5 AND min(p_min) < 0.5 AS INT) AS disc FROM shares GROUP BY row_id)"""


def _report(spark, sf):
    report = metrics.partition_report(variants(spark, sf), "row_id")
    return report.withColumn("sh_entropy", fixed(F.col("sh_entropy"), 6))


REPORT_SQL = f"WITH {METRICS_SQL} SELECT row_id, k, spread, sh_entropy, min_entropy, disc FROM metrics"


@query("flagship_partition_report", REPORT_SQL)
def _(spark, sf):
    return _report(spark, sf)


@query(
    "flagship_row_metrics",
    f"WITH {METRICS_SQL} SELECT row_id, seg, reg, bal, n_ord, k, spread, sh_entropy, disc"
    " FROM metrics JOIN applicants USING (row_id)",
)
def _(spark, sf):
    rows = applicants(spark, sf).drop("label")
    measured = score.row_metrics(rows, LOGISTIC, protected_domain(spark, sf), EPS)
    disc = metrics.discriminatory_score(F.col("p_min"), F.col("p_max"))
    return measured.select(
        *rows.columns, "k", "spread", fixed(F.abs("sh_entropy"), 6).alias("sh_entropy"), disc.alias("disc")
    )


@query("m2_score_logistic", f"WITH {APPLICANTS_SQL} SELECT row_id, {probability_sql()} AS p FROM applicants")
def _(spark, sf):
    return score.score_logistic(applicants(spark, sf), LOGISTIC).select("row_id", "p")


@query("m3_predict_class", f"{WITH} SELECT row_id, variant_id, cls FROM variants")
def _(spark, sf):
    return variants(spark, sf).select("row_id", "variant_id", "cls")


@query(
    "m9_accuracy",
    f"WITH {APPLICANTS_SQL} SELECT round(avg(CAST(CAST({probability_sql()} > 0.5 AS INT) = label AS INT)), 3) AS accuracy"
    " FROM applicants",
)
def _(spark, sf):
    scored = score.score_logistic(applicants(spark, sf), LOGISTIC)
    return score.accuracy(scored.withColumn("cls", score.predict_class(F.col("p"))), "cls", "label")


@query("f1_score_bin", f"{WITH} SELECT row_id, variant_id, p, bin FROM variants")
def _(spark, sf):
    return variants(spark, sf).select("row_id", "variant_id", "p", "bin")


def _lead_dims(spark, sf):
    lead = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", lead.alias("v"))


LEAD_SQL = "lead AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    "f2_softmax",
    f"""WITH {LEAD_SQL}, long AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM lead),
      e AS (SELECT vec_id, pos, exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM long)
      SELECT vec_id, CAST(pos - 1 AS INT) AS pos, {rounded('ex / sum(ex) OVER (PARTITION BY vec_id)', 9)} AS s FROM e""",
)
def _(spark, sf):
    soft = _lead_dims(spark, sf).select("vec_id", F.posexplode(scalar.softmax(F.col("v"))).alias("pos", "s"))
    return soft.withColumn("s", fixed(F.col("s"), 9))


@query(
    "f3_l1_mean",
    f"""WITH {LEAD_SQL}, long AS (SELECT vec_id, unnest(v) AS x, unnest(list_reverse(v)) AS y FROM lead)
      SELECT vec_id, {rounded('avg(abs(x - y))', 9)} AS d FROM long GROUP BY vec_id""",
)
def _(spark, sf):
    vectors = _lead_dims(spark, sf)
    return vectors.select("vec_id", fixed(scalar.l1_mean(F.col("v"), F.reverse("v")), 9).alias("d"))


# Gradient pairs for the move functions: the two halves of an embedding, rounded so that zeros occur.
def _gradients(spark, sf):
    def coarse(v):
        return F.round(v.cast("double") * 100, 0) / 100

    half = F.floor(F.size("embedding") / 2).cast("int")
    place = F.sequence(F.lit(0), half - 1)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform(F.slice("embedding", F.lit(1), half), coarse).alias("g"),
        F.transform(F.slice("embedding", half + 1, half), coarse).alias("h"),
        F.transform(place, lambda i: (i % 3 > 0).cast("double")).alias("movable"),
    )


GRADIENTS_SQL = """grads AS (SELECT vec_id, unnest(range(0, half)) AS pos,
    unnest([round(CAST(x AS DOUBLE) * 100) / 100 + 0e0 for x in embedding[1:half]]) AS g,
    unnest([round(CAST(x AS DOUBLE) * 100) / 100 + 0e0 for x in embedding[half + 1:2 * half]]) AS h,
    unnest([CAST(i % 3 > 0 AS INT) for i in range(0, half)]) AS movable
  FROM (SELECT *, len(embedding) // 2 AS half FROM embeddings))"""


@query(
    "f4_sign_move",
    f"""WITH {GRADIENTS_SQL}, z AS (SELECT *, max(abs(g)) OVER w = 0 AS zg, max(abs(h)) OVER w = 0 AS zh
        FROM grads WINDOW w AS (PARTITION BY vec_id))
      SELECT vec_id, CAST(pos AS INT) AS pos, CAST(sign(g) * CASE WHEN zg THEN sign(h) WHEN zh THEN sign(g)
        ELSE CAST(sign(g) = sign(h) AS INT) END * movable AS INT) AS move FROM z""",
)
def _(spark, sf):
    rows = _gradients(spark, sf)
    move = scalar.sign_move(F.col("g"), F.col("h"), F.col("movable"))
    return rows.select("vec_id", F.posexplode(move).alias("pos", "move")).withColumn("move", F.col("move").cast("int"))


PROBS_SQL = f"""{GRADIENTS_SQL},
w AS (SELECT *, CASE WHEN movable = 0 THEN 0e0 WHEN abs(g) + abs(h) = 0 THEN 'inf'::DOUBLE
    ELSE 1e0 / (abs(g) + abs(h)) END AS weight FROM grads),
t AS (SELECT *, sum(weight) OVER (PARTITION BY vec_id) AS total, sum(movable) OVER (PARTITION BY vec_id) AS free FROM w),
probs AS (SELECT vec_id, pos, CASE WHEN isinf(total) THEN CAST(movable AS DOUBLE) / free ELSE weight / total END AS prob FROM t)"""


@query(
    "f5_inverse_gradient_prob",
    f"WITH {PROBS_SQL} SELECT vec_id, CAST(pos AS INT) AS pos, {rounded('prob', 9)} AS prob FROM probs",
)
def _(spark, sf):
    rows = _gradients(spark, sf)
    probs = scalar.inverse_gradient_prob(F.col("g"), F.col("h"), F.col("movable"))
    return rows.select("vec_id", F.posexplode(probs).alias("pos", "prob")).withColumn("prob", fixed(F.col("prob"), 9))


@query(
    "f6_weighted_choice",
    f"""WITH {PROBS_SQL}, c AS (SELECT vec_id, pos, prob,
        sum(prob) OVER (PARTITION BY vec_id ORDER BY pos) AS acc,
        {digest_sql("'pick'", "CAST(vec_id AS VARCHAR)")} / 4294967296e0 AS u FROM probs)
      SELECT vec_id, CAST(min(pos) AS INT) AS choice FROM c WHERE prob > 0 AND acc > u GROUP BY vec_id""",
)
def _(spark, sf):
    rows = _gradients(spark, sf)
    probs = scalar.inverse_gradient_prob(F.col("g"), F.col("h"), F.col("movable"))
    unit = hash_unit(F.lit("pick"), F.col("vec_id"))
    return rows.withColumn("p", probs).select("vec_id", scalar.weighted_choice(F.col("p"), unit).alias("choice"))


@query(
    "a1_score_partitions",
    f"""{WITH} SELECT row_id, bin, count(*) AS n,
      string_agg(seg || ':' || reg, ',' ORDER BY seg, reg) AS members FROM variants GROUP BY row_id, bin""",
)
def _(spark, sf):
    parts = metrics.score_partitions(variants(spark, sf), "row_id", PROTECTED)
    text = F.transform("members", lambda m: F.concat_ws(":", m["seg"].cast("string"), m["reg"].cast("string")))
    return parts.withColumn("members", F.array_join(text, ","))


@query("a2_k_partitions", f"{WITH} SELECT row_id, CAST(count(DISTINCT bin) AS INT) AS k FROM variants GROUP BY row_id")
def _(spark, sf):
    return metrics.k_partitions(variants(spark, sf), "row_id")


@query("a3_bin_spread", f"{WITH} SELECT row_id, max(bin) - min(bin) AS spread FROM variants GROUP BY row_id")
def _(spark, sf):
    return metrics.bin_spread(variants(spark, sf), "row_id")


@query("a4_shannon_entropy", f"WITH {METRICS_SQL} SELECT row_id, sh_entropy FROM metrics")
def _(spark, sf):
    entropy = metrics.shannon_entropy(variants(spark, sf), "row_id")
    return entropy.withColumn("sh_entropy", fixed(F.col("sh_entropy"), 6))


@query("a5_min_entropy", f"WITH {METRICS_SQL} SELECT row_id, min_entropy FROM metrics")
def _(spark, sf):
    return metrics.k_partitions(variants(spark, sf), "row_id").select(
        "row_id", metrics.min_entropy(F.col("k")).alias("min_entropy")
    )


@query("a6_is_discriminatory_score", f"WITH {METRICS_SQL} SELECT row_id, disc FROM metrics")
def _(spark, sf):
    flag = metrics.discriminatory_score(F.min("p"), F.max("p"))
    return variants(spark, sf).groupBy("row_id").agg(flag.alias("disc"))


# Single protected attribute: every applicant under every region only.
REGION_SQL = f"""{APPLICANTS_SQL}, regs AS (SELECT unnest(range(min(reg), max(reg) + 1)) AS reg FROM applicants),
by_region AS (SELECT a.row_id, a.seg, r.reg, a.bal, a.n_ord, a.reg AS own FROM applicants a CROSS JOIN regs r),
scored AS (SELECT *, {probability_sql()} AS p FROM by_region),
labelled AS (SELECT *, CAST(p > 0.5 AS INT) AS cls FROM scored),
against AS (SELECT v.*, o.p AS own_p, o.cls AS own_cls FROM labelled v
    JOIN labelled o ON o.row_id = v.row_id AND o.reg = o.own)"""


@query(
    "a7_is_discriminatory_label",
    f"""WITH {REGION_SQL} SELECT row_id, CAST(max(cls) <> min(cls) AS INT) AS disc,
      CAST(coalesce(min(CASE WHEN cls <> own_cls THEN reg END), -1) AS INT) AS first_value FROM against GROUP BY row_id""",
)
def _(spark, sf):
    rows = applicants(spark, sf).withColumn("own", F.col("reg"))
    wide = expand_protected(rows.drop("label"), protected_domain(spark, sf, ["reg"]))
    scored = score.score_logistic(wide, LOGISTIC)
    labelled = scored.withColumn("cls", score.predict_class(F.col("p")))
    flags = metrics.discriminatory_label(labelled, "row_id", "reg", "own", "cls")
    return flags.withColumn("first_value", F.coalesce("first_value", F.lit(-1)))


# Distinct (bal, n_ord) keys under every (seg, reg): one group per masked key.
GROUPS_SQL = f"""{APPLICANTS_SQL}, segs AS (SELECT unnest(range(min(seg), max(seg) + 1)) AS seg FROM applicants),
regs AS (SELECT unnest(range(min(reg), max(reg) + 1)) AS reg FROM applicants),
masked AS (SELECT DISTINCT bal, n_ord FROM applicants),
wide AS (SELECT s.seg, r.reg, m.bal, m.n_ord FROM masked m CROSS JOIN segs s CROSS JOIN regs r),
sums AS (SELECT bal, n_ord, count(*) AS n, sum(CAST({probability_sql()} > 0.5 AS INT)) AS s FROM wide GROUP BY bal, n_ord)"""


def _key_variants(spark, sf):
    keys = prepare.distinct_keys(applicants(spark, sf).select(*FEATURES), PROTECTED)
    scored = score.score_logistic(expand_protected(keys, protected_domain(spark, sf)), LOGISTIC)
    return scored.withColumn("label", score.predict_class(F.col("p")))


@query(
    "a8_mixed_group_count",
    f"WITH {GROUPS_SQL} SELECT CAST(coalesce(sum(n - s), 0) AS BIGINT) AS discriminatory FROM sums WHERE s > 0 AND s < n",
)
def _(spark, sf):
    size = protected_domain(spark, sf).size
    return metrics.mixed_group_count(_key_variants(spark, sf), FREE, size)


@query(
    "a9_mixed_group_instances",
    f"""WITH {GROUPS_SQL} SELECT count(*) FILTER (s > 0 AND s < n) AS mixed,
      {rounded('100e0 * count(*) FILTER (s > 0 AND s < n) / count(*)', 1)} AS success_pct FROM sums""",
)
def _(spark, sf):
    size = protected_domain(spark, sf).size
    return metrics.mixed_group_instances(_key_variants(spark, sf), FREE, size)


# A found set made from the applicants: trial by nation-free hash, phase by label, elapsed by row.
FOUND_SQL = f"""{METRICS_SQL},
found AS (SELECT m.*, CAST(m.row_id % 3 AS INT) AS trial, CASE WHEN a.label = 1 THEN 'global' ELSE 'local' END AS phase,
    (m.row_id * 7919 % 10007) / 10e0 AS elapsed, greatest(m.k - CAST(m.row_id % 2 AS INT), 1) AS init_k
  FROM metrics m JOIN applicants a USING (row_id))"""


def found_set(spark, sf):
    rows = applicants(spark, sf).select("row_id", "label")
    joined = _report(spark, sf).join(rows, "row_id")
    return joined.select(
        "row_id", "k", "spread", "sh_entropy", "min_entropy", "disc",
        (F.col("row_id") % 3).cast("int").alias("trial"),
        F.when(F.col("label") == 1, "global").otherwise("local").alias("phase"),
        (F.col("row_id") * 7919 % 10007 / F.lit(10.0)).alias("elapsed"),
        F.greatest(F.col("k") - (F.col("row_id") % 2).cast("int"), F.lit(1)).alias("init_k"),
    )


@query(
    "a10_success_rate",
    f"""WITH {FOUND_SQL} SELECT phase, CAST(sum(disc) AS BIGINT) AS found, count(*) AS tried,
      {rounded('sum(disc) * 100e0 / count(*)', 1)} AS rate,
      {rounded('sum(disc) * 100e0 / (count(*) + 1)', 6)} AS rate_plus_one FROM found GROUP BY phase""",
)
def _(spark, sf):
    return metrics.success_rate(found_set(spark, sf), "disc")


TOPS_SQL = """tops AS (SELECT {by} k, count(*) AS n, row_number() OVER ({part} ORDER BY k DESC) AS r FROM {src} GROUP BY {by} k)"""


@query(
    "a11_top_k_frequencies",
    f"WITH {METRICS_SQL}, {TOPS_SQL.format(by='', part='', src='metrics')} SELECT "
    + ", ".join(f"CAST(coalesce(max(CASE WHEN r = {i} THEN n END), 0) AS BIGINT) AS ik{i}f" for i in (1, 2, 3))
    + " FROM tops",
)
def _(spark, sf):
    return metrics.top_k_frequencies(metrics.k_partitions(variants(spark, sf), "row_id"))


REPORT_COLUMNS = ["n_found", "k_init", "k_final", "t_final", "q_inf", "q_1", "ik1f", "ik2f", "ik3f"]
TRIAL_REPORT_SQL = f"""{FOUND_SQL}, {TOPS_SQL.format(by='trial,', part='PARTITION BY trial', src='found')},
top_counts AS (SELECT trial, {', '.join(f"CAST(coalesce(sum(CASE WHEN r = {i} THEN n END), 0) AS BIGINT) AS ik{i}f" for i in (1, 2, 3))}
  FROM tops WHERE r <= 3 GROUP BY trial),
report AS (SELECT trial, count(*) AS n_found, {rounded('avg(init_k)', 6)} AS k_init, {rounded('avg(k)', 6)} AS k_final,
  {rounded('avg(elapsed)', 6)} AS t_final, {rounded('avg(CASE WHEN disc = 1 THEN min_entropy END)', 6)} AS q_inf,
  {rounded('avg(CASE WHEN disc = 1 THEN sh_entropy END)', 6)} AS q_1 FROM found GROUP BY trial),
trials AS (SELECT * FROM report JOIN top_counts USING (trial))"""


@query("a12_search_report", f"WITH {TRIAL_REPORT_SQL} SELECT * FROM trials")
def _(spark, sf):
    return metrics.search_report(found_set(spark, sf), ["trial"])


NTH = 50
NTH_SQL = f"""{FOUND_SQL}, hits AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY elapsed) AS r FROM found WHERE disc = 1)"""


@query(
    "a13_compare_report",
    f"""WITH {NTH_SQL}, nth AS (SELECT trial, min(elapsed) AS time_to_first,
        max(CASE WHEN r = {NTH} THEN elapsed END) AS time_to_n FROM hits GROUP BY trial)
      SELECT f.trial, CAST(sum(disc) FILTER (phase = 'global') AS BIGINT) AS g_disc,
        CAST(sum(disc) FILTER (phase = 'local') AS BIGINT) AS l_disc, CAST(sum(disc) AS BIGINT) AS tot_disc,
        {rounded("sum(disc) FILTER (phase = 'local') * 100e0 / count(*) FILTER (phase = 'local')", 1)} AS local_succ,
        max(time_to_first) AS time_to_first, max(time_to_n) AS time_to_n
      FROM found f LEFT JOIN nth USING (trial) GROUP BY f.trial""",
)
def _(spark, sf):
    return metrics.compare_report(found_set(spark, sf), ["trial"], NTH)


@query(
    "a14_mean_std_over_trials",
    f"WITH {TRIAL_REPORT_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS stat, " + ", ".join(f"{rounded(f'{fn}({c})', 4)} AS {c}" for c in REPORT_COLUMNS) + " FROM trials"
        for kind, fn in (("mean", "avg"), ("std", "stddev_pop"))
    ),
)
def _(spark, sf):
    report = metrics.search_report(found_set(spark, sf), ["trial"])
    return metrics.mean_std_over_trials(report, REPORT_COLUMNS, 4)


@query(
    "w4_time_to_nth",
    f"""WITH {NTH_SQL} SELECT trial, min(elapsed) AS time_to_first,
      max(CASE WHEN r = {NTH} THEN elapsed END) AS time_to_n FROM hits GROUP BY trial""",
)
def _(spark, sf):
    return metrics.time_to_nth(found_set(spark, sf).filter(F.col("disc") == 1), ["trial"], NTH)


@query(
    "w2_round_robin_seeds",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings)
      SELECT vec_id, label, turn FROM r ORDER BY turn, label LIMIT 100""",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return metrics.round_robin_seeds(rows, "label", "vec_id", 100)


@query(
    "w5_running_best_k",
    f"""WITH {VARIANTS_SQL}, b AS (SELECT row_id, variant_id, bin, max(bin) OVER w AS best_k FROM variants
        WINDOW w AS (PARTITION BY row_id ORDER BY variant_id))
      SELECT row_id, variant_id, bin AS k, best_k, min(variant_id) OVER (PARTITION BY row_id, best_k) AS best_at FROM b""",
)
def _(spark, sf):
    steps = variants(spark, sf).select("row_id", "variant_id", F.col("bin").alias("k"), F.col("variant_id").alias("t"))
    return metrics.running_best_k(steps, "row_id", "variant_id", "t").drop("t")


@query(
    "w6_oscillation_check",
    f"""{WITH}, m AS (SELECT row_id, variant_id, bin % 3 - 1 AS move FROM variants)
      SELECT a.row_id, a.variant_id, a.move, CAST(coalesce(a.move = b.move, false) AS INT) AS oscillates
      FROM m a LEFT JOIN m b ON b.row_id = a.row_id AND b.variant_id + 2 = a.variant_id""",
)
def _(spark, sf):
    moves = variants(spark, sf).select("row_id", "variant_id", (F.col("bin") % 3 - 1).alias("move"))
    return metrics.oscillation_check(moves, "row_id", "variant_id", "move")


@query(
    "t1_debug_sample",
    f"""WITH {METRICS_SQL}, top AS (SELECT row_id, k, 'top' AS part FROM metrics ORDER BY k DESC, row_id LIMIT 40),
      rest AS (SELECT row_id, k, 'random' AS part FROM metrics
        ORDER BY {digest_sql("'0'", "CAST(row_id AS VARCHAR)")}, row_id LIMIT 160)
      SELECT * FROM top UNION ALL SELECT * FROM rest""",
)
def _(spark, sf):
    return picks.debug_sample(metrics.k_partitions(variants(spark, sf), "row_id"), "row_id", 200)


def _picked(spark, sf):
    return picks.partition_picks(
        applicants(spark, sf), LOGISTIC, protected_domain(spark, sf), EPS, F.col("row_id")
    )


def _member_sql(source: str, tag: str) -> str:
    pick = digest_sql(f"'{tag}'", "CAST(row_id AS VARCHAR)")
    return f"(SELECT row_id, CAST(ids[{pick} % len(ids) + 1] AS INT) AS v FROM {source})"


BIN_MEMBERS_SQL = f"""{VARIANTS_SQL}, members AS (
  SELECT row_id, bin, list(variant_id ORDER BY variant_id) AS ids, count(*) AS n, min(variant_id) AS first
  FROM variants GROUP BY row_id, bin)"""


@query(
    "t3_largest_partition_pick",
    f"""WITH {BIN_MEMBERS_SQL}, largest AS (SELECT * FROM members
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, first) = 1)
      SELECT a.row_id, a.v AS member, b.v AS partner
      FROM {_member_sql('largest', 'member')} a JOIN {_member_sql('largest', 'partner')} b USING (row_id)""",
)
def _(spark, sf):
    return _picked(spark, sf).select("row_id", "member", "partner")


@query(
    "t4_extreme_partition_pick",
    f"""WITH {BIN_MEMBERS_SQL},
      lowest AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY bin) = 1),
      highest AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY bin DESC) = 1)
      SELECT a.row_id, a.v AS low, b.v AS high
      FROM {_member_sql('lowest', 'low')} a JOIN {_member_sql('highest', 'high')} b USING (row_id)""",
)
def _(spark, sf):
    return _picked(spark, sf).select("row_id", "low", "high")


@query(
    "t5_max_difference_partner",
    f"""WITH {REGION_SQL}, d AS (SELECT *, abs(greatest(p, 1e0 - p) - greatest(own_p, 1e0 - own_p)) AS diff FROM against),
      f AS (SELECT row_id, min(reg) AS reg FROM d WHERE cls <> own_cls GROUP BY row_id),
      g AS (SELECT row_id, reg FROM d WHERE reg <> own AND diff > 0
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY diff DESC, reg) = 1)
      SELECT a.row_id, CAST(coalesce(f.reg, g.reg, -1) AS INT) AS partner, CAST(f.reg IS NOT NULL AS INT) AS flips
      FROM applicants a LEFT JOIN f USING (row_id) LEFT JOIN g USING (row_id)""",
)
def _(spark, sf):
    domain = protected_domain(spark, sf, ["reg"])
    low = applicant_bounds(spark, sf)["reg"][0]
    scored = score.variant_probabilities(applicants(spark, sf), LOGISTIC, domain)
    partner, flips = picks.max_difference_partner(F.col("pv"), F.col("reg") - low)
    picked = scored.select("row_id", partner.alias("at"), flips.cast("int").alias("flips"))
    return picked.select("row_id", F.when(F.col("at") >= 0, F.col("at") + low).otherwise(-1).alias("partner"), "flips")
