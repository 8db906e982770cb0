"""Queries over preparation, encoding, expansion and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterfair.functions.scalar import fixed
from counterfair.operators import expand, joins, prepare, profile, recipes
from counterfair.plans.base import (
    APPLICANTS_SQL,
    FEATURES,
    FREE,
    PROTECTED,
    VARIANTS_SQL,
    applicant_bounds,
    applicants,
    protected_domain,
    query,
    table,
    variants,
)

WITH = f"WITH {APPLICANTS_SQL}"


@query("p1_drop_keep_cols", "SELECT p_partkey, p_brand, p_type FROM part")
def _(spark, sf):
    part = prepare.drop_cols(table(spark, sf, "part"), ["p_name", "p_retailprice"])
    return prepare.keep_cols(part, ["p_partkey", "p_brand", "p_type", "absent"])


@query("p2_label_last", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, p_type FROM part")
def _(spark, sf):
    return prepare.label_last(table(spark, sf, "part"), "p_type")


@query(
    "p3_binarize_threshold",
    """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'old' ELSE 'young' END AS age,
      CASE WHEN p_size % 5 = 0 THEN 'old' WHEN p_size >= 40 THEN 'old' ELSE 'young' END AS age_negated
      FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    stored = F.when(F.col("p_size") % 5 == 0, "").otherwise((-F.col("p_size")).cast("string"))
    return part.select(
        "p_partkey",
        prepare.binarize_threshold(F.col("p_size")).alias("age"),
        prepare.binarize_threshold(stored, negated=True).alias("age_negated"),
    )


PART_TEXT = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]


def _part_text(spark, sf):
    return table(spark, sf, "part").select(*[F.col(c).cast("string").alias(c) for c in PART_TEXT])


@query(
    "p4_detect_categorical",
    "WITH t AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in PART_TEXT) + " FROM part) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST(max(CASE WHEN try_cast({c} AS DOUBLE) IS NULL AND {c} <> '' THEN 1 ELSE 0 END)"
        f" AS INT) AS categorical FROM t"
        for c in PART_TEXT
    ),
)
def _(spark, sf):
    return profile.detect_categorical(_part_text(spark, sf), PART_TEXT)


CATEGORIES = ["p_brand", "p_type"]


@query(
    "p5_category_values",
    "SELECT DISTINCT 'p_brand' AS col, p_brand AS value FROM part"
    " UNION ALL SELECT DISTINCT 'p_type', p_type FROM part",
)
def _(spark, sf):
    return profile.category_values(_part_text(spark, sf), CATEGORIES)


@query(
    "p6_label_encode",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code,
      dense_rank() OVER (ORDER BY p_type) - 1 AS type_code FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    codes = profile.column_codes(part, ["p_brand", "p_type"])
    coded = prepare.encode_columns(part, codes, ["p_brand", "p_type"])
    return coded.select("p_partkey", F.col("p_brand").alias("brand_code"), F.col("p_type").alias("type_code"))


@query("p7_label_decode", "SELECT p_partkey, p_brand AS brand, p_type AS type FROM part")
def _(spark, sf):
    part = coded = table(spark, sf, "part")
    for c, out in (("p_brand", "brand"), ("p_type", "type")):
        encoder = prepare.label_encoder(part, c)
        coded = prepare.label_decode(prepare.label_encode(coded, c, encoder, out), out, encoder)
    return coded.select("p_partkey", "brand", "type")


PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}


@query(
    "p8_dict_encode",
    "SELECT o_orderkey, "
    + "coalesce(CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITIES.items())
    + " END, -1) AS priority_code FROM orders",
)
def _(spark, sf):
    code = prepare.dict_encode(F.col("o_orderpriority"), PRIORITIES)
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(code, F.lit(-1)).alias("priority_code"))


STATUSES = ["O", "F", "P"]


@query(
    "p9_enum_encode",
    "SELECT o_orderkey, CAST(list_position(['O', 'F', 'P'], o_orderstatus) - 1 AS INT) AS status_code FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", prepare.enum_encode(F.col("o_orderstatus"), STATUSES).alias("status_code")
    )


@query(
    "p10_scale_clip",
    "SELECT c_custkey, CAST(trunc(least(greatest(c_acctbal / 50e0, -20e0), 179e0)) AS INT) AS balance FROM customer",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", prepare.scale_clip(F.col("c_acctbal"), 50, -20, 179).alias("balance")
    )


@query(
    "p11_sentinel_flag",
    "SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey END = -1 AS INT) AS never FROM customer",
)
def _(spark, sf):
    days = F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey"))
    return table(spark, sf, "customer").select("c_custkey", prepare.sentinel_flag(days).alias("never"))


@query(
    "p12_equal_width_bin",
    """SELECT c_custkey, CAST(least(greatest(ceil((c_acctbal - mn) / ((mx - mn) / 9e0)), 1), 9) AS INT) AS bal
      FROM customer CROSS JOIN (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer)""",
)
def _(spark, sf):
    return prepare.equal_width_bin(table(spark, sf, "customer"), "c_acctbal", 9, "bal").select("c_custkey", "bal")


@query("p13_shift_codes", f"{WITH} SELECT row_id, seg + 1 AS seg, reg + 1 AS reg, bal, n_ord, label FROM applicants")
def _(spark, sf):
    return prepare.shift_codes(applicants(spark, sf), PROTECTED)


@query("p14_binarize_label", f"{WITH} SELECT row_id, CAST(n_ord >= 10 AS INT) AS passed FROM applicants")
def _(spark, sf):
    return applicants(spark, sf).select("row_id", prepare.binarize_label(F.col("n_ord"), 10).alias("passed"))


@query(
    "p15_mean_impute",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS w FROM customer)
      SELECT c_custkey, floor(coalesce(v, (SELECT avg(v) FROM t)) * 1e4 + 0.5e0) / 1e4 AS balance,
        floor(coalesce(w, (SELECT avg(w) FROM t)) * 1e4 + 0.5e0) / 1e4 AS nation FROM t""",
)
def _(spark, sf):
    holed = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
    )
    filled = prepare.mean_impute(holed, ["balance", "nation"])
    return filled.select("c_custkey", *[fixed(F.col(c), 4).alias(c) for c in ("balance", "nation")])


BOUND_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "c_name"]


@query(
    "p16_column_bounds",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST(coalesce(floor(min(try_cast({c} AS DOUBLE))), 0) AS BIGINT) AS lo,"
        f" CAST(coalesce(ceil(max(try_cast({c} AS DOUBLE))), 0) AS BIGINT) AS hi FROM customer"
        for c in BOUND_COLUMNS
    ),
)
def _(spark, sf):
    return profile.column_bounds(table(spark, sf, "customer"), BOUND_COLUMNS)


TIGHT = {"bal": (2, 8), "n_ord": (5, 15)}


@query(
    "p17_clip_to_bounds",
    f"{WITH} SELECT row_id, seg, reg, least(greatest(bal, 2), 8) AS bal, least(greatest(n_ord, 5), 15) AS n_ord,"
    " label FROM applicants",
)
def _(spark, sf):
    return prepare.clip_to_bounds(applicants(spark, sf), TIGHT)


@query(
    "p18_out_of_bounds",
    f"{WITH} SELECT * FROM applicants WHERE bal NOT BETWEEN 2 AND 8 OR n_ord NOT BETWEEN 5 AND 15",
)
def _(spark, sf):
    return prepare.out_of_bounds(applicants(spark, sf), TIGHT)


@query("p19_one_hot_label", f"{WITH} SELECT row_id, 1 - label AS y0, label AS y1 FROM applicants")
def _(spark, sf):
    hot = prepare.one_hot_label(F.col("label"))
    return applicants(spark, sf).select("row_id", hot[0].alias("y0"), hot[1].alias("y1"))


@query("p20_mask_protected", f"{WITH} SELECT row_id, 0 AS seg, 0 AS reg, bal, n_ord, label FROM applicants")
def _(spark, sf):
    return prepare.mask_protected(applicants(spark, sf), PROTECTED)


TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM"]


@query(
    "p21_parse_key_values",
    "SELECT p_partkey, p_brand AS \"Brand\", CAST(p_size AS VARCHAR) AS \"Size\", coalesce(CASE p_type "
    + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TYPES))
    + " END, -1) AS type_code FROM part",
)
def _(spark, sf):
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Brand: "), F.col("p_brand")),
        F.concat(F.lit("Type: "), F.col("p_type")),
        F.concat(F.lit("Size: "), F.col("p_size").cast("string")),
    )
    answers = table(spark, sf, "part").select("p_partkey", text.alias("answer"))
    brand, kind, size = prepare.parse_key_values(F.col("answer"), ["Brand", "Type", "Size"])
    mapping = {t: i + 1 for i, t in enumerate(TYPES)}
    code = F.coalesce(prepare.dict_encode(kind, mapping), F.lit(-1))
    return answers.select("p_partkey", brand, size, code.alias("type_code"))


@query(
    "j1_expand_protected",
    f"WITH {VARIANTS_SQL} SELECT row_id, seg, reg, bal, n_ord, label, variant_id FROM variants",
)
def _(spark, sf):
    return expand.expand_protected(applicants(spark, sf), protected_domain(spark, sf))


@query(
    "j2_flip_protected",
    f"{WITH} SELECT row_id, CASE WHEN seg = 0 THEN 4 ELSE 0 END AS seg, reg, bal, n_ord FROM applicants",
)
def _(spark, sf):
    lo, hi = applicant_bounds(spark, sf)["seg"]
    return applicants(spark, sf).select("row_id", expand.flip_protected(F.col("seg"), lo, hi).alias("seg"), "reg", *FREE)


TURNS_SQL = """WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn,
    lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, text AS original, next_text AS counterfactual FROM t
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1"""


@query("j3_pair_messages", TURNS_SQL)
def _(spark, sf):
    return joins.pair_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant")


@query(
    "j4_merge_on_keys",
    """SELECT a.o_custkey, a.o_orderpriority, a.o_orderkey AS "o_orderkey.x", b.o_orderkey AS "o_orderkey.y",
      a.o_totalprice AS "o_totalprice.x", b.o_totalprice AS "o_totalprice.y"
      FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
      WHERE a.o_orderkey % 2 = 1 AND b.o_orderkey % 2 = 0""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    first = orders.filter(F.col("o_orderkey") % 2 == 1)
    second = orders.filter(F.col("o_orderkey") % 2 == 0)
    return joins.merge_on_keys(first, second, ["o_custkey", "o_orderpriority"])


@query(
    "j5_not_seen",
    f"""{WITH}, c AS (SELECT bal, n_ord, min(row_id) AS row_id FROM applicants WHERE label = 1 GROUP BY bal, n_ord)
      SELECT c.row_id, a.seg, a.reg, c.bal, c.n_ord FROM c JOIN applicants a USING (row_id)
      WHERE NOT EXISTS (SELECT 1 FROM applicants v WHERE v.label = 0 AND v.seg = 0 AND v.bal = c.bal AND v.n_ord = c.n_ord)
        AND NOT EXISTS (SELECT 1 FROM applicants v WHERE v.label = 0 AND v.reg = 1 AND v.bal = c.bal AND v.n_ord = c.n_ord)""",
)
def _(spark, sf):
    rows = applicants(spark, sf)
    candidates = rows.filter(F.col("label") == 1).drop("label")
    seen = rows.filter(F.col("label") == 0)
    return joins.not_seen(
        candidates, FREE, ["row_id"], seen.filter(F.col("seg") == 0), seen.filter(F.col("reg") == 1)
    )


@query(
    "j5_not_seen_among_many",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
        AND o_custkey NOT IN (SELECT o.o_custkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' AND l.l_quantity > 30)
      GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    visited = orders.join(returned, "o_orderkey").select("o_custkey")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return joins.not_seen_among_many(urgent, ["o_custkey"], ["o_orderkey"], visited)


@query(
    "j7_attach_by_key",
    f"""WITH {VARIANTS_SQL}, acc AS (SELECT seg, reg, floor(avg(CAST(cls = label AS INT)) * 1e6 + 0.5e0) / 1e6 AS acc
        FROM variants GROUP BY seg, reg)
      SELECT v.row_id, v.seg, v.reg, a.acc FROM variants v JOIN acc a USING (seg, reg)""",
)
def _(spark, sf):
    grid = variants(spark, sf)
    acc = grid.groupBy("seg", "reg").agg(
        fixed(F.avg((F.col("cls") == F.col("label")).cast("int")), 6).alias("acc")
    )
    return joins.attach_by_key(grid.select("row_id", "seg", "reg"), acc, ["seg", "reg"])


@query(
    "j8_neighbour_join",
    f"""{WITH}, b AS (SELECT min(bal) AS b0, max(bal) AS b1, min(n_ord) AS n0, max(n_ord) AS n1 FROM applicants)
      SELECT row_id, seg, reg, CAST(least(greatest(bal + CASE WHEN feature = 'bal' THEN delta ELSE 0 END, b0), b1) AS INT) AS bal,
        CAST(least(greatest(n_ord + CASE WHEN feature = 'n_ord' THEN delta ELSE 0 END, n0), n1) AS INT) AS n_ord,
        feature, delta
      FROM applicants CROSS JOIN b
      CROSS JOIN (VALUES ('bal', -1), ('bal', 1), ('n_ord', -1), ('n_ord', 1)) m(feature, delta)""",
)
def _(spark, sf):
    bounds = applicant_bounds(spark, sf)
    return expand.neighbour_join(applicants(spark, sf).drop("label"), {f: bounds[f] for f in FREE})


@query(
    "u1_union_tables",
    f"{WITH} SELECT row_id, seg, reg, bal, n_ord, 'local' AS phase FROM applicants WHERE label = 1"
    " UNION ALL SELECT row_id, seg, reg, bal, n_ord, 'global' FROM applicants WHERE label = 0",
)
def _(spark, sf):
    rows = applicants(spark, sf)
    local = rows.filter(F.col("label") == 1).select("row_id", *FEATURES, F.lit("local").alias("phase"))
    wide = rows.filter(F.col("label") == 0).select(F.lit("global").alias("phase"), *reversed(FEATURES), "row_id")
    return prepare.union_tables(local, wide)


@query("u2_column_difference", f"{WITH} SELECT bal, n_ord, count(*) AS n FROM applicants GROUP BY bal, n_ord")
def _(spark, sf):
    free = prepare.column_difference(FEATURES, PROTECTED)
    return applicants(spark, sf).groupBy(*free).agg(F.count(F.lit(1)).alias("n"))


@query("u3_distinct_keys", f"{WITH} SELECT DISTINCT 0 AS seg, 0 AS reg, bal, n_ord FROM applicants")
def _(spark, sf):
    return prepare.distinct_keys(applicants(spark, sf).select(*FEATURES), PROTECTED)


# A raw, all-string customer table: blanks in a numeric column, an age column and a text label.
RAW_SQL = """raw AS (SELECT CAST(c_nationkey + 20 AS VARCHAR) AS age, c_mktsegment AS segment,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS number,
  CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS income FROM customer)"""


def raw_customers(spark, sf):
    return table(spark, sf, "customer").select(
        (F.col("c_nationkey") + 20).cast("string").alias("age"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_custkey").cast("string")).alias("number"),
        F.when(F.col("c_acctbal") > 5000, "rich").otherwise("poor").alias("income"),
    )


@query(
    "raw_table_recipe",
    f"""WITH {RAW_SQL}, n AS (SELECT *, try_cast(nullif(number, '') AS DOUBLE) AS v FROM raw)
      SELECT CAST(CAST(age AS INT) < 40 AS INT) AS age, dense_rank() OVER (ORDER BY segment) - 1 AS segment,
        floor(coalesce(v, (SELECT avg(v) FROM n)) * 1e4 + 0.5e0) / 1e4 AS number,
        dense_rank() OVER (ORDER BY income) - 1 AS income FROM n""",
)
def _(spark, sf):
    ready = recipes.prepare_raw(raw_customers(spark, sf), age="plain")
    return ready.table.withColumn("number", fixed(F.col("number"), 4))


@query(
    "raw_table_profile",
    f"""WITH {RAW_SQL} SELECT 'age' AS col, 0 AS pos, 'categorical' AS kind, 0 AS lo, 1 AS hi, 'old,young' AS vals
      UNION ALL SELECT 'segment', 1, 'categorical', 0, count(DISTINCT segment) - 1, string_agg(DISTINCT segment, ',' ORDER BY segment) FROM raw
      UNION ALL SELECT 'number', 2, 'numeric', min(CAST(nullif(number, '') AS BIGINT)), max(CAST(nullif(number, '') AS BIGINT)), '' FROM raw""",
)
def _(spark, sf):
    ready = recipes.prepare_raw(raw_customers(spark, sf), age="plain")
    vals = ready.codes.groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vals"))
    return ready.profile.join(vals, "col", "left").select("col", "pos", "kind", "lo", "hi", F.coalesce("vals", F.lit("")).alias("vals"))
