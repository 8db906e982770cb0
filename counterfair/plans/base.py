"""Registry of runnable queries, the shared demo tables and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfair.functions.models import LogisticModel, MlpModel
from counterfair.functions.scalar import MIX, WORD
from counterfair.operators.expand import Domain, expand_protected
from counterfair.operators.metrics import add_bin
from counterfair.operators.prepare import equal_width_bin, label_encode, label_encoder
from counterfair.operators.profile import bounds_dict, column_bounds
from counterfair.operators.score import predict_class, score_logistic
from counterfair.operators.search import SearchSpace

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*") -> SparkSession:
    """Session for tests, tools and the benchmark on one machine."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("counterfair")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.default.parallelism", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# The demo model and table: customers as applicants, protected by market segment and region.
FEATURES = ["seg", "reg", "bal", "n_ord"]
PROTECTED = ["seg", "reg"]
FREE = ["bal", "n_ord"]
EPS = 0.025
LOGISTIC = LogisticModel(tuple(FEATURES), (0.35, -0.3, 0.45, -0.12), -1.5)
WIDTHS = [64, 32, 16, 8, 4, 2]


def formula_weight(layer, i, j):
    """Reproducible network weights; i = -1 is the bias."""
    return ((7 * i + 13 * j + 3 * layer + 77) % 11 - 5) / 10.0


@lru_cache(maxsize=None)
def formula_mlp() -> MlpModel:
    layers, inputs = [], len(FEATURES)
    for number, width in enumerate(WIDTHS, start=1):
        w = formula_weight(number, np.arange(-1, inputs)[:, None], np.arange(width)[None, :])
        layers.append((w[1:], w[0]))
        inputs = width
    return MlpModel(tuple(FEATURES), tuple(layers))


def weights_table(spark: SparkSession, widths: list[int] = WIDTHS) -> DataFrame:
    """The same network as a weights(layer, i, j, w) table."""
    rows, inputs = [], len(FEATURES)
    for number, width in enumerate(widths, start=1):
        rows += [(number, i, j, formula_weight(number, i, j)) for i in range(-1, inputs) for j in range(width)]
        inputs = width
    return spark.createDataFrame(rows, "layer INT, i INT, j INT, w DOUBLE")


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, seg, reg, bal, n_ord, label), one row per customer."""
    customer, nation, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    overall = orders.agg(F.avg("o_totalprice")).scalar()
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("o_totalprice").alias("_avg")
    )
    binned = equal_width_bin(customer, "c_acctbal", 10, "bal")
    coded = label_encode(binned, "c_mktsegment", label_encoder(customer, "c_mktsegment"), "seg")
    placed = coded.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = placed.join(per_customer, "c_custkey", "left")
    rows = joined.select(
        F.col("c_custkey").alias("row_id"),
        F.col("seg").cast("int").alias("seg"),
        F.col("n_regionkey").cast("int").alias("reg"),
        "bal",
        F.coalesce("_n", F.lit(0)).cast("int").alias("n_ord"),
        F.coalesce((F.col("_avg") > overall).cast("int"), F.lit(0)).alias("label"),
    )
    return by_row(rows, "row_id", customer.count())


ROWS_PER_PARTITION = 500_000


def by_row(df: DataFrame, key: str, count: int) -> DataFrame:
    """Partition by row id once, for everything that follows.

    Expansion and scoring keep this partitioning, so per-row aggregates need no further shuffle; it also
    spreads a few large input splits over all cores before the costly scoring. The number of partitions
    grows with ``count`` (from the file footers): few bytes a row, but much work, so bytes would tell too little.
    """
    wanted = -(-count // ROWS_PER_PARTITION)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, wanted), key)


_BOUNDS: dict[str, dict[str, tuple[int, int]]] = {}


def applicant_bounds(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """Bounds of the applicant features, taken from the data once per folder."""
    if sf_dir not in _BOUNDS:
        _BOUNDS[sf_dir] = bounds_dict(column_bounds(applicants(spark, sf_dir), FEATURES))
    return _BOUNDS[sf_dir]


def protected_domain(spark: SparkSession, sf_dir: str, names: list[str] = PROTECTED) -> Domain:
    bounds = applicant_bounds(spark, sf_dir)
    return Domain.of({n: bounds[n] for n in names})


def space(spark: SparkSession, sf_dir: str, protected: list[str]) -> SearchSpace:
    return SearchSpace(applicant_bounds(spark, sf_dir), tuple(protected), EPS)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants under every (seg, reg), scored by the logistic model and binned."""
    wide = expand_protected(applicants(spark, sf_dir), protected_domain(spark, sf_dir))
    scored = add_bin(score_logistic(wide, LOGISTIC), EPS)
    return scored.withColumn("cls", predict_class(F.col("p")))


# SQL forms of the same tables, for the DuckDB side.
def double(v: float) -> str:
    return f"{v!r}e0" if "e" not in repr(v) else repr(v)


def rounded(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


APPLICANTS_SQL = """applicants AS (
  SELECT c.c_custkey AS row_id,
    CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) - 1 AS INT) AS seg,
    CAST(n.n_regionkey AS INT) AS reg,
    CAST(CASE WHEN s.mx = s.mn THEN 1
         ELSE least(greatest(ceil((c.c_acctbal - s.mn) / ((s.mx - s.mn) / 10e0)), 1), 10) END AS INT) AS bal,
    CAST(coalesce(o.n, 0) AS INT) AS n_ord,
    CAST(coalesce(o.m > (SELECT avg(o_totalprice) FROM orders), false) AS INT) AS label
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  CROSS JOIN (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer) s
  LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1) o
    ON o.o_custkey = c.c_custkey)"""

DOMAIN_SQL = """segs AS (SELECT unnest(range(min(seg), max(seg) + 1)) AS seg FROM applicants),
regs AS (SELECT unnest(range(min(reg), max(reg) + 1)) AS reg FROM applicants)"""


def logit_sql(prefix: str = "") -> str:
    terms = " + ".join(f"{prefix}{f} * {double(w)}" for f, w in zip(FEATURES, LOGISTIC.weights))
    return f"({double(LOGISTIC.bias)} + {terms})"


def probability_sql(prefix: str = "") -> str:
    return rounded(f"1e0 / (1e0 + exp(-{logit_sql(prefix)}))", 9)


EDGES_SQL = "[" + ", ".join(double(float(e)) for e in np.arange(0, 1, EPS)) + "]"


def bin_sql(p: str = "p") -> str:
    return f"CAST(len(list_filter({EDGES_SQL}, lambda e: e <= {p})) - 1 AS INT)"


VARIANTS_SQL = f"""{APPLICANTS_SQL}, {DOMAIN_SQL},
raw_variants AS (
  SELECT a.row_id, s.seg, r.reg, a.bal, a.n_ord, a.label, a.seg AS own_seg, a.reg AS own_reg,
    CAST((s.seg - (SELECT min(seg) FROM segs)) * (SELECT count(*) FROM regs)
         + r.reg - (SELECT min(reg) FROM regs) AS INT) AS variant_id
  FROM applicants a CROSS JOIN segs s CROSS JOIN regs r),
scored AS (SELECT *, {probability_sql()} AS p FROM raw_variants),
variants AS (SELECT *, {bin_sql()} AS bin, CAST(p > 0.5 AS INT) AS cls FROM scored)"""


def mix_sql(tag: str, *parts: str) -> str:
    """SQL form of ``functions.scalar.mix_int``."""
    words = [w for p in parts for w in (f"CAST({p} AS BIGINT) & {WORD}", f"(CAST({p} AS BIGINT) >> 32) & {WORD}")]
    product = f"((xor(h, w) * {MIX}) & {WORD})"
    listed = ", ".join([f"CAST({crc32(tag.encode())} AS BIGINT)", *words, "0", "0"])
    return f"list_reduce(CAST([{listed}] AS BIGINT[]), lambda h, w: xor({product}, {product} >> 15))"


def digest_sql(*parts: str) -> str:
    """SQL form of ``functions.scalar.hash_int``."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"
