"""Headline timings. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from counterfair.operators import expand, logs, metrics, score, search  # noqa: E402
from counterfair.plans import registry, source_plans  # noqa: E402
from counterfair.plans.base import (  # noqa: E402
    EPS,
    FEATURES,
    LOGISTIC,
    PROTECTED,
    applicants,
    formula_mlp,
    local_session,
    protected_domain,
    space,
    table,
)
from counterfair.sources import lines  # noqa: E402

HEADLINE = [
    "flagship_partition_report",
    "flagship_row_metrics",
    "m1_row_metrics",
    "j1_expand_protected",
    "m1_score_mlp",
    "a1_score_partitions",
    "a8_mixed_group_count",
    "a12_search_report",
    "g1_search_step",
    "g1_global_search",
    "g2_local_search",
    "j6_pairwise_max_distance",
    "a15_neuron_stats",
    "m5_force_neuron",
    "a19_neuron_effect",
    "w1_sessionize_by_marker",
    "a21_log_summary",
    "g8_validate_responses",
    "j4_merge_on_keys",
    "p6_label_encode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    # Warm the JVM, the Python workers and the bounds of the demo table.
    size = protected_domain(spark, sf_dir).size
    rows = applicants(spark, sf_dir).count()
    events = table(spark, sf_dir, "events").count()
    registry.QUERIES["m1_score_mlp"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    # Operator rates on the prepared table and a written log, without their preparation.
    domain, ready = protected_domain(spark, sf_dir), applicants(spark, sf_dir).cache()
    ready.count()
    logs_path = source_plans.write_event_log(spark, sf_dir)
    wide = expand.expand_protected(ready, domain)
    start = ready.select(F.col("row_id").alias("seed_id"), *FEATURES, F.lit(0).alias("step"))

    def per_second(amount: int, df) -> int:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(amount / (time.perf_counter() - began))

    grouped = metrics.partition_report(metrics.add_bin(score.score_logistic(wide, LOGISTIC), EPS), "row_id")
    where = space(spark, sf_dir, PROTECTED)
    rates = {
        "logistic_variants_per_sec": per_second(rows * size, score.row_metrics(ready, LOGISTIC, domain, EPS)),
        "network_variants_per_sec": per_second(rows * size, score.row_metrics(ready, formula_mlp(), domain, EPS)),
        "grouped_rows_per_sec": per_second(rows, grouped),
        "search_seeds_per_sec": per_second(rows, search.search_step(start, LOGISTIC, where)),
        "log_lines_per_sec": per_second(events, logs.log_summary(lines.read_blocks(spark, logs_path))),
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
