"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated, or ``all``) the
queries. Every query runs to completion into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillwork import catalog  # noqa: E402
from tillwork.session import local_session  # noqa: E402

HEADLINE = (
    # loads and cleaning
    "scan_csv", "scan_csv_reject", "scan_json", "load_catalog", "load_transactional", "stream_incremental_load",
    "cast_lenient_schema", "infer_string_type",
    # datasets, filters, joins
    "join_star", "filter_rolling_days", "filter_top_revenue_product", "filter_top_revenue_customer", "filter_order",
    "join_latest_dim", "semi_join_in_subquery",
    # profiles and curves
    "column_stats", "data_statistics", "customer_spend_distribution", "pareto_product", "pareto_customer",
    # training views
    "training_examples", "purchase_history_topk", "split_last_day", "negative_sampling", "union_pos_neg",
    # features
    "vocabulary_apply", "quantile_bucketize", "history_encode", "analyze_train_eval_only",
    # retrieval and evaluation
    "topk_brute_force", "topk_partitioned_ann", "recall_at_k", "auc_roc",
    # reports
    "weighted_latency", "billing_invoice", "tpe_parameter_score",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    catalog.load_all()
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cpus, "bench", spark__sql__shuffle__partitions=cpus)
    # Start the JVM's compilers and the file listing, outside the timings.
    catalog.QUERIES["join_star"](spark, root).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(root)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
