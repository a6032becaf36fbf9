"""Queries against their SQL on the smallest tables. TILLWORK_ALL=1 runs every query."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tillwork.session import TABLES

ROOT = os.environ.get("TILLWORK_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "select_columns", "filter_numeric", "filter_top_revenue_product", "filter_order", "filter_topn_rank", "join_star",
    "join_key_detection", "join_round_robin", "column_stats", "customer_spend_distribution", "data_statistics",
    "pareto_product", "category_revenue_pctile", "rolling_customer_features", "rolling_true_distinct",
    "purchase_history_topk", "training_examples", "split_last_day", "split_strict_time", "negative_sampling",
    "negatives_point_in_time", "vocabulary_apply", "quantile_bucketize", "history_encode", "inverse_target",
    "topk_brute_force", "recall_at_k", "auc_roc", "scan_csv_reject", "scan_json", "load_transactional",
    "stream_incremental_load", "cast_lenient_schema", "detect_semantic_type", "weighted_latency", "billing_invoice",
    "tpe_parameter_score", "epoch_downsample", "coverage_matrix",
]
ORACLE = entry.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("TILLWORK_ALL") else SOME


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_has_a_name_and_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert "cust_value" in df.columns and df.limit(1).count() == 1
