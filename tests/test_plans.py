"""Plans: filters reach the scan, no all-pairs joins, no row-wise Python, no single-task windows over rows."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
CHECKED = [
    "filter_start_date", "join_star", "filter_top_revenue_product", "cross_join_candidates", "pareto_product",
    "training_examples", "negative_sampling", "purchase_history_topk", "coverage_matrix", "endpoint_daily_matrix",
    "billing_daily_dense", "topk_brute_force", "history_encode",
]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("name", CHECKED)
def test_no_all_pairs_and_no_row_python(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in text, name


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["filter_start_date"](spark, ROOT))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "l_tax" not in text and "l_shipdate" not in text


def test_history_rank_is_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["purchase_history_topk"](spark, ROOT))
    assert "WindowGroupLimit" in text
