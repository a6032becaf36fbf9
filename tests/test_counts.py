"""Distinct counts without copies of rows, and most frequent values from summaries, against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillwork.operators import distinct, filters, heavy, profile, typing


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(-40_000, 40_000, 3)]), rng.randrange(1 << 60), rng.choice([0.0, -0.0, 1.5, float("nan"), None]), rng.choice([None, "", "a", "A", "é" * 900]),
             f"unique {i}", bytes([i % 5]), i % 3 == 0, None, i - 10) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("counts") / "t")
    spark.createDataFrame(rows, "dense long, wide long, x double, s string, u string, b binary, f boolean, nothing int, small int").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_distinct_counts_are_exact(table):
    want = table.agg(*[F.count_distinct(c).alias(c) for c in table.columns]).first().asDict()
    assert distinct.distinct_counts(table, table.columns) == want
    joined = table.join(table.select("u").limit(500), "u")
    want = joined.agg(*[F.count_distinct(c).alias(c) for c in joined.columns]).first().asDict()
    assert distinct.distinct_counts(joined, joined.columns) == want
    assert set(distinct.distinct_counts(table.limit(0), table.columns).values()) == {0}


def test_numbers_beyond_every_word(spark):
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 32767, 32768, 32769, -32768, -32769, None, 0]
    df = spark.createDataFrame([(x,) for x in edge], "k long")
    assert distinct.distinct_counts(df, ["k"]) == {"k": 10}
    near = spark.range(-70_000, 70_000).union(spark.range(-10, 10))
    assert distinct.distinct_counts(near, ["id"]) == {"id": 140_000}


def test_bitmaps_are_what_is_shuffled_of_ids(spark, monkeypatch):
    df = spark.range(500_000)
    plans = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (plans.append(self), real(self))[1])
    assert distinct.distinct_counts(df, ["id"]) == {"id": 500_000}
    assert any("bitmap_construct_agg" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


@pytest.mark.parametrize("make", [
    lambda t: profile.column_stats(t, date_distinct=True), lambda t: profile.numeric_profile(t, ["dense", "wide", "x", "small"]),
    lambda t: profile.string_statistics(t, ["s", "u", "b"]), lambda t: profile.dataset_analysis(t, "dense", "u"),
    lambda t: typing.detect_semantic_types(t), lambda t: profile.date_profile(t.withColumn("d", F.to_date(F.lit("2024-01-01"))).withColumn("e", F.lit(None).cast("timestamp")), ["d", "e"])])
def test_no_row_is_copied_per_column(table, make):
    assert "Expand" not in executed(make(table))


def want_top(values, k):
    counts = Counter(v for v in values if v is not None)
    return [(v, n, i) for i, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k], 1)]


@pytest.mark.parametrize("tracked", [1 << 15, 64])
def test_top_values_against_plain_counts(spark, tracked):
    rng = random.Random(4)
    skewed = [f"w{int(rng.paretovariate(0.9))}" if rng.random() < 0.95 else None for _ in range(6000)]
    hot = ["hot"] * 2000 + ["ü"] * 1500 + [f"r{i}" for i in range(2500)]
    unique = [f"u{rng.random()}" for _ in range(6000)]
    pairs = [f"p{i // 2:05d}" for i in range(6000)]
    few = [rng.choice(["b", "a", "c"]) for _ in range(6000)]
    data = {"skewed": skewed, "hot": hot, "unique": unique, "pairs": pairs, "few": few, "none": [None] * 6000}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} string" for c in data)).repartition(6)
    got = {}
    for r in heavy.top_counts(df, list(data), 7, tracked=tracked).collect():
        got.setdefault(r["feature"], []).append((r["value"], r["n"], r["rank_no"]))
    assert {c: sorted(x, key=lambda y: y[2]) for c, x in got.items()} == {c: want_top(v, 7) for c, v in data.items() if c != "none"}
    assert heavy.top_counts(df.limit(0), ["hot", "few"], 3).count() == 0


def test_ties_that_do_not_fit_a_list(spark, monkeypatch):
    monkeypatch.setattr(heavy, "_TIES", 10)
    values = [f"{i % 997:04d}" for i in range(997 * 3)] + ["0003", "x"] + ["zz"] * 2
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = [(r["value"], r["n"], r["rank_no"]) for r in heavy.top_counts(df, ["v"], 45, tracked=32).orderBy("rank_no").collect()]
    assert got == want_top(values, 45)


def test_a_proven_list_never_shuffles_values_that_cannot_win(spark):
    """Rows out of the shuffles are bounded by the summaries, not by the distinct values."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 20)).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    told = heavy.summaries(df, ["v"])["v"]
    assert told[0] == 200_000 and 10 <= len(told[1]) <= 1000 and told[2] < 10_000
    got = [(r["value"], r["n"]) for r in heavy.top_counts(df, ["v"], 5).orderBy("rank_no").collect()]
    assert got == [(f"hot{i}", 10_000) for i in (0, 10, 12, 14, 16)]


def test_texts_of_a_unique_column_are_shuffled_as_hashes(spark):
    df = spark.range(20_000).select(F.concat(F.repeat(F.lit("long "), 200), F.col("id").cast("string")).alias("v"))
    got = heavy.top_counts(df, ["v"], 3)
    assert [r["value"].split()[-1] for r in got.orderBy("rank_no").collect()] == ["0", "1", "10"]


def test_searched_values(spark):
    df = spark.createDataFrame([(v,) for v in ["Ab", "ab", "ab", None, "xABx", "c"]], "v string")
    assert [tuple(r) for r in filters.search_values(df, "v", "AB").collect()] == [("ab", 2), ("Ab", 1), ("xABx", 1)]
    numbers = spark.createDataFrame([(12,), (2,), (12,), (32,)], "v int")
    assert [tuple(r) for r in filters.search_values(numbers, "v", "2").collect()] == [(12, 2), (2, 1), (32, 1)]


def test_summaries_of_several_filters(spark):
    """Far-apart, negative and missing ids, missing amounts, and a filter that keeps nothing; one pass without a copy of rows per count."""
    from tillwork.catalog import filters

    ids = [0, 63, 64, -1, -64, 1 << 40, None, 64, 0]
    df = spark.createDataFrame([(c, p, s) for c in ids for p, s in ((5, 1.25), (None, None), (1 << 50, -2.5))],
                               "customer_id long, product_id long, sales double")
    cases = {"all": F.lit(True), "some": F.col("sales") > 0, "none": F.col("sales") > 9, "odd": F.col("customer_id") % 2 != 0}
    out = filters._summaries(df, "case", cases)
    want = {name: filters._summary(df.where(c)).first() for name, c in cases.items()}
    assert {r["case"]: tuple(r)[1:] for r in out.collect()} == {name: tuple(r) for name, r in want.items()}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_filter_queries_join_once(spark):
    from tillwork.catalog import QUERIES

    for name in ("filter_numeric", "filter_category"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1, name


def test_fitted_queries_join_once(spark, monkeypatch):
    from tillwork.catalog import QUERIES, features

    calls, real = [], features.transactions
    monkeypatch.setattr(features, "transactions", lambda t: calls.append(1) or real(t))
    for name in ("zscore", "analyze_train_eval_only"):
        calls.clear()
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(calls) == 1 and "l_orderkey" not in plan, name


def test_lists_are_made_of_histories_with_a_vector_only(spark, monkeypatch):
    from tillwork.catalog import QUERIES, evaluation

    root, seen, real = "/root/testdata/sf0.01", [], evaluation.rolling.purchase_history
    monkeypatch.setattr(evaluation.rolling, "purchase_history", lambda pairs: seen.append(pairs) or real(pairs))
    QUERIES["batch_recommend"](spark, root)
    vectors = {r[0] for r in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id").collect()}
    bought = {}
    for r in seen[0].select("customer_id", "product_id").collect():
        bought.setdefault(r[0], set()).add(r[1])
    assert bought and all(products & vectors for products in bought.values())
    assert any(products - vectors for products in bought.values())  # what has no vector still counts among the last 50
