"""Ranks, running values and percentiles against plain Python, with heavy groups and many small partitions."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwork.plans.global_order import percentiles, quantile_points, tie_running, with_running


@pytest.fixture()
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_of(seed, n=600):
    rng = random.Random(seed)
    # One group holds most of the rows.
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randint(0, 40), i) for i in range(n)]


def test_position_and_running_values(spark, many_partitions):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    out = with_running(df, [F.col("v").desc(), F.col("id").asc()],
                       {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "id")}, totals={"all": "s"}, group_size="n")
    want, total = sorted(rows, key=lambda r: (-r[1], r[2])), sum(r[1] for r in rows)
    running, low = 0, 10 ** 9
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, (_, v, id_) in enumerate(want, 1):
        running, low = running + v, min(low, id_)
        r = got[id_]
        assert (r["position"], r["s"], r["hi"], r["lo"], r["all"], r["n"]) == (i, running, want[0][1], low, total, len(rows))


def test_groups_spanning_partitions(spark, many_partitions):
    rows = rows_of(2) + [(None, 3, 1000), (None, 1, 1001)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(4)
    out = with_running(df, [F.col("v").asc(), F.col("id").asc()], {"s": ("sum", "v")}, group=["g"], group_size="n")
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        mine, running = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 0
        for i, (_, v, id_) in enumerate(mine, 1):
            running += v
            assert (got[id_]["position"], got[id_]["s"], got[id_]["n"]) == (i, running, len(mine))


def test_ties_count_together(spark):
    df = spark.createDataFrame([(5,), (5,), (3,), (3,), (1,)], "v int")
    got = {r["v"]: r["s"] for r in tie_running(df, "v", {"s": "v"}).collect()}
    assert got == {5: 10, 3: 16, 1: 17}


def test_running_over_nothing(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert with_running(df, [F.col("v").asc()], {"s": ("sum", "v")}, group=["g"]).count() == 0
    assert percentiles(df, "v", {"m": 0.5}).first()["m"] is None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, -1.0, 1e-9])), min_size=1, max_size=60))
def test_percentiles_as_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = percentiles(df, "v", {"p5": 0.05, "m": 0.5, "p90": 0.9, "top": 1.0}).first()
    want = np.percentile(values, [5, 50, 90, 100])
    assert np.allclose([got["p5"], got["m"], got["p90"], got["top"]], want, rtol=1e-12, atol=1e-12)


def test_quantile_points_per_group(spark, many_partitions):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=997).tolist(), rng.integers(0, 5, 400).astype(float).tolist()
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("a", None)], "g string, v double")
    got = quantile_points(df, "v", 20, ["g"]).orderBy("g", "k").collect()
    for g, values in (("a", a), ("b", b)):
        want = np.quantile(values, np.linspace(0, 1, 21)[1:-1])
        assert np.allclose([r["boundary"] for r in got if r["g"] == g], want)
