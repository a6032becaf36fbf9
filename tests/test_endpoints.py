"""Endpoint reports: stored days that merge, use of resources, every project with its own latest day."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.operators.reports import endpoints

DAY = dt.date(2024, 5, 1)


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(6)
    rows = []
    for d in range(20):
        for project, name in (("a", "x"), ("a", "y"), ("b", "x"), (None, "z")):
            if project == "b" and d > 11:
                continue  # its latest day is earlier
            for i in range(rng.randint(1, 30)):
                rows.append((DAY + dt.timedelta(days=d), project, name, rng.choice([None, float("nan"), -3.0, 0.0, rng.lognormvariate(3, 2)]), rng.random() < 0.2, rng.randint(0, 4),
                             rng.choice([None, 0.25, 0.5]) if name != "y" else None, 0.125 if name == "z" else 0.0))
    rows += [(DAY + dt.timedelta(days=3), "a", "hot", float(i % 977), False, i, 0.1, 0.2) for i in range(3000)]
    return spark.createDataFrame(rows, "day date, project string, name string, ms double, failed boolean, client int, cpu double, mem double").repartition(4)


USES = {"cpu": "cpu", "memory": "mem"}
ARGS = ("ms", "failed", "client", USES)


def by_key(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def test_stored_days_are_those_of_one_pass_and_others_stay(spark, requests, tmp_path):
    path = str(tmp_path / "days")
    cut = DAY + dt.timedelta(days=9)
    endpoints.store_days(requests.where(F.col("day") <= cut), path, *ARGS)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/*.parquet")}
    new = requests.where(F.col("day") >= cut)
    endpoints.store_days(new, path, *ARGS)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/*.parquet")}
    old = {f for f in before if f"day={cut}" not in f}
    assert old and all(after.get(f) == before[f] for f in old) and not (set(before) - old) & set(after)
    columns = ["day", "project", "name", "requests", "errors", "peak", "cpu", "memory", *endpoints._LATENCIES]
    assert by_key(endpoints.stored_days(spark, path).collect(), *columns) == by_key(endpoints.endpoint_metrics(requests, *ARGS).collect(), *columns)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "day" in plan  # a new day is a filter on its own requests


def test_percentiles_of_periods_from_merged_counts(spark, requests, tmp_path):
    path = str(tmp_path / "days")
    endpoints.store_days(requests, path, *ARGS)
    for low, high in ((0, 20), (3, 4), (5, 12)):
        a, b = DAY + dt.timedelta(days=low), DAY + dt.timedelta(days=high)
        span = (F.col("day") >= a) & (F.col("day") < b)
        got = endpoints.period_latencies(endpoints.stored_days(spark, path).where(span), requests.where(span), "ms")
        values = {}
        for r in requests.where(span).collect():
            if r["ms"] is not None and r["ms"] == r["ms"]:
                values.setdefault((r["project"], r["name"]), []).append(r["ms"])
        found = {(r["project"], r["name"]): [r[c] for c in endpoints._LATENCIES] for r in got.collect()}
        assert set(found) == set(values)
        for key, v in values.items():
            assert found[key] == pytest.approx(list(np.percentile(v, [50, 95, 99])), rel=1e-12), key


def test_mean_use_is_that_of_endpoints_that_use_anything(spark):
    rows = [(DAY, "p", "a", 1.0, False, 1, 0.5, 0.25), (DAY, "p", "a", 1.0, False, 1, 0.25, None), (DAY, "p", "b", 1.0, False, 1, None, 0.0), (DAY, "p", "c", 1.0, False, 1, 0.0, 0.5), (DAY, "q", "d", 1.0, True, 2, 0.0, None)]
    df = spark.createDataFrame(rows, "day date, project string, name string, ms double, failed boolean, client int, cpu double, mem double")
    days = endpoints.project_metrics(endpoints.endpoint_metrics(df, *ARGS)).collect()
    assert by_key(days, "project", "cpu_utilization_avg", "memory_utilization_avg", "n_endpoints") == [("p", 18.8, 37.5, 3), ("q", 0.0, 0.0, 1)]
    bare = endpoints.project_metrics(endpoints.endpoint_metrics(df, "ms", "failed", "client")).collect()
    assert {r["cpu_utilization_avg"] for r in bare} == {0.0}


def test_every_project_counts_from_its_own_latest_day(spark, requests):
    days = endpoints.endpoint_metrics(requests, *ARGS)
    plain = [r.asDict() for r in days.collect()]
    last = {p: max(r["day"] for r in plain if r["project"] == p) for p in ("a", "b", None)}
    age = lambda r: (last[r["project"]] - r["day"]).days
    perf = {(r["project"], r["name"]): r["requests"] for r in endpoints.endpoint_performance(days).collect()}
    want = {}
    for r in plain:
        if age(r) < 7:
            want[r["project"], r["name"]] = want.get((r["project"], r["name"]), 0) + r["requests"]
    assert perf == want
    week = {r["project"]: r["requests"] for r in endpoints.week_compare(endpoints.project_metrics(days)).collect()}
    assert week == {p: sum(n for (q, _), n in want.items() if q == p) for p in last}
    peaks = endpoints.peak_periods(days, limit=3).collect()
    for p in last:
        best = sorted((r for r in plain if r["project"] == p and age(r) < 30), key=lambda r: (-r["requests"], r["day"], r["name"]))[:3]
        assert [(r["day"], r["name"], r["requests"], r["max_instances"]) for r in sorted(peaks, key=lambda r: r["rank_no"]) if r["project"] == p] == [
            (r["day"], r["name"], r["requests"], r["peak"]) for r in best]
    cells = {(r["project"], r["day"], r["name"]): r["requests"] for r in endpoints.daily_matrix(days, period=9).collect()}
    for p in last:
        names = {r["name"] for r in plain if r["project"] == p and age(r) < 9}
        span = [last[p] - dt.timedelta(days=i) for i in range(9)]
        held = {(r["day"], r["name"]): r["requests"] for r in plain if r["project"] == p}
        assert {k[1:]: n for k, n in cells.items() if k[0] == p} == {(d, n): held.get((d, n), 0) for d in span for n in names}


def test_reports_of_nothing(spark, requests):
    days = endpoints.endpoint_metrics(requests.limit(0), *ARGS)
    for report in (endpoints.endpoint_performance(days), endpoints.week_compare(endpoints.project_metrics(days)), endpoints.peak_periods(days), endpoints.daily_matrix(days)):
        assert report.count() == 0
