"""Endpoint reports: latency and load per endpoint and day, project totals, week comparisons.

Days of endpoints are rows of a stored table (``store_days``), a folder per day, so a new day reads its own requests only.
Beside the day's exact percentiles a row keeps how many requests lie in each order-keeping bin of latency. Counts of days
add up: percentiles of a period come from them, and only the requests of the bins that hold a wanted rank are read again.
All reports hold for every project at once, and count days back from the project's latest one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwork.functions.numbers import percent, ratio, rounded, weighted_sum
from tillwork.plans.global_order import bin_counts, percentiles
from tillwork.session import pin

_LATENCIES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
_KEYS = ["day", "project", "name"]
USES = ("cpu", "memory")


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join in which nulls are a key like any other."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, match, "left").drop(*[f"_{k}" for k in keys])


def endpoint_metrics(requests: DataFrame, latency: str, failed: str, client: str, uses: Mapping[str, str] | None = None,
                     counts: DataFrame | None = None) -> DataFrame:
    """Per day, project and endpoint: requests, errors, exact latency percentiles, distinct clients, and mean use in percent.

    ``requests`` has day, project and name. Percentiles hold for endpoints of any traffic. ``uses`` names the columns with
    the share (0 to 1) of each resource in ``USES``; what is not named is 0.
    """
    uses = dict(uses or {})
    requests = pin(requests.select(*_KEYS, latency, failed, client, *uses.values()), "requests")

    def used(resource: str) -> Column:
        if resource not in uses:
            return F.lit(0.0)
        c = F.col(uses[resource]).cast("decimal(18,8)")
        return F.coalesce(rounded(ratio(F.sum(c) * 100, F.count(c)), 1), F.lit(0.0))

    volume = requests.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(failed)).alias("errors"),
        F.count_distinct(client).alias("peak"), *[used(x).alias(x) for x in USES])
    return _beside(volume, percentiles(requests, latency, _LATENCIES, group=_KEYS, counts=counts), _KEYS)


def project_metrics(endpoints: DataFrame) -> DataFrame:
    """Per day and project: totals, request-weighted latencies, instances, mean use, and the number of endpoints.

    Mean use is that of the endpoints that use anything.
    """
    weight = F.when(F.col("requests") > 0, F.col("requests"))
    weighted = [
        F.coalesce(rounded(ratio(weighted_sum(F.col(c), weight), F.sum(weight)), 1), F.lit(0.0)).alias(c) for c in _LATENCIES
    ]
    busy = (F.col("cpu") > 0) | (F.col("memory") > 0)
    use = [F.coalesce(rounded(ratio(F.sum(F.when(busy, F.col(x).cast("decimal(18,8)"))), F.count_if(busy)), 1), F.lit(0.0)).alias(f"{x}_utilization_avg")
           for x in USES]
    return endpoints.groupBy("day", "project").agg(
        F.sum("requests").alias("total_requests"), F.sum("errors").alias("error_count"), *weighted,
        F.max("peak").alias("instance_count_peak"), rounded(F.avg("peak"), 1).alias("instance_count_avg"),
        *use, F.count(F.lit(1)).alias("n_endpoints"))


# Stored days -------------------------------------------------------------------------------------------------------

def store_days(requests: DataFrame, path: str, latency: str, failed: str, client: str, uses: Mapping[str, str] | None = None) -> None:
    """Write the days that ``requests`` hold to the stored table; a day that is there already is replaced, others stay."""
    rows = pin(requests.select(*_KEYS, latency, failed, client, *(uses or {}).values()), "new-days")
    counts = pin(bin_counts(rows, latency, _KEYS), "new-counts")
    # A few thousand bins a day and endpoint at most: the range of doubles in steps of one percent.
    bins = counts.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct(F.col("_bin").alias("bin"), F.col("_n").alias("n")))).alias("latency_bins"))
    days = _beside(endpoint_metrics(rows, latency, failed, client, uses, counts=counts), bins, _KEYS)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def period_latencies(stored: DataFrame, requests: DataFrame, latency: str, group: Sequence[str] = ("project", "name")) -> DataFrame:
    """Exact percentiles over all stored days, from their counts and the requests of the bins that hold them.

    ``requests`` are those of the same days; both may be filtered to a period by ``day``.
    """
    counts = stored.select(*group, F.explode("latency_bins").alias("b")).groupBy(*group, F.col("b.bin").alias("_bin")).agg(F.sum("b.n").alias("_n"))
    return percentiles(requests.select(*group, latency), latency, _LATENCIES, group=list(group), counts=pin(counts, "period-counts"))


# Reports -----------------------------------------------------------------------------------------------------------

def _aged(rows: DataFrame) -> DataFrame:
    """``_age``: days before the project's latest day."""
    last = rows.groupBy(F.col("project").alias("_p")).agg(F.max("day").alias("_last"))
    return rows.join(last, F.col("project").eqNullSafe(F.col("_p"))).withColumn("_age", F.datediff("_last", "day")).drop("_p", "_last")


def week_compare(daily: DataFrame) -> DataFrame:
    """Last 7 days against the 7 before, per project: volume, weighted p95, error rate and its trend, instances, use."""
    daily, age, n = _aged(daily), F.col("_age"), F.col("total_requests")
    now, before = age < 7, (age >= 7) & (age < 14)
    recent, earlier = age < 3, (age >= 3) & (age < 7)

    def total(c, when):
        return F.coalesce(F.sum(F.when(when, c)), F.lit(0))

    one = daily.groupBy("project").agg(
        total(n, now).alias("requests"), total(n, before).alias("_requests_before"),
        total(F.col("error_count"), now).alias("_errors"),
        weighted_sum(F.col("latency_p95_ms"), F.when(now, n)).alias("_p95"),
        weighted_sum(F.col("latency_p95_ms"), F.when(before, n)).alias("_p95_before"),
        total(n, recent).alias("_n3"), total(F.col("error_count"), recent).alias("_e3"),
        total(n, earlier).alias("_n4"), total(F.col("error_count"), earlier).alias("_e4"),
        F.count_distinct(F.when(now, F.col("day"))).alias("_days"),
        F.max(F.when(now, F.col("instance_count_peak"))).alias("peak_instances"),
        F.avg(F.when(now & (F.col("instance_count_avg") > 0), F.col("instance_count_avg"))).alias("_avg"))

    def share(a, b):
        return F.coalesce(ratio(F.col(a) * 100, F.col(b)), F.lit(0.0))

    p95 = F.coalesce(rounded(ratio(F.col("_p95"), F.col("requests")), 0), F.lit(0.0))
    p95_before = F.coalesce(rounded(ratio(F.col("_p95_before"), F.col("_requests_before")), 0), F.lit(0.0))
    drift = share("_e3", "_n3") - share("_e4", "_n4")
    return one.select(
        "project", "requests",
        F.coalesce(percent(F.col("requests") - F.col("_requests_before"), F.col("_requests_before"), 1), F.lit(0.0))
        .alias("request_change_pct"),
        p95.alias("p95_ms"), (p95 - p95_before).alias("p95_change_ms"), rounded(share("_errors", "requests"), 2).alias("error_rate_pct"),
        F.when((F.col("_days") < 4) | (F.abs(drift) < 0.01), "stable").when(drift > 0, "up").otherwise("down").alias("error_trend"),
        F.coalesce("peak_instances", F.lit(0)).alias("peak_instances"),
        F.coalesce(rounded(F.col("_avg"), 1), F.lit(0.0)).alias("avg_instances"))


def endpoint_performance(days: DataFrame) -> DataFrame:
    """Per endpoint over 7 days: volume, weighted latencies, errors, and the change against the week before.

    ``days`` are the rows of ``endpoint_metrics``.
    """
    rows = _aged(days)
    now, before = F.col("_age") < 7, (F.col("_age") >= 7) & (F.col("_age") < 14)
    n = F.when(now, F.col("requests"))
    one = rows.groupBy("project", "name").agg(
        F.sum(n).alias("requests"), F.sum(F.when(now, F.col("errors"))).alias("errors"),
        weighted_sum(rounded(F.col("latency_p50_ms"), 1), n).alias("_p50"),
        weighted_sum(rounded(F.col("latency_p95_ms"), 1), n).alias("_p95"),
        F.sum(F.when(before, F.col("requests"))).alias("_before"))
    zero = F.lit(0.0)
    return one.where(F.col("requests").isNotNull()).select(
        "project", "name", "requests", F.coalesce(rounded(ratio(F.col("_p50"), F.col("requests")), 1), zero).alias("avg_latency"),
        F.coalesce(rounded(ratio(F.col("_p95"), F.col("requests")), 1), zero).alias("p95_latency"), "errors",
        F.coalesce(percent(F.col("errors"), F.col("requests")), zero).alias("error_rate"),
        F.coalesce(percent(F.col("requests") - F.col("_before"), F.col("_before"), 1), zero).alias("trend"))


def peak_periods(days: DataFrame, period: int = 30, limit: int = 5) -> DataFrame:
    """The busiest (day, endpoint) pairs of every project with that endpoint's peak instances."""
    best = Window.partitionBy("project").orderBy(F.col("requests").desc(), "day", "name")
    rows = _aged(days).where(F.col("_age") < period).withColumn("rank_no", F.row_number().over(best))
    return rows.where(F.col("rank_no") <= limit).select("project", "rank_no", "day", "name", "requests", F.col("peak").alias("max_instances"))


def daily_matrix(days: DataFrame, period: int = 30) -> DataFrame:
    """Requests for every endpoint of a project and day of its period, 0 when there were none."""
    rows = _aged(days).where(F.col("_age") < period)
    span = rows.groupBy("project").agg(F.max(F.date_add("day", F.col("_age"))).alias("_b")).join(
        days.groupBy(F.col("project").alias("_p")).agg(F.min("day").alias("_a")), F.col("project").eqNullSafe(F.col("_p")))
    grid = rows.select("project", "name").distinct().join(
        span.select(F.col("project").alias("_q"), F.sequence(F.greatest("_a", F.date_sub("_b", period - 1)), "_b").alias("_days")),
        F.col("project").eqNullSafe(F.col("_q")))
    grid = grid.select(F.col("project").alias("_r"), F.col("name").alias("_n"), F.explode("_days").alias("_day"))
    hit = F.col("_r").eqNullSafe(F.col("project")) & F.col("_n").eqNullSafe(F.col("name")) & (F.col("_day") == F.col("day"))
    return grid.join(rows.select("project", "name", "day", "requests"), hit, "left").select(
        F.col("_r").alias("project"), F.col("_day").alias("day"), F.col("_n").alias("name"), F.coalesce("requests", F.lit(0)).alias("requests"))
