"""Row filters and entity filters of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.numbers import exact_sum, ratio
from tillwork.operators.heavy import top_counts
from tillwork.plans.global_order import tie_running
from tillwork.session import pin


# Row filters ---------------------------------------------------------------------------------------------

def rolling_days(df: DataFrame, ts: str, days: int, anchor: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days, counted back from the latest timestamp of the whole table."""
    latest = (anchor if anchor is not None else df).select(F.max(ts)).scalar()
    return df.where(F.col(ts) >= latest - F.expr(f"INTERVAL {int(days)} DAYS"))


def start_date(df: DataFrame, ts: str, start: str) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))


def category_condition(column: str, values: Sequence, exclude: bool = False) -> Column:
    """Membership test; excluding also drops NULL, as SQL's NOT IN does."""
    inside = F.col(column).isin(list(values))
    return ~inside if exclude else inside


def category(df: DataFrame, column: str, values: Sequence, exclude: bool = False) -> DataFrame:
    return df.where(category_condition(column, values, exclude))


def numeric_condition(column: str, op: str, value: float | None = None, low: float | None = None,
                      high: float | None = None, include_nulls: bool = False) -> Column:
    c = F.col(column)
    if op == "range":
        cond = F.lit(True)
        if low is not None:
            cond = cond & (c >= low)
        if high is not None:
            cond = cond & (c <= high)
    else:
        cond = {"gt": c > value, "lt": c < value, "eq": c == value, "ne": c != value}[op]
    if include_nulls:
        return c.isNull() | cond
    return c.isNotNull() & cond


def numeric(df: DataFrame, column: str, op: str, **bounds) -> DataFrame:
    return df.where(numeric_condition(column, op, **bounds))


# The relative windows on offer, in days.
RELATIVE_DAYS = (7, 14, 30, 60, 90, 180, 365)


def date_relative(df: DataFrame, column: str, days: int, include_nulls: bool = False) -> DataFrame:
    """Last ``days`` days relative to the latest value of that column, never to today."""
    if days not in RELATIVE_DAYS:
        raise ValueError(f"days must be one of {RELATIVE_DAYS}")
    latest = df.select(F.max(column)).scalar()
    cond = F.col(column) >= latest - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(column).isNull() | cond if include_nulls else cond)


def date_fixed(df: DataFrame, column: str, start: str | None = None, end: str | None = None,
               include_nulls: bool = False) -> DataFrame:
    """Both ends inclusive; the end compares with midnight of the end day."""
    c = F.col(column)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (c <= F.lit(end).cast("timestamp_ntz"))
    cond = c.isNotNull() & cond
    return df.where(c.isNull() | cond if include_nulls else cond)


# Entity filters ------------------------------------------------------------------------------------------

def top_revenue_entities(df: DataFrame, entity: str, amount: str, percent: float) -> DataFrame:
    """Entities that make up the top ``percent`` of revenue, the one crossing the line included.

    Equal totals are added to the running sum together. Per-entity totals are written once, because the
    running sum and the look-up by total must see identical values.
    """
    totals = pin(
        df.where(F.col(entity).isNotNull() & F.col(amount).isNotNull())
        .groupBy(entity).agg(exact_sum(amount).alias("total")),
        "totals",
    )
    run = tie_running(totals, "total", {"running": "total"})
    grand = totals.select(F.sum("total")).scalar().cast("double")
    line = grand * F.lit(percent / 100.0)
    kept = run.where(
        (F.col("running").cast("double") <= line)
        | ((F.col("running") - F.col("total")).cast("double") < line)
    ).select("total")
    return totals.join(kept, "total", "left_semi").select(entity)


def top_revenue(df: DataFrame, entity: str, amount: str, percent: float,
                base: DataFrame | None = None) -> DataFrame:
    keep = top_revenue_entities(base if base is not None else df, entity, amount, percent)
    return df.join(keep, entity, "left_semi")


def _compare(c: Column, op: str, value: float | None, low: float | None, high: float | None) -> Column:
    if op == "between":
        cond = F.lit(True)
        if low is not None:
            cond = cond & (c >= low)
        if high is not None:
            cond = cond & (c <= high)
        return cond
    return {"gt": c > value, "lt": c < value, "eq": c == value}[op]


def entity_metric(df: DataFrame, entity: str, metric: str, op: str, value: float | None = None,
                  low: float | None = None, high: float | None = None, amount: str | None = None,
                  base: DataFrame | None = None) -> DataFrame:
    """Keep entities by their row count (``count``), amount sum (``sum``) or amount mean (``avg``)."""
    source = (base if base is not None else df).where(F.col(entity).isNotNull())
    if metric == "count":
        agg = F.count(F.lit(1))
    elif metric == "sum":
        agg = exact_sum(amount).cast("double")
    elif metric == "avg":
        agg = ratio(exact_sum(amount), F.count(amount))
    else:
        raise ValueError(metric)
    kept = (source.groupBy(entity).agg(agg.alias("_m"))
            .where(_compare(F.col("_m"), op, value, low, high)).select(entity))
    return df.join(kept, entity, "left_semi")


def min_transactions(df: DataFrame, customer: str, least: int, base: DataFrame | None = None) -> DataFrame:
    return entity_metric(df, customer, "count", "between", low=least, base=base)


def top_n_entities(df: DataFrame, entity: str, amount: str, n: int) -> DataFrame:
    """The ``n`` entities with the largest revenue; equal revenue is ordered by id."""
    return (
        df.where(F.col(entity).isNotNull()).groupBy(entity).agg(exact_sum(amount).alias("total"))
        .orderBy(F.col("total").desc(), F.col(entity).asc()).limit(n)
    )


def min_distinct_products(df: DataFrame, customer: str, product: str, more_than: int,
                          among: DataFrame | None = None) -> DataFrame:
    """Customers with more than a number of distinct products, counted among ``among`` if given."""
    source = df if among is None else df.join(among.select(product), product, "left_semi")
    pairs = source.select(customer, product).distinct()
    kept = pairs.groupBy(customer).agg(F.count(product).alias("_n")).where(F.col("_n") > more_than)
    return df.join(kept.select(customer), customer, "left_semi")


def search_values(df: DataFrame, column: str, term: str, limit: int = 20) -> DataFrame:
    """Distinct values containing a term in any case, most frequent first."""
    hits = df.where(F.lower(F.col(column).cast("string")).contains(term.lower()))
    if isinstance(df.schema[column].dataType, T.StringType):
        return top_counts(hits, [column], limit).orderBy("rank_no").select("value", "n")
    return hits.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("value").asc()).limit(limit)
