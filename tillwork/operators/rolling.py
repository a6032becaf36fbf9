"""Point-in-time customer features on daily grain, purchase history, and ranks inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.numbers import exact_sum, ratio, rounded
from tillwork.functions.times import day_number
from tillwork.operators.joins import latest_per_key
from tillwork.plans.global_order import tie_running, with_running
from tillwork.session import pin


def daily_totals(df: DataFrame, customer: str = "customer_id", ts: str = "ts", amount: str = "sales",
                 product: str = "product_id") -> DataFrame:
    """Per customer and day: exact spend and distinct products."""
    return df.groupBy(customer, F.to_date(ts).alias("day")).agg(
        exact_sum(amount).alias("daily_total"), F.count_distinct(product).alias("daily_products"))


def rolling_features(daily: DataFrame, days: int = 60, customer: str = "customer_id") -> DataFrame:
    """Spend, order days and summed daily distinct products of the ``days`` days before each customer day,
    and the days since the previous one. Nothing before counts as 0.

    One window over daily rows (at most one per customer and calendar day) serves all four.
    """
    by_day = Window.partitionBy(customer).orderBy("_no")
    past = by_day.rangeBetween(-days, -1)
    return daily.withColumn("_no", day_number(F.col("day"))).select(
        customer, "day", "daily_total", "daily_products",
        F.coalesce(F.sum("daily_total").over(past), F.lit(0)).cast("double").alias("cust_value"),
        F.count(F.lit(1)).over(past).alias("cust_order_days"),
        F.coalesce(F.sum("daily_products").over(past), F.lit(0)).alias("cust_unique_products"),
        F.lag("day").over(by_day).alias("previous_day"),
        F.coalesce(F.col("_no") - F.lag("_no").over(by_day), F.lit(0)).alias("days_since_last_purchase"),
    )


def true_distinct_products(df: DataFrame, days: int = 60, customer: str = "customer_id",
                           product: str = "product_id", ts: str = "ts") -> DataFrame:
    """True distinct products of the ``days`` days before each customer day.

    A product bought on day d counts for the customer days in (d, d + days]; cutting that span at the next
    purchase of the same product makes spans disjoint, so the count is a sum of span starts and ends.
    """
    bought = df.select(customer, product, F.to_date(ts).alias("day")).distinct()
    own = Window.partitionBy(customer, product).orderBy("day")
    spans = bought.select(
        customer, F.date_add("day", 1).alias("from_day"),
        F.least(F.date_add("day", days), F.lead("day").over(own)).alias("to_day"),
    ).where(F.col("from_day") <= F.col("to_day"))
    steps = spans.select(customer, F.col("from_day").alias("day"), F.lit(1).alias("step")).unionByName(
        spans.select(customer, F.date_add("to_day", 1).alias("day"), F.lit(-1).alias("step")))
    changes = steps.groupBy(customer, "day").agg(F.sum("step").alias("step"))
    visits = bought.select(customer, "day").distinct().withColumn("visit", F.lit(True))
    by_day = Window.partitionBy(customer).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.join(visits, [customer, "day"], "full")
        .withColumn("distinct_products", F.sum(F.coalesce("step", F.lit(0))).over(by_day))
        .where(F.col("visit")).select(customer, "day", "distinct_products")
    )


def pair_last_dates(df: DataFrame, customer: str = "customer_id", product: str = "product_id",
                    ts: str = "ts") -> DataFrame:
    return df.groupBy(customer, product).agg(F.max(ts).alias("last_ts"))


def purchase_history(pairs: DataFrame, length: int = 50, customer: str = "customer_id",
                     product: str = "product_id") -> DataFrame:
    """Per customer the last bought products, newest first; equal dates are ordered by product.

    The rank filter is applied on both sides of the shuffle, so a customer brings at most ``length`` rows
    per input partition.
    """
    newest = Window.partitionBy(customer).orderBy(F.col("last_ts").desc(), F.col(product).asc())
    top = pairs.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= length)
    return top.groupBy(customer).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rank", product))), lambda s: s[product])
        .alias("purchase_history"))


def without_target(history: str, target: str):
    """Drop the row's own product from its history, so that the label cannot be read from it."""
    return F.array_remove(F.col(history), F.col(target))


def dedup_latest(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return latest_per_key(df, keys, [ts])


def product_stats(df: DataFrame, product: str = "product_id", customer: str = "customer_id",
                  amount: str = "sales") -> DataFrame:
    return df.groupBy(product).agg(
        F.count_distinct(customer).alias("unique_buyers"), F.count(F.lit(1)).alias("order_count"),
        exact_sum(amount).alias("_total"), F.count(amount).alias("_n"),
    ).select(
        product, "unique_buyers", "order_count", rounded(F.col("_total"), 2).alias("total_sales"),
        rounded(ratio(F.col("_total"), F.col("_n")), 2).alias("avg_sale"),
    )


def category_percentile(df: DataFrame, product: str, category: str, amount: str) -> DataFrame:
    """PERCENT_RANK of product revenue inside its category, safe for a category of any size."""
    totals = pin(df.groupBy(product, category).agg(exact_sum(amount).alias("total"), F.lit(1).alias("_one")),
                 "totals")
    run = tie_running(totals, "total", {"_upto": "_one"}, descending=False, group=[category],
                      totals={"_size": "_upto"})
    counted = totals.groupBy(category, "total").agg(F.sum("_one").alias("_ties"))
    ranks = run.join(counted, [category, "total"]).select(
        category, "total",
        F.coalesce(
            rounded(ratio(F.col("_upto") - F.col("_ties"), F.col("_size") - 1), 4), F.lit(0.0)
        ).alias("revenue_pctile"))
    return totals.drop("_one").join(ranks, [category, "total"])


def group_total(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """SUM(amount) OVER (PARTITION BY key) as aggregate and join back: a hot key is summed before the
    shuffle, and the join may split it."""
    sums = df.groupBy(key).agg(exact_sum(amount).cast("double").alias(name))
    return df.join(sums, key)


def running_best(df: DataFrame, order: Sequence[str], best: dict[str, str], group: Sequence[str] = (),
                 counter: str = "run_no") -> DataFrame:
    """Best value so far in completion order: ``best`` maps a metric to ``max`` or ``min``."""
    return with_running(
        df, [F.col(c).asc() for c in order], {f"best_{m}": (kind, m) for m, kind in best.items()},
        position=counter, group=group)
