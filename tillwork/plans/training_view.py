"""The training views: point-in-time examples, last-day train and test sets, labelled pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.operators import filters, joins, negatives, rolling, splits
from tillwork.operators.sampling import share_of_entities
from tillwork.session import pin

CONTEXT = ["target_group", "ts", "store_id", "cust_value", "days_since_last_purchase", "cust_order_days",
           "cust_unique_products", "city", "segment"]


def training_examples(
    facts: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    segments: DataFrame,
    excluded_categories: Sequence[str] = (),
    days: int = 60,
) -> DataFrame:
    """One row per bought line with the customer's state on the morning of that day.

    ``facts`` has customer_id, target_group, ts, store_id, product_id, sales; ``segments`` is a history with
    customer_id, segment and updated_at. Features are computed once per customer and day and joined back on
    both, together with the segment, which spreads a customer with many lines over that customer's days.

    The facts and the customer days are written, so that the shuffles behind them are gone before the lines are joined; the lines
    meet the narrowest table first, as each join moves what the ones before have added.
    """
    lines = ["customer_id", "target_group", "ts", "store_id", "product_id", "sales"]
    facts = pin(facts.where(F.expr("try_cast(sales AS double)") > 0).select(*lines), "facts", "zstd")
    features = rolling.rolling_features(rolling.daily_totals(facts), days).select(
        "customer_id", "day", "cust_value", "days_since_last_purchase", "cust_order_days", "cust_unique_products")
    kept = products.where(~F.col("category").isin(list(excluded_categories))) if excluded_categories else products
    latest = joins.latest_per_key(segments, ["customer_id"], ["updated_at"]).select("customer_id", "segment")
    state = pin(features.join(latest, "customer_id", "left"), "customer-days", "zstd")
    return (
        facts.withColumn("day", F.to_date("ts"))
        .join(stores, "store_id", "left")
        .join(kept, "product_id")
        .join(state, ["customer_id", "day"])
        .select(*lines, "cust_value",
                "days_since_last_purchase", "cust_order_days", "cust_unique_products", "city",
                *[c for c in products.columns if c != "product_id"], "segment")
    )


def train_test_by_last_day(examples: DataFrame, percent: float = 80, test_days: int = 1,
                           history: int = 50) -> DataFrame:
    """Train and test rows with history and product statistics that know the training period only.

    The list of top products comes from all days.
    """
    labelled = splits.last_days(examples, "ts", test_days)
    top = filters.top_revenue_entities(examples, "product_id", "sales", percent)
    rows = labelled.join(top, "product_id", "left_semi")
    train = rows.where(F.col("split") == "train")
    hist = pin(rolling.purchase_history(rolling.pair_last_dates(train), history), "histories", "zstd")
    stats = pin(product_statistics(train), "product-statistics")
    # Histories come last: no later join moves their lists.
    return rows.join(stats, "product_id", "left").join(hist, "customer_id", "left")


def customer_contexts(examples: DataFrame) -> DataFrame:
    """The latest row of every customer day, reduced to the customer's context."""
    day = examples.select("customer_id", *CONTEXT).withColumn("day", F.to_date("ts"))
    return joins.latest_per_key(day, ["customer_id", "day"], ["ts"])


def latest_context(examples: DataFrame) -> DataFrame:
    """The latest context of every customer."""
    return joins.latest_per_key(examples.select("customer_id", *CONTEXT), ["customer_id"], ["ts"])


def product_statistics(rows: DataFrame) -> DataFrame:
    """Buyers, orders and sales per product, and the rank of its revenue in its category (0 to 1)."""
    place = rolling.category_percentile(rows, "product_id", "category", "sales").select("product_id", "revenue_pctile")
    return rolling.product_stats(rows).join(place, "product_id")


@dataclass(frozen=True)
class LabelledView:
    """What the labelled rows are made of: all rows before the held-out days, those of the best-selling products,
    the catalogue of these products (the latest row of each, over all days), histories and product statistics."""

    before: DataFrame
    train: DataFrame
    catalog: DataFrame
    history: DataFrame
    stats: DataFrame

    @staticmethod
    def of(examples: DataFrame, percent: float = 80, test_days: int = 1, history: int = 50) -> LabelledView:
        examples = pin(examples, "examples", "zstd")
        before = splits.last_days(examples, "ts", test_days).where(F.col("split") == "train").drop("split")
        top = pin(filters.top_revenue_entities(examples, "product_id", "sales", percent), "top-products")
        # Read by all that follows, and written by itself: what is shuffled for it is gone before the next step.
        train = pin(before.join(top, "product_id", "left_semi").select(*examples.columns), "train", "zstd")
        # One row per product before the join, which then moves no lines.
        sold = joins.latest_per_key(examples, ["product_id"], ["ts"]).join(top, "product_id", "left_semi")
        return LabelledView(
            before, train, pin(sold.select("product_id", *[c for c in ("name", "brand", "category") if c in sold.columns]), "catalog"),
            pin(rolling.purchase_history(rolling.pair_last_dates(train), history), "histories", "zstd"), pin(product_statistics(train), "product-statistics"))

    def positives(self) -> DataFrame:
        """Latest row per (customer, product), label 1; the pair's own product is taken out of the history."""
        latest = joins.latest_per_key(self.train, ["customer_id", "product_id"], ["ts"])
        return (
            latest.withColumn("label", F.lit(1))
            .join(self.stats, "product_id", "left").join(self.history, "customer_id", "left")
            .withColumn("purchase_history", rolling.without_target("purchase_history", "product_id"))
        )

    def negatives(self, ratio: int = 4, salt: str = "train", point_in_time: bool = True) -> DataFrame:
        """Sampled negatives, label 0, each with one of the customer's own day contexts in turn (or the latest)."""
        known = self.catalog.join(self.stats, "product_id", "left")
        sampled = negatives.sample_negatives(self.train, self.catalog, ratio, salt, attributes=known)
        if point_in_time:
            contexts = pin(customer_contexts(self.before).drop("day"), "contexts", "zstd")
            placed = joins.round_robin(sampled, contexts, "customer_id", "neg_rank", ["ts"])
        else:
            placed = sampled.join(pin(latest_context(self.before), "contexts", "zstd"), "customer_id")
        return placed.withColumn("sales", F.lit(0.0)).withColumn("label", F.lit(0)).join(self.history, "customer_id", "left")

    def pairs(self, ratio: int = 4, salt: str = "train") -> DataFrame:
        """Positives and negatives in one frame."""
        positives = self.positives()
        return positives.unionByName(self.negatives(ratio, salt).select(*positives.columns))


def training_slice(
    facts: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    cities: Sequence[str],
    start: str,
    end: str,
    top_n: int = 2000,
    more_than: int = 2,
    sample_percent: int = 100,
) -> DataFrame:
    """Date window, cities, best-selling products, active customers, and each customer's revenue."""
    rows = filters.date_fixed(facts, "ts", start, end).join(
        stores.where(F.col("city").isin(list(cities))), "store_id")
    top = filters.top_n_entities(rows, "product_id", "sales", top_n)
    active = filters.min_distinct_products(rows, "customer_id", "product_id", more_than, among=top)
    kept = active.join(top.select("product_id"), "product_id", "left_semi")
    if sample_percent < 100:
        kept = share_of_entities(kept, "customer_id", sample_percent)
    text = ("name", "brand", "category")
    return (
        rolling.group_total(kept, "customer_id", "sales", "customer_revenue")
        .join(products.select("product_id", *text), "product_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit("N/A")) for c in text})
    )


