"""Joins of facts with dimensions, and evidence about join keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.numbers import percent, ratio, rounded


def join_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str,
                how: str = "left") -> tuple[DataFrame, DataFrame]:
    """The joined rows with prefixed right columns, and a one-row report about the join."""
    side = right.select(*[F.col(c).alias(f"{prefix}_{c}") for c in right.columns], F.lit(1).alias("_hit"))
    joined = left.join(side, F.col(left_key) == F.col(f"{prefix}_{right_key}"), how)
    before = left.select(F.count(F.lit(1))).scalar()
    report = joined.agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(F.col("_hit").isNull()).alias("unmatched_rows"),
        F.count_if(F.col(left_key).isNull()).alias("null_keys"),
    ).select(
        before.alias("rows_before"), "rows_after", "unmatched_rows", "null_keys",
        percent(F.col("unmatched_rows"), F.col("rows_after")).alias("unmatched_pct"),
        (F.col("rows_after") > before).alias("rows_multiplied"),
    )
    return joined.drop("_hit"), report


def key_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values and duplication of a key, over its non-null values.

    Counting per key first lets a hot key collapse before the shuffle.
    """
    per_key = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"),
    ).select(
        F.lit(column).alias("column_name"), "total_rows", "distinct_keys",
        (F.col("total_rows") == F.col("distinct_keys")).alias("is_unique"),
        rounded(ratio(F.col("total_rows"), F.col("distinct_keys")), 2).alias("duplication_factor"),
    )


# What makes a column name look like a key, and well-known key names.
KEY_NAME_PATTERNS = (r"_id$", r"^id$", r"_key$", r"_code$")
COMMON_KEYS = {
    "customer_id", "user_id", "product_id", "item_id", "order_id",
    "transaction_id", "sku", "sku_id", "category_id", "brand_id",
}
SCORE_SAME_NAME, SCORE_SAME_TYPE, SCORE_BOTH_KEYS, SCORE_COMMON, SCORE_FOREIGN_ID = 10, 2, 3, 4, 8
HIGH_SCORE, MEDIUM_SCORE = 12, 6


def _looks_like_key(name: str) -> bool:
    return any(re.search(p, name.lower()) for p in KEY_NAME_PATTERNS)


def _name_score(a: str, a_type: str, b: str, b_type: str, table: str) -> int:
    a_low, b_low = a.lower(), b.lower()
    rules = (
        (a_low == b_low, SCORE_SAME_NAME),
        (a_type == b_type, SCORE_SAME_TYPE),
        (_looks_like_key(a) and _looks_like_key(b), SCORE_BOTH_KEYS),
        (a_low in COMMON_KEYS, SCORE_COMMON),
        (b_low == "id" and a_low == table.rstrip("s") + "_id", SCORE_FOREIGN_ID),
    )
    return sum(points for holds, points in rules if holds)


def detect_join_keys(primary: DataFrame, secondaries: Mapping[str, DataFrame]) -> DataFrame:
    """Best column pair per secondary table by name and type, with evidence from the full data.

    The evidence is the share of distinct primary keys found on the other side, and whether that side is
    unique on the key.
    """
    found = None
    for table, side in secondaries.items():
        scored = [
            (_name_score(a, at, b, bt, table), -i, -j, a, b)
            for i, (a, at) in enumerate(primary.dtypes) for j, (b, bt) in enumerate(side.dtypes)
        ]
        score, _, _, a, b = max(scored)
        confidence = "high" if score >= HIGH_SCORE else "medium" if score >= MEDIUM_SCORE else "low"
        keys = primary.select(F.col(a).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        other = (side.select(F.col(b).alias("_o")).where(F.col("_o").isNotNull())
                 .groupBy("_o").agg(F.count(F.lit(1)).alias("_n")))
        one = keys.join(other, F.col("_k") == F.col("_o"), "left").agg(
            F.count(F.lit(1)).alias("primary_keys"), F.count("_o").alias("matched_keys"),
        ).select(
            F.lit(table).alias("table_name"), F.lit(a).alias("primary_column"), F.lit(b).alias("secondary_column"),
            F.lit(score).alias("score"), F.lit(confidence).alias("confidence"), "primary_keys", "matched_keys",
            percent(F.col("matched_keys"), F.col("primary_keys")).alias("containment_pct"),
            other.select(F.max("_n") == 1).scalar().alias("secondary_unique"),
        )
        found = one if found is None else found.unionByName(one)
    return found


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest whole row per key as an aggregate, so a hot key is reduced before the shuffle.

    Ties on ``order`` fall to the larger remaining columns, which makes the result deterministic.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    out = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def join_latest(facts: DataFrame, history: DataFrame, key: str, order: Sequence[str],
                how: str = "left") -> DataFrame:
    return facts.join(latest_per_key(history, [key], order), key, how)


def candidate_counts(pairs: DataFrame, catalog: DataFrame, customer: str, product: str) -> DataFrame:
    """How many catalogue products each customer has not bought, without forming customers x products."""
    size = catalog.select(F.count_distinct(product)).scalar()
    bought = pairs.select(customer, product).distinct().join(
        catalog.select(product).distinct(), product, "left_semi")
    return bought.groupBy(customer).agg(F.count(F.lit(1)).alias("n_bought")).select(
        customer, "n_bought", (size - F.col("n_bought")).alias("n_candidates"))


def round_robin(items: DataFrame, contexts: DataFrame, key: str, item_rank: str, context_order: Sequence[str]) -> DataFrame:
    """Give item number k of a key that key's context number 1 + (k - 1) mod n.

    Contexts must be few per key (customer days): they become one sorted list per key, equal ones of ``context_order`` by their other
    columns. Items may be many; they are shuffled by the key alone, so that further joins on it move nothing again.
    """
    rest = [c for c in contexts.columns if c != key]
    order = [c for c in context_order if c != key]
    lists = contexts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("_contexts"))
    place = (F.pmod(F.col(item_rank) - 1, F.size("_contexts")) + 1).cast("int")
    placed = items.where(F.col(item_rank).isNotNull()).join(lists, key).withColumn("_context", F.element_at("_contexts", place))
    return placed.select(key, *[c for c in items.columns if c != key], *[F.col(f"_context.{c}").alias(c) for c in rest])
