"""Column statistics, value lists, distributions, and the feature report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.numbers import exact_sum, percent, ratio, rounded
from tillwork.operators.distinct import distinct_counts, read_again
from tillwork.operators.heavy import top_counts
from tillwork.plans.global_order import percentiles, with_running
from tillwork.session import pin


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "other"


_LONG, _DOUBLE = "bigint", "double"
_STATS = {  # output column -> type, in order
    "null_count": _LONG, "null_pct": _DOUBLE, "distinct_count": _LONG, "uniqueness_pct": _DOUBLE,
    "max_length": _LONG, "min_length": _LONG, "avg_length": _DOUBLE, "min_value": _DOUBLE, "max_value": _DOUBLE,
    "mean": _DOUBLE, "stddev": _DOUBLE, "min_date": "date", "max_date": "date", "range_days": _LONG,
    "true_count": _LONG, "false_count": _LONG,
}


def _measures(name: str, kind: str, exact: bool, date_distinct: bool) -> dict[str, Column]:
    c = F.col(name)
    distinct = F.lit(0) if exact else F.approx_count_distinct(c)  # exact ones are counted apart
    out = {"null_count": F.count_if(c.isNull())}
    if kind == "string":
        out |= {"distinct_count": distinct, "max_length": F.max(F.length(c))}
    elif kind == "numeric":
        x = c.cast("double")
        out |= {"distinct_count": distinct, "min_value": F.min(x), "max_value": F.max(x),
                "mean": F.avg(x), "stddev": F.stddev_samp(x)}
    elif kind == "date":
        d = F.to_date(c)
        out |= {"min_date": F.min(d), "max_date": F.max(d)}
        if date_distinct:
            out["distinct_count"] = distinct
    elif kind == "bool":
        out |= {"true_count": F.count_if(c), "false_count": F.count_if(~c)}
    elif kind == "array":
        n = F.size(c)
        out |= {"avg_length": F.avg(F.when(c.isNotNull(), n)), "min_length": F.min(F.when(c.isNotNull(), n)),
                "max_length": F.max(F.when(c.isNotNull(), n))}
    return out


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
                 date_distinct: bool = False, array_lengths: bool = True) -> DataFrame:
    """One row per column, from one aggregation over the table and one branch per distinct count.

    ``exact=False`` replaces the distinct counts by sketches inside the aggregation.
    """
    names = list(columns or df.columns)
    kinds = {n: kind_of(df.schema[n].dataType) for n in names}
    counted = [n for n in names if kinds[n] in ("string", "numeric") or (kinds[n] == "date" and date_distinct)]
    if exact and counted:
        df = read_again(df, names, "profiled")
    distinct = distinct_counts(df, counted) if exact else {}
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], []
    for i, n in enumerate(names):
        kind = kinds[n] if array_lengths or kinds[n] != "array" else "other"
        measures = _measures(n, kind, exact, date_distinct)
        if n in distinct:
            measures.pop("distinct_count")
        aggs += [m.alias(f"{stat}_{i}") for stat, m in measures.items()]
        got = {stat: F.col(f"{stat}_{i}") for stat in measures}
        if n in distinct:
            got["distinct_count"] = F.lit(distinct[n])
        got["null_pct"] = percent(got["null_count"], F.col("_rows"))
        if kind == "string":
            got["uniqueness_pct"] = percent(got["distinct_count"], F.col("_rows"))
        if kind == "numeric":
            got["mean"], got["stddev"] = rounded(got["mean"], 2), rounded(got["stddev"], 2)
        if kind == "date":
            got["range_days"] = F.datediff(got["max_date"], got["min_date"])
        if kind == "array":
            got["avg_length"] = rounded(got["avg_length"], 1)
        parts.append(F.struct(
            F.lit(n).alias("column_name"), F.lit(kinds[n]).alias("kind"), F.col("_rows").alias("total_rows"),
            *[got.get(s, F.lit(None)).cast(t).alias(s) for s, t in _STATS.items()]))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def dataset_analysis(df: DataFrame, user: str, product: str) -> DataFrame:
    df = read_again(df, [user, product], "analysed")
    distinct = distinct_counts(df, [user, product])
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(distinct[user]).cast(_LONG).alias("unique_users"), F.lit(distinct[product]).cast(_LONG).alias("unique_products"),
    ).select(
        "*", rounded(ratio(F.col("total_rows"), F.col("unique_users")), 2).alias("rows_per_user"),
        rounded(ratio(F.col("total_rows"), F.col("unique_products")), 2).alias("rows_per_product"),
    )


def sample_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """``limit`` distinct non-null values in pseudo-random order."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct() \
        .orderBy(F.md5(F.col("value").cast("string").cast("binary")), "value").limit(limit)


def category_values(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Value counts with their share and rank: all of them, or the ``top`` most frequent ones that are asked for."""
    total = df.select(F.count(column)).scalar()
    if top is None:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        ranked = with_running(counts, (F.col("n").desc(), F.col("value").asc()), position="rank_no")
    elif isinstance(df.schema[column].dataType, T.StringType):
        ranked = top_counts(df, [column], top)
    else:  # ties are ordered by the value and not by its text; the limit bounds what the window sees
        order = (F.col("n").desc(), F.col("value").asc())
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.orderBy(*order).limit(top).withColumn("rank_no", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("value", "n", percent(F.col("n"), total).alias("pct"), F.col("rank_no").cast("long").alias("rank_no"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range and mean; a column whose values are all whole is reported as INTEGER."""
    df = read_again(df, columns, "profiled")
    aggs, parts, distinct = [], [], distinct_counts(df, columns)
    for i, n in enumerate(columns):
        x = F.col(n).cast("double")
        aggs += [F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"), F.avg(x).alias(f"mean_{i}"),
                 F.every(x == F.floor(x)).alias(f"whole_{i}")]
        parts.append(F.struct(
            F.lit(n).alias("column_name"),
            F.when(F.col(f"whole_{i}"), F.lit("INTEGER")).otherwise(F.lit("FLOAT")).alias("value_type"),
            F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value"),
            rounded(F.col(f"mean_{i}"), 2).alias("mean"), F.lit(distinct[n]).cast(_LONG).alias("distinct_count")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date range; a column whose values are all at midnight is reported as DATE."""
    df = read_again(df, columns, "profiled")
    aggs, parts, distinct = [], [], distinct_counts(df, columns)
    for i, n in enumerate(columns):
        c = F.col(n)
        aggs += [F.min(F.to_date(c)).alias(f"lo_{i}"), F.max(F.to_date(c)).alias(f"hi_{i}"),
                 F.every(c == F.date_trunc("day", c)).alias(f"mid_{i}")]
        parts.append(F.struct(
            F.lit(n).alias("column_name"),
            F.when(F.col(f"mid_{i}"), F.lit("DATE")).otherwise(F.lit("TIMESTAMP")).alias("value_type"),
            F.col(f"lo_{i}").alias("min_date"), F.col(f"hi_{i}").alias("max_date"),
            F.lit(distinct[n]).cast(_LONG).alias("distinct_count")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


# Distributions -------------------------------------------------------------------------------------------

# The reported percentiles.
REPORTED = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def transaction_distribution(df: DataFrame, customer: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of rows per customer, and the histogram rows -> customers (all levels)."""
    per_customer = pin(df.where(F.col(customer).isNotNull()).groupBy(customer)
                       .agg(F.count(F.lit(1)).alias("n")), "per_customer")
    shares = percentiles(per_customer, "n", REPORTED).first()  # five numbers
    basic = per_customer.agg(
        F.count(F.lit(1)).alias("customers"), F.sum("n").alias("transactions"),
        F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    stats = basic.select(
        "customers", "transactions", "min_n", "max_n",
        rounded(ratio(F.col("transactions"), F.col("customers")), 2).alias("mean_n"),
        *[F.floor(F.lit(shares[p]).cast("double")).cast("bigint").alias(p) for p in REPORTED])
    all_customers = per_customer.select(F.count(F.lit(1))).scalar()
    histogram = (
        per_customer.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("customer_pct", percent(F.col("customers"), all_customers))
        .orderBy("n"))
    return stats, histogram


def spend_distribution(df: DataFrame, customer: str, amount: str) -> DataFrame:
    """Statistics of positive spend per customer."""
    spend = pin(df.where(F.col(customer).isNotNull()).groupBy(customer).agg(exact_sum(amount).alias("spend"))
                .where(F.col("spend") > 0), "spend")
    shares = percentiles(spend, "spend", REPORTED).first()  # five numbers
    basic = spend.agg(
        F.count(F.lit(1)).alias("customers"), F.sum("spend").alias("total"),
        F.min("spend").alias("lo"), F.max("spend").alias("hi"))
    return basic.select(
        "customers", rounded(F.col("total"), 2).alias("total_spend"), rounded(F.col("lo"), 2).alias("min_spend"),
        rounded(F.col("hi"), 2).alias("max_spend"),
        rounded(ratio(F.col("total"), F.col("customers")), 2).alias("mean_spend"),
        *[rounded(F.lit(shares[p]), 2).alias(p) for p in REPORTED])


# Feature report ------------------------------------------------------------------------------------------

def _long_numeric(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [], list(numeric), "feature", "value")


def _long_text(df: DataFrame, strings: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in strings]).unpivot(
        [], list(strings), "feature", "value").where(F.col("value").isNotNull())


def numeric_statistics(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Count, missing, mean, deviation, zeros, minimum, exact median, maximum, and whether all are whole."""
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], []
    for i, n in enumerate(numeric):
        x = F.col(n).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_pop(x).alias(f"std_{i}"),
                 F.count_if(x == 0).alias(f"zero_{i}"), F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
        n_col = F.col(f"n_{i}")
        parts.append(F.struct(
            F.lit(n).alias("feature"), n_col.alias("n"), (F.col("_rows") - n_col).alias("missing"),
            percent(F.col("_rows") - n_col, F.col("_rows")).alias("missing_pct"),
            rounded(F.col(f"mean_{i}"), 4).alias("mean"), rounded(F.col(f"std_{i}"), 4).alias("std_dev"),
            F.col(f"zero_{i}").alias("zeros"), percent(F.col(f"zero_{i}"), n_col).alias("zeros_pct"),
            F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value")))
    basic = df.agg(*aggs).select(F.inline(F.array(*parts)))
    medians = percentiles(_long_numeric(df, numeric), "value", {"median": 0.5}, group=["feature"])
    return basic.join(medians, "feature", "left").withColumn("median", rounded(F.col("median"), 4))


def numeric_histogram(df: DataFrame, numeric: Sequence[str], buckets: int = 10) -> DataFrame:
    """Equal-width histogram of every numeric column in one shuffle."""
    bounds = _long_numeric(df, numeric).where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per column of the table.
    rows = _long_numeric(df, numeric).where(F.col("value").isNotNull()).join(F.broadcast(bounds), "feature")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(buckets))
    at = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(buckets - 1))).cast("int")
    return rows.groupBy("feature", "lo", "hi", at.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(
        "feature", "bucket", rounded(F.col("lo") + width * F.col("bucket"), 4).alias("low"),
        rounded(F.col("lo") + width * (F.col("bucket") + 1), 4).alias("high"), "n")


def string_statistics(df: DataFrame, strings: Sequence[str]) -> DataFrame:
    """Count, missing, unique values and mean length of text and binary columns."""
    df = read_again(df, strings, "profiled")
    aggs, parts, distinct = [F.count(F.lit(1)).alias("_rows")], [], distinct_counts(df, strings)
    for i, n in enumerate(strings):
        binary = isinstance(df.schema[n].dataType, T.BinaryType)
        length = F.octet_length(F.col(n)) if binary else F.length(F.col(n))
        aggs += [F.count(n).alias(f"n_{i}"), F.avg(length).alias(f"l_{i}")]
        parts.append(F.struct(
            F.lit(n).alias("feature"), F.col(f"n_{i}").alias("n"), (F.col("_rows") - F.col(f"n_{i}")).alias("missing"),
            percent(F.col("_rows") - F.col(f"n_{i}"), F.col("_rows")).alias("missing_pct"),
            F.lit(distinct[n]).cast(_LONG).alias("unique_values"), rounded(F.col(f"l_{i}"), 4).alias("avg_length")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def top_values(df: DataFrame, strings: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent values of every text column, from summaries and exact counts of what they name."""
    # At most one row per column of the table.
    sizes = df.agg(*[F.count(c).alias(c) for c in strings]).unpivot([], list(strings), "feature", "total")
    return top_counts(df, strings, top).join(F.broadcast(sizes), "feature").select(
        "feature", "rank_no", "value", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def average_missing(df: DataFrame) -> DataFrame:
    """Mean of the missing percentages of all columns."""
    shares = [percent(F.count_if(F.col(c).isNull()), F.count(F.lit(1)), 8) for c in df.columns]
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_features"),
                  rounded(total / F.lit(float(len(shares))), 2).alias("avg_missing_pct"))


def schema_report(df: DataFrame, domain_up_to: int) -> DataFrame:
    """Per column: type, required or optional, presence, and the value domain of text columns with at most
    ``domain_up_to`` values."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    types = {"numeric": "FLOAT", "date": "TIMESTAMP", "bool": "BOOL", "string": "STRING", "array": "ARRAY"}
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema):
        name = "INT" if isinstance(f.dataType, T.IntegralType) else types.get(kind_of(f.dataType), "OTHER")
        aggs.append(F.count(f.name).alias(f"n_{i}"))
        parts.append(F.struct(
            F.lit(f.name).alias("feature"), F.lit(name).alias("value_type"),
            F.when(F.col(f"n_{i}") == F.col("_rows"), "required").otherwise("optional").alias("need"),
            rounded(ratio(F.col(f"n_{i}"), F.col("_rows")), 4).alias("presence")))
    basic = df.agg(*aggs).select(F.inline(F.array(*parts)))
    if not strings:
        return basic.withColumn("domain", F.lit(None).cast("string"))
    values = _long_text(df, strings).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    # A rank just past the limit tells wide columns apart without collecting their values.
    by = Window.partitionBy("feature").orderBy("value")
    few = values.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= domain_up_to + 1)
    domains = few.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("_v")).select(
        "feature", F.when(F.size("_v") <= domain_up_to, F.array_join("_v", "|")).alias("domain"))
    return basic.join(domains, "feature", "left")
