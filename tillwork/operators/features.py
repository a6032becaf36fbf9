"""Turning columns into model inputs: vocabularies, scaling, buckets, cycles, crosses and history.

Fitted vocabularies are DataFrames; other fitted values are a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.hashing import hash_bucket
from tillwork.plans.global_order import percentiles, quantile_points, with_running
from tillwork.session import pin

# Least count of ids, bucket counts and history length used by default.
ID_MIN_COUNT = 5
HASH_CROSS_BUCKETS = 5000
QUANTILE_BUCKETS = 100
HISTORY_LENGTH = 50
STD_EPSILON = 1e-8


# Vocabularies --------------------------------------------------------------------------------------------

def token_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fit_vocabulary(df: DataFrame, column: str, min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """Tokens by frequency, then by text, numbered from 0; NULL is the empty token."""
    counts = df.groupBy(token_of(column).alias("token")).agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= min_count)
    listed = with_running(counts, [F.col("n").desc(), F.col("token").asc()], position="_place")
    listed = listed.select("token", "n", (F.col("_place") - 1).alias("idx"))
    return listed.where(F.col("idx") < max_size) if max_size is not None else listed


def apply_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, output: str) -> DataFrame:
    """Index of the token; unknown tokens share one index, the vocabulary size.

    The size of the vocabulary decides at run time between broadcast and a shuffled join, in which AQE may
    split a frequent token.
    """
    size = vocabulary.select(F.count(F.lit(1))).scalar()
    side = vocabulary.select(F.col("token").alias("_token"), F.col("idx").alias("_idx"))
    out = df.join(side, token_of(column) == F.col("_token"), "left")
    return out.withColumn(output, F.coalesce(F.col("_idx"), size)).drop("_token", "_idx")


def fit_sorted_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 1; 0 is left for unknown and padding."""
    distinct = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return with_running(distinct, [F.col("value").asc()], position="idx")


def apply_sorted_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, output: str) -> DataFrame:
    side = vocabulary.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
    out = df.join(side, F.col(column) == F.col("_value"), "left")
    return out.withColumn(output, F.coalesce(F.col("_idx"), F.lit(0))).drop("_value", "_idx")


# Scaling -------------------------------------------------------------------------------------------------

def fit_moments(df: DataFrame, columns: Sequence[str], null_as_zero: bool = True,
                sample: bool = False) -> dict[str, tuple[float, float]]:
    """Mean and deviation of all columns in one pass. ``sample`` uses the sample deviation plus a small
    constant and leaves NULL out."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        x = F.coalesce(x, F.lit(0.0)) if null_as_zero else x
        aggs += [F.avg(x).alias(f"m_{i}"), (F.stddev_samp(x) if sample else F.stddev_pop(x)).alias(f"s_{i}")]
    row = df.agg(*aggs).first()
    extra = STD_EPSILON if sample else 0.0
    return {c: (row[f"m_{i}"] or 0.0, (row[f"s_{i}"] or 0.0) + extra) for i, c in enumerate(columns)}


def zscore(column: str, moments: tuple[float, float], null_as_zero: bool = True) -> Column:
    """Standard score; a constant column scores 0. NULL counts as 0 before, or becomes 0 after scaling."""
    mean, std = moments
    x = F.col(column).cast("double")
    if std == 0.0:
        return F.lit(0.0)
    if null_as_zero:
        return (F.coalesce(x, F.lit(0.0)) - F.lit(mean)) / F.lit(std)
    scaled = (x - F.lit(mean)) / F.lit(std)
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(scaled)


def fit_range(df: DataFrame, column: str) -> tuple[float, float]:
    row = df.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi")).first()
    return row["lo"], row["hi"]


def minmax(x: Column, bounds: tuple[float, float]) -> Column:
    lo, hi = bounds
    return F.lit(0.5) if hi == lo else (x - F.lit(lo)) / F.lit(hi - lo)


# Buckets -------------------------------------------------------------------------------------------------

def fit_quantiles(df: DataFrame, columns: Sequence[str], buckets: int = QUANTILE_BUCKETS) -> dict[str, list[float]]:
    """Inner quantile boundaries of all columns at once. The columns are written once, since they are read
    twice and ``df`` is often a join."""
    values = pin(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "values")
    long = values.unpivot([], list(columns), "feature", "value")
    out: dict[str, list[float]] = {c: [] for c in columns}
    # Boundaries only: columns x (buckets - 1) numbers.
    for row in quantile_points(long, "value", buckets, group=["feature"]).orderBy("feature", "k").collect():
        out[row["feature"]].append(row["boundary"])
    return out


def bucket_of(x: Column, boundaries: Sequence[float]) -> Column:
    """Number of boundaries at or below ``x``, found by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(boundaries[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    found = search(0, len(boundaries))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(found)


def linear_bucket(x: Column, bounds: tuple[float, float], points: int) -> Column:
    """Index among ``points`` evenly spaced boundaries from minimum to maximum, the maximum in the last."""
    lo, hi = bounds
    if hi == lo:
        return F.when(x < F.lit(lo), 0).otherwise(points)
    step = (hi - lo) / (points - 1)
    at = F.floor((x - F.lit(lo)) / F.lit(step)) + 1
    return F.greatest(F.lit(0), F.least(F.lit(points), at)).cast("int")


# Target --------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TargetTransform:
    """Clip, then log, then normalize; the fitted numbers are kept, so that predictions can be inverted."""

    lower: float | None = None
    upper: float | None = None
    log: bool = False
    norm: str | None = None  # None, "minmax" or "zscore"
    a: float = 0.0
    b: float = 1.0

    def _shaped(self, x: Column) -> Column:
        x = x.cast("double")
        if self.lower is not None:
            x = F.greatest(x, F.lit(self.lower))
        if self.upper is not None:
            x = F.least(x, F.lit(self.upper))
        return F.log1p(F.greatest(x, F.lit(0.0))) if self.log else x

    def transform(self, x: Column) -> Column:
        x = self._shaped(x)
        return x if self.norm is None else (x - F.lit(self.a)) / F.lit(self.b)

    def inverse(self, y: Column) -> Column:
        if self.norm is not None:
            y = y * F.lit(self.b) + F.lit(self.a)
        return F.expm1(y) if self.log else y


def fit_target(df: DataFrame, column: str, clip_low: float | None = None, clip_high: float | None = None,
               log: bool = False, norm: str | None = None) -> TargetTransform:
    """Fit clipping percentiles (in percent) and the normalization of what they leave."""
    shares = {}
    if clip_low is not None:
        shares["low"] = clip_low / 100.0
    if clip_high is not None:
        shares["high"] = clip_high / 100.0
    row = percentiles(pin(df.select(column), "target"), column, shares).first() if shares else None
    t = TargetTransform(row["low"] if clip_low is not None else None,
                        row["high"] if clip_high is not None else None, log)
    if norm is None:
        return t
    y = t.transform(F.col(column))
    stats = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    if norm == "minmax":
        a, b = stats["lo"], stats["hi"] - stats["lo"]
    else:
        a, b = stats["m"], stats["s"]
    return TargetTransform(t.lower, t.upper, log, norm, a, b or 1.0)


# Crosses -------------------------------------------------------------------------------------------------

def hash_cross(parts: Sequence[Column], buckets: int = HASH_CROSS_BUCKETS) -> Column:
    """Hash of the joined parts; a NULL part counts as empty, so positions stay apart."""
    text = F.concat_ws("_x_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return hash_bucket(text, buckets)


def bin_cross(a_bucket: Column, b_bucket: Column, of_buckets: int, buckets: int, bins: int = 10) -> Column:
    """Two bucket numbers reduced to ten bins each and combined."""

    def reduced(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(c * bins / (of_buckets + 1)))).cast("bigint")

    return F.pmod(reduced(a_bucket) * 31 + reduced(b_bucket), F.lit(buckets))


# History -------------------------------------------------------------------------------------------------

def pad_right(ids: Column, length: int, pad: int | Column = 0) -> Column:
    """First ``length`` entries, filled up on the right."""
    fill = pad if isinstance(pad, Column) else F.lit(pad).cast("bigint")
    return F.slice(F.concat(F.coalesce(ids, F.array().cast("array<bigint>")), F.array_repeat(fill, length)), 1, length)


def encode_history(df: DataFrame, key: str, history: str, vocabulary: DataFrame, length: int = HISTORY_LENGTH,
                   output: str = "history_ids") -> DataFrame:
    """Vocabulary index (0 = unknown) of every history entry, cut and padded to ``length``.

    Works for vocabularies of any size: entries are joined, not looked up in a map. ``key`` is unique.
    """
    entries = df.select(key, F.posexplode(F.slice(history, 1, length)).alias("_pos", "_item"))
    side = vocabulary.select(F.col("value").alias("_item"), F.col("idx").alias("_idx"))
    ids = (
        entries.join(side, "_item", "left").groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_idx", F.lit(0)).alias("_idx")))).alias("_h"))
        .select(key, F.transform("_h", lambda s: s["_idx"].cast("bigint")).alias("_h"))
    )
    return df.join(ids, key, "left").withColumn(output, pad_right(F.col("_h"), length)).drop("_h")


def history_mean(df: DataFrame, key: str, history: str, vectors: DataFrame, vector_id: str, vector: str,
                 dims: int, output: str = "mean_vector") -> DataFrame:
    """Average vector of the history entries that have one.

    Entries meet their vectors where the items lie, so a task sees few of a key: vectors are shuffled as they are, not as sums and
    counts per dimension, which take several times their room. Histories are short, so no key is heavy.
    """
    entries = df.select(key, F.explode(history).alias("_item"))
    side = vectors.select(F.col(vector_id).alias("_item"), F.col(vector).alias("_v"))
    found = entries.join(side, "_item").select(key, "_v").repartition(key)
    means = [F.avg(F.col("_v")[i].cast("double")).alias(f"_d{i}") for i in range(dims)]
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), *means).select(
        key, "n_items", F.array(*[F.col(f"_d{i}") for i in range(dims)]).alias(output))


# Log columns ---------------------------------------------------------------------------------------------

def resource_service(name: Column) -> Column:
    """Service or job name inside a resource path; NULL when there is none."""
    # Fixed value: the pattern of the resource path.
    return F.nullif(F.regexp_extract(name, r"(?:services|jobs)/([^/]+)", 1), F.lit(""))


def net_cost(cost: Column, credits: Column) -> Column:
    """Exact cost plus its credits (an array of structs with ``amount``)."""
    zero = F.lit(0).cast("decimal(28,6)")
    total = F.aggregate(credits, zero, lambda acc, c: (acc + F.coalesce(c["amount"], zero)).cast("decimal(28,6)"))
    return cost.cast("decimal(28,6)") + F.coalesce(total, zero)


