"""Train, eval and test splits by time or by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.hashing import hash_bucket
from tillwork.functions.times import epoch_seconds
from tillwork.operators.sampling import row_text
from tillwork.session import fresh_path

# Share of rows kept for training below the holdout, and the buckets of the random split.
TRAIN_PERCENT = 80
RANDOM_BUCKETS = {"train": 16, "eval": 3, "test": 1}


def _cut(df: DataFrame, ts: str, last_days: int) -> Column:
    """Midnight that starts the last ``last_days`` calendar days of the data. The subquery is the same for
    every number of days, so it runs once."""
    latest = df.select(F.max(ts)).scalar()
    return F.date_sub(F.to_date(latest), last_days - 1).cast("timestamp_ntz")


def last_days(df: DataFrame, ts: str, test_days: int = 1) -> DataFrame:
    """Test = the last days of the data, train = all days before."""
    cut = _cut(df, ts, test_days)
    return df.withColumn("split", F.when(F.col(ts) >= cut, "test").otherwise("train"))


def time_holdout(df: DataFrame, ts: str, holdout_days: int = 1) -> DataFrame:
    """Test = the last days; the rest goes to train or eval by a hash of its timestamp."""
    cut = _cut(df, ts, holdout_days)
    in_train = hash_bucket(epoch_seconds(F.col(ts)), 100) < TRAIN_PERCENT
    return df.withColumn(
        "split", F.when(F.col(ts) >= cut, "test").when(in_train, "train").otherwise("eval"))


def strict_time(df: DataFrame, ts: str, train_days: int, val_days: int, test_days: int) -> DataFrame:
    """Three windows counted back from the last day; older rows are left out."""
    c = F.col(ts)
    test, val = _cut(df, ts, test_days), _cut(df, ts, test_days + val_days)
    start = _cut(df, ts, test_days + val_days + train_days)
    return df.where(c >= start).withColumn(
        "split", F.when(c >= test, "test").when(c >= val, "eval").otherwise("train"))


def random_hash(df: DataFrame, key: Sequence[str], buckets: dict[str, int] | None = None) -> DataFrame:
    """Splits in the ratio of their bucket counts, by a hash of the row's key."""
    buckets = buckets or RANDOM_BUCKETS
    bucket = hash_bucket(row_text(key), sum(buckets.values()))
    names = list(buckets)
    expr, upper = None, 0
    for name in names[:-1]:
        upper += buckets[name]
        expr = F.when(bucket < upper, name) if expr is None else expr.when(bucket < upper, name)
    return df.withColumn("split", F.lit(names[0]) if expr is None else expr.otherwise(names[-1]))


def split_output(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split without the split column."""
    return df.where(F.col("split") == split).drop("split")


def write_splits(df: DataFrame, path: str | None = None) -> str:
    """Write all splits in one pass; each is then read by partition pruning."""
    path = path or fresh_path(df.sparkSession, "splits")
    df.write.partitionBy("split").parquet(path)
    return path
