"""Previews and samples that come out the same on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.hashing import hash_bucket, hash_number


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; timestamps and dates in ISO form."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.cast("string").alias(f.name))
    return df.select(cols)


def preview(df: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    return as_text(df.orderBy(*order).limit(limit))


def row_text(columns: Sequence[str]) -> Column:
    """Text of the chosen columns, NULL as empty, for hashing a row."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def random_order(columns: Sequence[str], seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_text(columns)).cast("binary"))


def random_rows(df: DataFrame, key: Sequence[str], n: int, seed: str = "0") -> DataFrame:
    """``n`` rows in pseudo-random order: each task keeps its best ``n``, there is no full sort."""
    return df.orderBy(random_order(key, seed), *key).limit(n)


def join_key_sample(primary_sample: DataFrame, secondary: DataFrame, primary_key: str, secondary_key: str,
                    order_key: Sequence[str], n: int, seed: str = "0") -> DataFrame:
    """A sample of the secondary table restricted to keys of the primary sample, so that the two join."""
    keys = (primary_sample.select(F.col(primary_key).alias(secondary_key))
            .where(F.col(secondary_key).isNotNull()).distinct())
    return random_rows(secondary.join(keys, secondary_key, "left_semi"), order_key, n, seed)


def share_of_rows(df: DataFrame, key: Sequence[str], share: float, seed: str = "0") -> DataFrame:
    """Keep about ``share`` of the rows by a hash of their key."""
    text = F.concat(F.lit(f"{seed}:"), row_text(key))
    return df.where(hash_number(text) < int(share * (1 << 32)))


def share_of_entities(df: DataFrame, entity: str, percent: int) -> DataFrame:
    """Keep all rows of about ``percent`` % of the entities."""
    return df.where(hash_bucket(F.col(entity), 100) < percent)
