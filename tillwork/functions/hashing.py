"""Hash buckets that other engines can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(c: Column) -> Column:
    """First eight hex digits of the md5 of the text form, as a long in [0, 2^32)."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(hash_number(c), F.lit(buckets))
