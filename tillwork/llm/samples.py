"""Bounded samples by hash order that do not send a candidate from every partition to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, key: Column, n: int, *then: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (ties by ``then``), or all rows if there are no more.

    Rows are first cut to those below a threshold that about 4 n rows pass, so the final choice sees a bounded number
    of rows whatever the size of the table; the threshold is raised while too few pass.
    """
    hashed = rows.withColumn("_order", F.xxhash64(key, F.lit(11)))
    total = rows.count()
    share = min(1.0, (4 * n + 100) / max(1, total))
    while True:
        passed = hashed if share >= 1 else hashed.where(F.col("_order") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        if share >= 1 or passed.select("_order").count() >= min(n, total):
            return passed.orderBy("_order", *then).limit(n).drop("_order")
        share = min(1.0, share * 4)
