"""The most frequent values of columns: mergeable summaries first, exact counts of what can still win.

One pass keeps a frequent-items summary per column and task (a bounded number of hashes with counts), and the summaries are
merged. They bound the count of every value that they do not name, so the named ones are counted exactly in a second
pass, and if the last winner is above the bound the list is proven. Only a column without such winners (mostly unique
values) has all its values counted, by hash: values themselves never leave their task but for those that win.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.operators.distinct import read_again
from tillwork.session import pin

TRACKED = 1 << 15
_NAMED = 1000
_ERROR = 3.5  # of a summary: its counts are off by at most 3.5 / TRACKED of all rows
_TIES = 4096


def _hash(c: Column) -> Column:
    return F.when(c.isNotNull(), F.xxhash64(c))


def _pair(c: Column) -> Column:
    """128 bits that stand for a value."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def summaries(rows: DataFrame, columns: Sequence[str], tracked: int = TRACKED) -> dict[str, tuple[int, list[tuple[int, int]], float]]:
    """Per column: rows with a value, (hash, estimate) of the named values, and a bound for all others."""
    named = min(_NAMED, tracked)
    hashed = rows.select(*columns, *[_hash(F.col(c)).alias(f"_h{i}") for i, c in enumerate(columns)])
    got = hashed.agg(*[a for i, c in enumerate(columns) for a in (
        F.count(c).alias(f"n{i}"), F.expr(f"approx_top_k(_h{i}, {named}, {tracked})").alias(f"s{i}"))])
    row = got.first()  # a thousand pairs a column
    out = {}
    for i, c in enumerate(columns):
        found = [(x["item"], x["count"]) for x in row[f"s{i}"] or [] if x["item"] is not None]
        bound = 2 * _ERROR * row[f"n{i}"] / tracked
        if len(row[f"s{i}"] or []) == named:
            bound = max(bound, min(n for _, n in found))
        out[c] = (row[f"n{i}"], found, bound)
    return out


def _ranked(counted: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= top)


def _union(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both


def top_counts(df: DataFrame, columns: Sequence[str], top: int, tracked: int = TRACKED) -> DataFrame:
    """``feature``, ``value`` (text), ``n`` and ``rank_no`` of the ``top`` most frequent values, ties by value."""
    columns = list(dict.fromkeys(columns))
    rows = read_again(df, columns, "heavy").select(*[F.col(c).cast("string").alias(c) for c in columns])
    spark, told = df.sparkSession, summaries(rows, columns, tracked)
    parts = []
    for c in columns:
        _, found, bound = told[c]
        # Estimates are never too low; what is more than twice the error below the last place cannot win.
        estimates = sorted((n for _, n in found), reverse=True)
        least = estimates[top - 1] - bound if len(estimates) >= top else 0
        hashes = [h for h, n in found if n >= least]
        if hashes:
            wanted = F.broadcast(spark.createDataFrame([(h,) for h in hashes], "_h long"))  # a thousand at most
            hit = rows.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).join(wanted, F.xxhash64("value") == F.col("_h"), "left_semi")
            parts.append(hit.groupBy(F.lit(c).alias("feature"), "value").agg(F.count(F.lit(1)).alias("n")))
    named = pin(_ranked(_union(parts), top), "named") if parts else None
    last = {r["feature"]: r["n"] for r in named.where(F.col("rank_no") == top).collect()} if named is not None else {}
    proven = [c for c in columns if last.get(c, 0) > told[c][2]]
    out = [named.where(F.col("feature").isin(proven))] if proven else []
    out += [_by_hash(rows.select(F.col(c).alias("value")).where(F.col("value").isNotNull()), c, top) for c in columns if c not in proven]
    return _union([o.select("feature", "value", "n", "rank_no") for o in out])


def _smallest(n: int):
    """The ``n`` smallest distinct values of a task."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array([], pa.string())
        for batch in batches:
            both = pc.unique(pa.concat_arrays([held, pc.unique(batch.column(0).cast(pa.string()))]))
            held = both.take(pc.sort_indices(both)[:n])
        yield pa.RecordBatch.from_arrays([held], ["value"])

    return keep


def _by_hash(values: DataFrame, name: str, top: int) -> DataFrame:
    """All values of a column counted by hash. The winners, and as many of the tied as are needed, get their values."""
    counts = pin(values.groupBy(_pair(F.col("value")).alias("h")).agg(F.count(F.lit(1)).alias("n")), "hashed")
    best = [r["n"] for r in counts.orderBy(F.col("n").desc()).limit(top).select("n").collect()]
    last = best[-1] if len(best) == top else 0
    need = top - sum(n > last for n in best)

    def valued(some: DataFrame) -> DataFrame:
        few = F.broadcast(some.select(F.col("h").alias("_h"), "n"))  # ``top`` or ``_TIES`` rows
        return values.join(few, _pair(F.col("value")) == F.col("_h")).select("value", "n").distinct()

    above = valued(counts.where(F.col("n") > last))
    tied = counts.where(F.col("n") == last)
    if last == 0:
        found = above
    elif tied.limit(_TIES + 1).count() <= _TIES:
        found = above.unionAll(valued(tied).orderBy("value").limit(need))
    else:
        size = max(_TIES, 4 * top)
        while True:
            smallest = values.mapInArrow(_smallest(size), "value string").distinct().orderBy("value").limit(size)
            smallest = pin(smallest.select("value", _pair(F.col("value")).alias("_h")), "smallest")
            hit = pin(tied.join(F.broadcast(smallest), F.col("h") == F.col("_h")).select("value", "n").orderBy("value").limit(need), "tied")
            if hit.count() >= need or smallest.count() < size:
                break
            size *= 8
        found = above.unionAll(hit)
    return _ranked(found.select(F.lit(name).alias("feature"), "value", "n"), top)
