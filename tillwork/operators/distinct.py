"""Exact distinct counts of many columns, without a copy of every row for every column.

Several distinct counts in one aggregation make the engine expand each row once per column. Here every column is a branch
of its own over the same input, which reads that column only; repeats are removed where they are read, before the shuffle.
Whole numbers that lie close together (ids) are set as bits: a task sends one bitmap for 32,768 neighbouring numbers instead
of the numbers. Long values are compared by their md5, so texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.session import pin

_DENSE = 64  # numbers lie close together if at least one in so many of their range occurs


def from_files_only(df: DataFrame) -> bool:
    """Whether every branch can read the rows again for the price of its own columns."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[\s:+\-]*(\w+)", plan, re.MULTILINE)
    return set(nodes) <= {"Project", "Filter", "Relation", "LocalRelation"}


def read_again(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """The columns as something that is cheap to read once per column: files as they are, anything else written once."""
    rows = df.select(*dict.fromkeys(columns))
    return rows if from_files_only(rows) else pin(rows, label)


def _is_dense(low: int | None, high: int | None, about: int) -> bool:
    return low is not None and high - low < _DENSE * about


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many values other than null each column has."""
    names = list(dict.fromkeys(columns))
    if not names:
        return {}
    rows = read_again(df, names, "distinct")
    whole = [n for n in names if isinstance(rows.schema[n].dataType, T.IntegralType)]
    about = rows.agg(F.count(F.lit(1)).alias("n"), *[
        a for i, n in enumerate(whole) for a in (F.approx_count_distinct(n).alias(f"k{i}"), F.min(n).alias(f"a{i}"), F.max(n).alias(f"z{i}"))]).first()
    dense = {n for i, n in enumerate(whole) if _is_dense(about[f"a{i}"], about[f"z{i}"], about[f"k{i}"])}
    parts = []
    for i, n in enumerate(names):
        c = F.col(n)
        if n in dense:
            bits = rows.where(c.isNotNull()).select(F.bitmap_bucket_number(c).alias("b"), F.bitmap_bit_position(c).alias("p"))
            found = bits.groupBy("b").agg(F.bitmap_count(F.bitmap_construct_agg("p")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        else:
            text = isinstance(rows.schema[n].dataType, (T.StringType, T.BinaryType))
            value = F.unhex(F.md5(c.cast("binary"))) if text else c
            found = rows.where(c.isNotNull()).select(value.alias("v")).distinct().agg(F.count(F.lit(1)).alias("n"))
        parts.append(found.select(F.lit(i).alias("i"), "n"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    got = {r["i"]: r["n"] for r in both.collect()}  # one row per column
    return {n: got[i] for i, n in enumerate(names)}
