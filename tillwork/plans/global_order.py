"""Ranks, running values and exact percentiles, over everything or per group, whatever the group size.

A window over a whole table runs in one task, and a window per key runs in one task per key. Here the rows
are range-partitioned and sorted on (group, order key) instead, and written once with the partition number
and the position inside the partition. Only one small row per partition and group (count and running values)
goes through the outer window; its result is added back as an offset. No task holds more than one range
partition, even when one group owns a third of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.session import pin

_POSITION_BITS = 33  # monotonically_increasing_id(): partition number above, row position below
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), inside).otherwise(F.coalesce(before + inside, before))
    return (F.greatest if kind == "max" else F.least)(before, inside)


def with_running(
    df: DataFrame,
    order: Sequence[Column],
    running: Mapping[str, tuple[str, str]] | None = None,
    position: str = "position",
    group: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    group_size: str | None = None,
) -> DataFrame:
    """Add the 1-based position in the order, and running values up to and including each row.

    ``order`` must be a total order inside a group (add a unique key last), so that no range partition is
    heavier than its share. ``running`` maps a new column to ``(sum|max|min, column)``; ``totals`` maps a new
    column to the name of a running one whose value over the whole group is wanted.
    """
    running, totals, group = dict(running or {}), dict(totals or {}), list(group)
    by = [F.col(g).asc() for g in group] + list(order)
    pinned = pin(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + 1)
        .drop("_row"),
        "ordered",
    )
    per_part = pinned.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), *[_AGG[kind](c).alias(f"_s_{name}") for name, (kind, c) in running.items()]
    )
    # One row per partition and group: few, because a sorted group spans neighbouring partitions only.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select(
        F.col("_part").alias("_part2"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("_size"),
        *[_AGG[kind](f"_s_{name}").over(before).alias(f"_o_{name}") for name, (kind, _) in running.items()],
        *[_AGG[running[of][0]](f"_s_{of}").over(whole).alias(f"_t_{name}") for name, of in totals.items()],
    )
    match = F.col("_part") == F.col("_part2")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Without groups the offsets hold one row per partition, so broadcasting them is always cheap.
    out = pinned.join(offsets if group else F.broadcast(offsets), match)
    inside = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = F.count(F.lit(1)).over(inside) if group else F.col("_pos")
    cols = [F.col(c) for c in df.columns] + [(F.col("_n0") + local).alias(position)]
    for name, (kind, c) in running.items():
        cols.append(_combine(kind, F.col(f"_o_{name}"), _AGG[kind](c).over(inside)).alias(name))
    cols += [F.col(f"_t_{name}").alias(name) for name in totals]
    if group_size:
        cols.append(F.col("_size").alias(group_size))
    return out.select(*cols)


def tie_running(df: DataFrame, value: str, sums: Mapping[str, str], descending: bool = True,
                group: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """Running sums in which rows of equal ``value`` count together (a RANGE frame), one row per value."""
    per_value = df.groupBy(*group, value).agg(*[F.sum(c).alias(f"_v_{name}") for name, c in sums.items()])
    key = F.col(value).desc() if descending else F.col(value).asc()
    out = with_running(per_value, [key], {name: ("sum", f"_v_{name}") for name in sums}, group=group,
                       totals=totals)
    return out.drop("position", *[f"_v_{name}" for name in sums])


# Exact percentiles -----------------------------------------------------------------------------------------

_STEPS_PER_OCTAVE = 64
_BROADCAST_BINS = 200_000  # rows of a few numbers each: some ten megabytes


def _bin(value: str) -> Column:
    """A coarse bin that keeps the order of numbers: sign, then the logarithm in steps of about one percent."""
    x = F.col(value).cast("double")
    infinite = F.abs(x) == F.lit(float("inf"))
    step = F.when(infinite, F.lit(1 << 30)).otherwise(F.floor(F.log2(F.when(~infinite, F.abs(x))) * _STEPS_PER_OCTAVE).cast("int"))
    sign = F.signum(x).cast("int")
    return F.struct(sign.alias("sign"), F.when(sign == 0, F.lit(0)).otherwise(step * sign).alias("step"))


def bin_counts(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Rows per group and bin: ``_bin``, ``_n``. Counts of parts of a table add up, so they can be stored and merged."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, _bin(value).alias("_bin"))
    return rows.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))


def _around(df: DataFrame, value: str, group: Sequence[str], touched, counts: DataFrame | None = None) -> DataFrame:
    """Counted values around the wanted ranks, with ``_upto`` (rows up to and including the value) and ``_all``.

    The first pass only counts rows per bin, which is little after the map-side sums. ``touched(first, last,
    all)`` says whether the zero-based rows of a bin hold a wanted rank; the second pass sorts the values of
    those bins and nothing else. The wanted bins are written and counted; up to ``_BROADCAST_BINS`` of them are
    broadcast, so that the other rows are dropped where they are read and never shuffled. ``counts`` (of
    ``bin_counts``, for the same rows) take the place of the first pass.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *group, value, _bin(value).alias("_bin"))
    counts = bin_counts(df, value, group) if counts is None else counts
    upto = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    # A few thousand bins per group at most: the range of doubles in steps of one percent.
    placed = counts.select(*group, "_bin", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n",
                           F.sum("_n").over(whole).alias("_all"))
    wanted = placed.where(touched(F.col("_before"), F.col("_before") + F.col("_n") - 1, F.col("_all")))
    side = pin(wanted.select(*[F.col(g).alias(f"_w{i}") for i, g in enumerate(group)], F.col("_bin").alias("_wb"),
                             "_before", "_all"), "bins")
    if side.count() <= _BROADCAST_BINS:
        side = F.broadcast(side)
    match = F.col("_bin") == F.col("_wb")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_w{i}"))
    counted = rows.join(side, match).groupBy(*group, "_bin", "_before", "_all", value).agg(
        F.count(F.lit(1)).alias("_c"))
    run = with_running(counted, [F.col(value).asc()], {"_inside": ("sum", "_c")}, group=[*group, "_bin"])
    return run.withColumn("_upto", F.col("_before") + F.col("_inside"))


def percentiles(df: DataFrame, value: str, shares: Mapping[str, float], group: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group; ``counts`` are stored ``bin_counts`` of the rows."""

    def at(all_rows: Column, share: float) -> Column:
        return (all_rows - F.lit(1)).cast("double") * F.lit(float(share))

    def touched(first: Column, last: Column, all_rows: Column) -> Column:
        hit = F.lit(False)
        for share in shares.values():
            place = at(all_rows, share)
            hit = hit | F.floor(place).between(first, last) | F.ceil(place).between(first, last)
        return hit

    run = _around(df, value, group, touched, counts)
    aggs = []
    for name, share in shares.items():
        place = at(F.col("_all"), share)
        for side, row in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("_upto") > row) & (F.col("_upto") - F.col("_c") <= row)
            aggs.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"{name}_{side}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"{name}_w"))
    picked = run.groupBy(*group).agg(*aggs)
    return picked.select(*group, *[_between(F.col(f"{n}_lo"), F.col(f"{n}_hi"), F.col(f"{n}_w")).alias(n) for n in shares])


def _between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; equal ends, infinite ones too, are the result."""
    return F.when(low == high, low).otherwise(low + (high - low) * share)


def quantile_points(df: DataFrame, value: str, parts: int, group: Sequence[str] = ()) -> DataFrame:
    """The ``parts`` - 1 inner quantiles as rows (``k``, ``boundary``), exact with linear interpolation.

    Each distinct value finds the few quantiles whose neighbours it holds by arithmetic on its row numbers.
    """

    def candidates(first: Column, last: Column, all_rows: Column) -> tuple[Column, Column]:
        """Range of the quantiles whose place lies between the neighbours of these rows; mostly empty."""
        gaps = F.greatest(all_rows - 1, F.lit(1)).cast("double")
        slack = F.lit(1e-6)
        low = F.greatest(F.lit(1), F.ceil((first - 1) * parts / gaps - slack).cast("int"))
        high = F.least(F.lit(parts - 1), F.floor((last + 1) * parts / gaps + slack).cast("int"))
        return low, high

    def touched(first: Column, last: Column, all_rows: Column) -> Column:
        low, high = candidates(first, last, all_rows)
        return low <= high

    run = _around(df, value, group, touched)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    low, high = candidates(first, last, F.col("_all"))

    def at(k: Column) -> Column:
        return (F.col("_all") - 1).cast("double") * (k.cast("double") / F.lit(float(parts)))

    near = F.filter(F.sequence(low, high),
                    lambda k: F.floor(at(k)).between(first, last) | F.ceil(at(k)).between(first, last))
    hits = run.where(low <= high).select(*group, F.col(value).cast("double").alias("_x"), first.alias("_a"),
                                         last.alias("_b"), "_all", F.explode(near).alias("k"))
    place = at(F.col("k"))
    picked = hits.groupBy(*group, "k").agg(
        F.max(F.when(F.floor(place).between(F.col("_a"), F.col("_b")), F.col("_x"))).alias("_lo"),
        F.max(F.when(F.ceil(place).between(F.col("_a"), F.col("_b")), F.col("_x"))).alias("_hi"),
        F.max(place - F.floor(place)).alias("_w"))
    return picked.select(*group, "k", _between(F.col("_lo"), F.col("_hi"), F.col("_w")).alias("boundary"))
