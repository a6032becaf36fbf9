"""Revenue concentration: Pareto curves, their thinned points, and threshold lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.numbers import exact_sum, percent
from tillwork.plans.global_order import tie_running, with_running
from tillwork.session import pin

THRESHOLDS = (70, 80, 90, 95)


def pareto(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Entities by revenue: rank, running revenue (equal revenue counts together), and both in percent."""
    totals = pin(
        df.where(F.col(entity).isNotNull() & F.col(amount).isNotNull())
        .groupBy(entity).agg(exact_sum(amount).alias("revenue")),
        "revenue",
    )
    ranked = with_running(totals, [F.col("revenue").desc(), F.col(entity).asc()], position="rank_no",
                          group_size="n_entities")
    run = tie_running(totals, "revenue", {"cumulative": "revenue"}, totals={"grand_total": "cumulative"})
    return ranked.join(run, "revenue").select(
        entity, "rank_no", "n_entities", "revenue", "cumulative", "grand_total",
        percent(F.col("rank_no"), F.col("n_entities")).alias("entity_pct"),
        percent(F.col("cumulative"), F.col("grand_total")).alias("revenue_pct"),
    )


def thresholds(curve: DataFrame, levels=THRESHOLDS) -> DataFrame:
    """Entities needed to reach each level, from the whole curve."""
    first = [F.min(F.when(F.col("revenue_pct") >= p, F.col("rank_no"))).alias(f"_{p}") for p in levels]
    one = curve.agg(F.max("n_entities").alias("n"), F.max("grand_total").alias("grand"), *first)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"_{p}").alias("needed")) for p in levels]))
    return one.select("n", "grand", rows.alias("x")).select(
        F.col("x.level").alias("level"), F.col("x.needed").alias("entities"),
        percent(F.col("x.needed"), F.col("n")).alias("entity_pct"),
        F.col("n").alias("n_entities"), F.col("grand").cast("double").alias("total_revenue"),
    )


def _every(points: int):
    """Step between evenly spaced points; the division is rounded, not cut."""
    n = F.col("n_entities").cast("double")
    return F.greatest(F.lit(1), F.floor(n / F.lit(float(points)) + F.lit(0.5)).cast("long"))


def curve_points(curve: DataFrame, points: int = 100) -> DataFrame:
    """First, last, threshold and evenly spaced points of the curve."""
    pinned = pin(curve, "curve")
    crossing = F.lit(False)
    for level in (70, 80, 90, 95, 99.9):
        first = pinned.where(F.col("revenue_pct") >= level).select(F.min("rank_no")).scalar()
        crossing = crossing | F.coalesce(F.col("rank_no") == first, F.lit(False))
    rank = F.col("rank_no")
    return pinned.where(
        (rank == 1) | (rank == F.col("n_entities")) | crossing | (F.pmod(rank, _every(points)) == 0)
    )


def banded_points(curve: DataFrame, points: int = 50, band: float = 0.5) -> DataFrame:
    """First, last and evenly spaced points, and all within a band around the thresholds."""
    rank, near = F.col("rank_no"), F.lit(False)
    for level in THRESHOLDS:
        near = near | F.col("revenue_pct").between(level - band, level + band)
    return curve.where((rank == 1) | (rank == F.col("n_entities")) | (F.pmod(rank, _every(points)) == 0) | near)


def threshold_entities(curve: DataFrame, entity: str, level: float, limit: int | None = None) -> DataFrame:
    """Entities up to and including the one that reaches ``level`` percent of revenue."""
    own_start = (F.col("cumulative") - F.col("revenue")).cast("double")
    line = F.col("grand_total").cast("double") * F.lit(level / 100.0)
    out = curve.where((F.col("cumulative").cast("double") <= line) | (own_start < line)).select(
        entity, "rank_no", F.col("revenue").cast("double").alias("revenue"), "revenue_pct")
    return out.orderBy("rank_no").limit(limit) if limit is not None else out
