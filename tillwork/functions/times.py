"""Calendar and epoch expressions; wall-clock timestamps are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period lengths in days of the seasonal encodings.
PERIOD_DAYS = {"yearly": 365.25, "quarterly": 91.31, "monthly": 30.44, "weekly": 7.0, "daily": 1.0}


def epoch_seconds(ts: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, ts.cast("timestamp_ntz"))


def day_number(ts: Column) -> Column:
    """Whole days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def cyclical(seconds: Column, period: str) -> tuple[Column, Column]:
    """Sine and cosine of the position inside a period, from epoch seconds.

    Weeks are aligned so that Sunday 00:00 is the start (1970-01-01 was a Thursday).
    """
    per_day = F.lit(86400.0)
    days = seconds.cast("double") / per_day
    if period == "weekly":
        days = days + F.lit(4.0)
    length = F.lit(PERIOD_DAYS[period])
    angle = F.pmod(days, length) / length * F.lit(2.0) * F.pi()
    return F.sin(angle), F.cos(angle)


def calendar_cycles(ts: Column) -> dict[str, Column]:
    """Sine and cosine of calendar positions, and of the fractional positions of an older feature set."""
    days = epoch_seconds(ts).cast("double") / F.lit(86400.0)
    # Positions and cycle lengths.
    cycles = {
        "weekday": (F.weekday(ts), 7.0),
        "month_day": (F.dayofmonth(ts), 31.0),
        "week": (F.pmod(days / F.lit(7.0), F.lit(52.0)), 52.0),
        "month": (F.pmod(days / F.lit(30.44), F.lit(12.0)), 12.0),
        "legacy_day": (F.pmod(days + F.lit(3.0), F.lit(7.0)), 7.0),
        "legacy_month_day": (F.pmod(days, F.lit(30.44)), 30.44),
    }
    out = {}
    for name, (at, length) in cycles.items():
        angle = F.lit(2.0) * F.pi() * at / F.lit(length)
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out
