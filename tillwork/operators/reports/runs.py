"""Run-log reports. ``runs`` has run_id, job, status, started_at, completed_at, rows, bytes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.numbers import percent, ratio, rounded

# Status groups of the reports.
SUCCESS = ("completed", "partial")
TRAINING_GROUPS = {
    "started": ("pending", "submitting", "running", "scheduled"),
    "completed": ("completed",),
    "failed": ("failed", "cancelled", "not_blessed"),
}
LOAD_GROUPS = {"completed": ("completed",), "failed": ("failed", "partial")}


def _since_latest(df: DataFrame, ts: str, days: int) -> DataFrame:
    return df.where(F.col(ts) >= df.select(F.max(ts) - F.expr(f"INTERVAL {int(days)} DAYS")).scalar())


def _micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def run_kpis(runs: DataFrame, days: int = 30) -> DataFrame:
    """Counts by status, volumes, success rate and mean positive duration of the last ``days`` days."""
    status = F.col("status")
    took = _micros(F.col("started_at"), F.col("completed_at"))
    timed = F.when(status.isin(*SUCCESS) & (took > 0), took)
    one = _since_latest(runs, "started_at", days).agg(
        F.count(F.lit(1)).alias("total_runs"),
        *[F.count_if(status == s).alias(f"{s}_runs") for s in ("completed", "failed", "partial", "cancelled")],
        F.sum("rows").alias("total_rows"), F.sum("bytes").alias("total_bytes"),
        F.sum(timed).alias("_took"), F.count(timed).alias("_timed"))
    good = F.col("completed_runs") + F.col("partial_runs")
    return one.select(
        "total_runs", "completed_runs", "failed_runs", "partial_runs", "cancelled_runs", "total_rows", "total_bytes",
        F.coalesce(percent(good, F.col("total_runs"), 1), F.lit(0.0)).alias("success_rate"),
        F.coalesce(rounded(ratio(F.col("_took"), F.col("_timed") * 1_000_000), 0), F.lit(0.0)).alias("avg_duration_seconds"))


def window_compare(runs: DataFrame, windows: Mapping[str, str]) -> DataFrame:
    """Active jobs, failures, successes and rows for several look-back windows, in one pass.

    ``windows`` maps a name to an interval such as ``24 HOURS``.
    """
    latest = runs.select(F.max("started_at")).scalar()
    aggs, parts = [], []
    for i, (name, span) in enumerate(windows.items()):
        inside = F.col("started_at") >= latest - F.expr(f"INTERVAL {span}")
        aggs += [
            F.count_distinct(F.when(inside, F.col("job"))).alias(f"jobs_{i}"),
            F.count_if(inside & (F.col("status") == "failed")).alias(f"failed_{i}"),
            F.count_if(inside & F.col("status").isin(*SUCCESS)).alias(f"success_{i}"),
            F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0)).alias(f"rows_{i}"),
        ]
        parts.append(F.struct(F.lit(name).alias("period"), F.col(f"jobs_{i}").alias("active_jobs"),
                              F.col(f"failed_{i}").alias("failed"), F.col(f"success_{i}").alias("success"),
                              F.col(f"rows_{i}").alias("rows")))
    return runs.agg(*aggs).select(F.inline(F.array(*parts)))


def daily_status_counts(runs: DataFrame, groups: Mapping[str, Sequence[str]], days: int) -> DataFrame:
    return _since_latest(runs, "started_at", days).groupBy(F.to_date("started_at").alias("day")).agg(
        *[F.count_if(F.col("status").isin(*members)).alias(name) for name, members in groups.items()])


def daily_best_avg(df: DataFrame, ts: str, metric: str, days: int = 30) -> DataFrame:
    """Best and mean metric per day, in percent."""
    exact = F.sum(F.col(metric).cast("decimal(28,10)"))
    return _since_latest(df, ts, days).where(F.col(metric).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        rounded(F.max(metric) * 100, 2).alias("best_pct"),
        rounded(ratio(exact, F.count(metric)) * 100, 2).alias("avg_pct"))


def activity_calendar(runs: DataFrame, weeks: int = 10) -> DataFrame:
    """Completed runs per day over the past weeks; days without any count 0."""
    done = runs.where(F.col("status") == "completed").groupBy(F.to_date("completed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    span = runs.agg(F.max(F.to_date("completed_at")).alias("last"))
    days = span.select(F.explode(F.sequence(F.date_sub("last", weeks * 7), F.col("last"))).alias("day"))
    return days.join(done, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("completed_runs"))


def resource_hours_by_day(runs: DataFrame, device_type: str, devices: str) -> DataFrame:
    """Hours x devices per day and device type, for every day that a run covers. An open run counts to the end
    of each day up to the last day with a start."""
    last_day = runs.select(F.max(F.to_date("started_at"))).scalar()
    first = F.to_date("started_at")
    until = F.least(F.coalesce(F.to_date("completed_at"), last_day), last_day)
    days = F.sequence(first, F.greatest(first, until))
    per_day = runs.withColumn("day", F.explode(days))
    begin = F.greatest("started_at", F.col("day").cast("timestamp_ntz"))
    day_end = F.date_add("day", 1).cast("timestamp_ntz")
    end = F.least(F.coalesce(F.col("completed_at"), day_end), day_end)
    used = per_day.withColumn("_us", _micros(begin, end)).where(F.col("_us") > 0)
    return used.groupBy("day", device_type).agg(
        F.count(F.lit(1)).alias("n_runs"),
        rounded(F.sum(F.col("_us") * F.col(devices)).cast("double") / F.lit(3.6e9), 2).alias("device_hours"))


# Errors --------------------------------------------------------------------------------------------------

# Stages of a failed run, tried in order; every word of one alternative must occur.
STAGE_RULES = (
    ("init", (("configuration",), ("config",), ("credentials",), ("authentication",), ("connection", "failed"))),
    ("validation", (("not found",), ("does not exist",), ("table", "missing"), ("table", "invalid"),
                    ("schema", "mismatch"), ("schema", "invalid"))),
    ("extraction", (("extraction",), ("extract",), ("query", "failed"), ("source", "unavailable"), ("source", "timeout"))),
    ("load", (("load", "failed"), ("load", "error"), ("bigquery", "write"), ("bigquery", "insert"))),
)

# Error kinds, tried in order, in any case.
KIND_PATTERNS = (
    ("ResourceExhausted", r"(ResourceExhausted|OOM|out of memory|memory limit|MemoryError)"),
    ("ResourceExhausted", r"(RESOURCE_EXHAUSTED.*memory|Cannot allocate|allocation failed)"),
    ("SchemaError", r"(column.*not found|KeyError.*['\"](\w+)['\"]|feature.*missing|Unknown feature)"),
    ("SchemaError", r"(schema.*mismatch|type.*mismatch|incompatible.*type|cannot convert)"),
    ("DataError", r"(no examples|empty dataset|zero rows|no data|0 examples)"),
    ("DataError", r"(null.*values|NaN|missing required|required field.*null)"),
    ("BigQueryError", r"(BigQuery.*error|bq.*error|query.*failed|SQL.*error)"),
    ("BigQueryError", r"(table.*not found|dataset.*not found|Not found: Table)"),
    ("QuotaError", r"(quota|limit exceeded|RESOURCE_EXHAUSTED(?!.*memory)|rate limit)"),
    ("TimeoutError", r"(timeout|deadline exceeded|DEADLINE_EXCEEDED|timed out)"),
    ("PermissionError", r"(permission denied|403|PERMISSION_DENIED|access denied|unauthorized)"),
    ("TransformError", r"(vocabulary.*error|vocab.*too large|StringToHashBucketFast)"),
    ("TransformError", r"(transform.*failed|preprocessing.*error|feature engineering.*failed)"),
    ("TrainingError", r"(loss.*nan|loss.*inf|gradient.*exploded|diverged)"),
    ("TrainingError", r"(embedding.*dimension|layer.*shape|shape.*mismatch)"),
    ("DataflowError", r"(Dataflow.*error|worker.*failed|beam.*error|pipeline.*aborted)"),
    ("NetworkError", r"(network.*error|connection.*refused|connection.*timeout|DNS.*failed)"),
    ("InternalError", r"(internal.*error|server.*error|500|service.*unavailable)"),
)


def error_stage(message: Column) -> Column:
    text, out = F.lower(message), None
    for stage, alternatives in STAGE_RULES:
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & text.contains(w)
            hit = hit | every
        out = F.when(hit, stage) if out is None else out.when(hit, stage)
    return out.otherwise("unknown")


def error_kind(message: Column) -> Column:
    out = F.when(message.isNull() | (F.length(message) == 0), "Unknown")
    for kind, pattern in KIND_PATTERNS:
        out = out.when(message.rlike("(?i)" + pattern), kind)
    return out.otherwise("Unknown")


def error_counts(runs: DataFrame, message: str) -> DataFrame:
    return runs.where(F.col(message).isNotNull()).groupBy(
        error_stage(F.col(message)).alias("stage"), error_kind(F.col(message)).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))


def recent_activity(logs: Mapping[str, DataFrame], each: int = 10, limit: int = 5) -> DataFrame:
    """Newest entries of several logs (name, status, at, id) in one list."""
    out = None
    for kind, log in logs.items():
        newest = log.select(F.lit(kind).alias("kind"), "id", "name", "status", "at") \
            .orderBy(F.col("at").desc(), F.col("id").desc()).limit(each)
        out = newest if out is None else out.unionByName(newest)
    return out.orderBy(F.col("at").desc(), F.col("kind"), F.col("id").desc()).limit(limit)
