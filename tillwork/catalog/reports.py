from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import pct, r
from tillwork.functions.numbers import rounded
from tillwork.operators.reports import endpoints as ep
from tillwork.operators.reports import runs as rr

_STATUS = {"purchase": "completed", "error": "failed", "view": "partial", "click": "cancelled", "signup": "running"}

_RUNS = """runs AS (SELECT event_id AS run_id, user_id % 10 AS job, ts AS started_at,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial'
    WHEN 'click' THEN 'cancelled' ELSE 'running' END AS status,
  CASE WHEN event_type <> 'signup' THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS completed_at,
  CAST(floor(value * 100) AS BIGINT) AS rows_n, CAST(floor(value * 100) AS BIGINT) * 1000 AS bytes_n,
  concat('type-', user_id % 3) AS device_type, user_id % 4 + 1 AS devices FROM events)"""


def runs_of(t):
    kind = F.col("event_type")
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[kind]
    volume = F.floor(F.col("value") * 100).cast("bigint")
    return t.events.select(
        F.col("event_id").alias("run_id"), F.pmod("user_id", F.lit(10)).alias("job"), F.col("ts").alias("started_at"),
        status.alias("status"),
        F.when(kind != "signup", F.timestamp_add("SECOND", F.floor(F.col("value") * 60), F.col("ts"))).alias("completed_at"),
        volume.alias("rows"), (volume * 1000).alias("bytes"),
        F.concat(F.lit("type-"), F.pmod("user_id", F.lit(3))).alias("device_type"),
        (F.pmod("user_id", F.lit(4)) + 1).alias("devices"))


@query("run_kpis", f"""WITH {_RUNS}, k AS (SELECT *, epoch_us(completed_at) - epoch_us(started_at) AS took FROM runs
  WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 14 DAY),
a AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed_runs,
  count(*) FILTER (WHERE status = 'failed') AS failed_runs, count(*) FILTER (WHERE status = 'partial') AS partial_runs,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled_runs, CAST(sum(rows_n) AS BIGINT) AS total_rows,
  CAST(sum(bytes_n) AS BIGINT) AS total_bytes,
  CAST(sum(took) FILTER (WHERE status IN ('completed', 'partial') AND took > 0) AS DOUBLE) AS took,
  count(*) FILTER (WHERE status IN ('completed', 'partial') AND took > 0) AS timed FROM k)
SELECT total_runs, completed_runs, failed_runs, partial_runs, cancelled_runs, total_rows, total_bytes,
  {pct('completed_runs + partial_runs', 'total_runs', 1)} AS success_rate, {r('took / (timed * 1000000)', 0)} AS avg_duration_seconds FROM a""")
def run_kpis(t):
    return rr.run_kpis(runs_of(t), 14)


def _window_sql(name: str, span: str) -> str:
    cond = f"started_at >= (SELECT max(started_at) FROM runs) - INTERVAL {span}"
    return f"""SELECT '{name}' AS period, count(DISTINCT job) FILTER (WHERE {cond}) AS active_jobs,
  count(*) FILTER (WHERE {cond} AND status = 'failed') AS failed,
  count(*) FILTER (WHERE {cond} AND status IN ('completed', 'partial')) AS success,
  CAST(sum(rows_n) FILTER (WHERE {cond}) AS BIGINT) AS rows FROM runs"""


@query("run_window_compare", f"WITH {_RUNS} {_window_sql('yesterday', '24 HOUR')} UNION ALL {_window_sql('week', '7 DAY')}")
def run_window_compare(t):
    return rr.window_compare(runs_of(t), {"yesterday": "24 HOURS", "week": "7 DAYS"})


@query("daily_status_counts", f"""WITH {_RUNS}, m AS (SELECT max(started_at) AS x FROM runs)
SELECT 'training' AS log, CAST(started_at AS DATE) AS day, count(*) FILTER (WHERE status IN ('running')) AS started,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS failed
FROM runs WHERE started_at >= (SELECT x FROM m) - INTERVAL 30 DAY GROUP BY 2
UNION ALL SELECT 'load', CAST(started_at AS DATE), 0, count(*) FILTER (WHERE status = 'completed'),
  count(*) FILTER (WHERE status IN ('failed', 'partial')) FROM runs WHERE started_at >= (SELECT x FROM m) - INTERVAL 14 DAY GROUP BY 2""")
def daily_status_counts(t):
    runs = runs_of(t)
    training = rr.daily_status_counts(runs, rr.TRAINING_GROUPS, 30).withColumn("log", F.lit("training"))
    load = rr.daily_status_counts(runs, rr.LOAD_GROUPS, 14).withColumn("log", F.lit("load")) \
        .withColumn("started", F.lit(0).cast("bigint"))
    return training.unionByName(load)


@query("daily_best_avg", f"""SELECT CAST(ts AS DATE) AS day, {r('max(value / 500e0) * 100')} AS best_pct,
  {r('CAST(sum(CAST(value / 500e0 AS DECIMAL(28,10))) AS DOUBLE) / count(value) * 100')} AS avg_pct FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1""")
def daily_best_avg(t):
    return rr.daily_best_avg(t.events.withColumn("metric", F.col("value") / F.lit(500.0)), "ts", "metric", 30)


@query("activity_calendar", f"""WITH {_RUNS}, d AS (SELECT CAST(unnest(generate_series(x - INTERVAL 70 DAY, x, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT CAST(max(CAST(completed_at AS DATE)) AS TIMESTAMP) AS x FROM runs))
SELECT d.day, count(run_id) AS completed_runs FROM d LEFT JOIN runs
  ON CAST(completed_at AS DATE) = d.day AND status = 'completed' GROUP BY 1""")
def activity_calendar(t):
    return rr.activity_calendar(runs_of(t), 10)


@query("resource_hours_by_day", f"""WITH {_RUNS}, days AS (SELECT CAST(unnest(generate_series(min(CAST(started_at AS DATE)), max(CAST(started_at AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM runs),
o AS (SELECT day, device_type, devices, epoch_us(least(coalesce(completed_at, CAST(day + 1 AS TIMESTAMP)), CAST(day + 1 AS TIMESTAMP)))
    - epoch_us(greatest(started_at, CAST(day AS TIMESTAMP))) AS us
  FROM runs JOIN days ON started_at < CAST(day + 1 AS TIMESTAMP)
    AND (completed_at IS NULL OR completed_at >= CAST(day AS TIMESTAMP)))
SELECT day, device_type, count(*) AS n_runs, {r('CAST(sum(us * devices) AS DOUBLE) / 3.6e9')} AS device_hours
FROM o WHERE us > 0 GROUP BY 1, 2""")
def resource_hours_by_day(t):
    return rr.resource_hours_by_day(runs_of(t), "device_type", "devices")


# Fixed sample messages, one per kind of failure, and what they are classified as.
_MESSAGES = (
    ("Invalid configuration value", "init", "Unknown"),
    ("Connection to host failed", "init", "Unknown"),
    ("Table orders does not exist", "validation", "Unknown"),
    ("Schema mismatch in column a", "validation", "SchemaError"),
    ("Query failed after 3 rows", "extraction", "BigQueryError"),
    ("Source timeout while reading", "extraction", "TimeoutError"),
    ("Load job error: quota reached", "load", "QuotaError"),
    ("BigQuery insert rejected", "load", "Unknown"),
    ("worker out of memory", "unknown", "ResourceExhausted"),
    ("Loss became NaN, run diverged", "unknown", "DataError"),
    ("403 on bucket", "unknown", "PermissionError"),
    ("something else", "unknown", "Unknown"),
)


@query("error_classify", "WITH m AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{s}', '{k}')" for i, (_, s, k) in enumerate(_MESSAGES)) + f""") x(i, stage, kind))
SELECT stage, kind, count(*) AS n FROM events JOIN m ON user_id % {len(_MESSAGES)} = i WHERE event_type = 'error' GROUP BY 1, 2""")
def error_classify(t):
    texts = F.array(*[F.lit(m) for m, _, _ in _MESSAGES])
    at = (F.pmod("user_id", F.lit(len(_MESSAGES))) + 1).cast("int")
    failed = t.events.where(F.col("event_type") == "error").withColumn("message", F.element_at(texts, at))
    return rr.error_counts(failed, "message")


@query("recent_activity", f"""WITH {_RUNS}, a AS (SELECT 'run' AS kind, run_id AS id, concat('job ', job) AS name, status, started_at AS at_ FROM runs),
b AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS status, o_orderdate + INTERVAL 8217 DAY AS at_ FROM orders),
u AS ((SELECT * FROM a ORDER BY at_ DESC, id DESC LIMIT 10) UNION ALL (SELECT * FROM b ORDER BY at_ DESC, id DESC LIMIT 10))
SELECT kind, id, name, status, strftime(at_, '%Y-%m-%dT%H:%M:%S') AS at_text FROM u ORDER BY at_ DESC, kind, id DESC LIMIT 5""")
def recent_activity(t):
    runs = runs_of(t).select(F.col("run_id").alias("id"), F.concat(F.lit("job "), "job").alias("name"), "status",
                             F.col("started_at").alias("at"))
    # Moved by a fixed span, so that the two logs are of the same time.
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
                             F.col("o_orderstatus").alias("status"),
                             (F.col("o_orderdate") + F.expr("INTERVAL 8217 DAYS")).alias("at"))
    out = rr.recent_activity({"run": runs, "order": orders})
    return out.select("kind", "id", "name", "status", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at_text"))


# Endpoints -----------------------------------------------------------------------------------------------

_ENDPOINTS = f"""reqs AS (SELECT CAST(ts AS DATE) AS day, concat('p', user_id % 5) AS project, concat('e', user_id % 20) AS name,
  value, event_type = 'error' AS failed, user_id, CASE WHEN user_id % 20 > 7 THEN (event_id % 90) / 100e0 END AS cpu, CASE WHEN user_id % 20 > 12 THEN (event_id % 7) / 10e0 ELSE 0 END AS memory FROM events),
eps AS (SELECT day, project, name, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors, count(DISTINCT user_id) AS peak,
  coalesce({r('CAST(sum(CAST(cpu AS DECIMAL(18,8))) * 100 AS DOUBLE) / count(cpu)', 1)}, 0) AS cpu, {r('CAST(sum(CAST(memory AS DECIMAL(18,8))) * 100 AS DOUBLE) / count(memory)', 1)} AS memory,
  quantile_cont(value, 0.5e0) AS p50, quantile_cont(value, 0.95e0) AS p95, quantile_cont(value, 0.99e0) AS p99 FROM reqs GROUP BY 1, 2, 3)"""


def _w(c: str, digits: int = 1) -> str:
    return r(f"CAST(sum(CAST({c} AS DECIMAL(18,8)) * CAST(requests AS DECIMAL(12,0))) AS DOUBLE) / sum(requests)", digits)


def _use(c: str) -> str:
    busy = "(cpu > 0 OR memory > 0)"
    return f"coalesce({r(f'CAST(sum(CAST({c} AS DECIMAL(18,8))) FILTER (WHERE {busy}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {busy}), 0)', 1)}, 0)"


_PROJECTS = f"""{_ENDPOINTS}, proj AS (SELECT day, project, CAST(sum(requests) AS BIGINT) AS total_requests, CAST(sum(errors) AS BIGINT) AS error_count,
  {_w('p50')} AS latency_p50_ms, {_w('p95')} AS latency_p95_ms, {_w('p99')} AS latency_p99_ms, max(peak) AS instance_count_peak,
  {r('avg(peak)', 1)} AS instance_count_avg, {_use('cpu')} AS cpu_utilization_avg, {_use('memory')} AS memory_utilization_avg, count(*) AS n_endpoints FROM eps GROUP BY 1, 2),
det AS (SELECT day, project, name, requests, errors, {r('p50', 1)} AS p50, {r('p95', 1)} AS p95, peak FROM eps)"""


def _requests(t):
    u = F.col("user_id")
    return t.events.select(
        F.to_date("ts").alias("day"), F.concat(F.lit("p"), F.pmod(u, F.lit(5))).alias("project"), F.concat(F.lit("e"), F.pmod(u, F.lit(20))).alias("name"),
        "value", (F.col("event_type") == "error").alias("failed"), u, F.when(F.pmod(u, F.lit(20)) > 7, F.pmod("event_id", F.lit(90)) / F.lit(100.0)).alias("cpu"),
        F.when(F.pmod(u, F.lit(20)) > 12, F.pmod("event_id", F.lit(7)) / F.lit(10.0)).otherwise(0.0).alias("memory"))


_USES = {"cpu": "cpu", "memory": "memory"}


def _endpoints(t):
    from tillwork.session import pin

    return pin(ep.endpoint_metrics(_requests(t), "value", "failed", "user_id", _USES), "endpoints")


@query("weighted_latency", f"""WITH {_PROJECTS} SELECT * FROM proj""")
def weighted_latency(t):
    return ep.project_metrics(_endpoints(t))


@query("endpoint_days_stored", f"""WITH {_ENDPOINTS} SELECT day, project, name, requests, errors, peak, cpu, memory, {r('p50', 1)} AS p50, {r('p95', 1)} AS p95, {r('p99', 1)} AS p99 FROM eps""")
def endpoint_days_stored(t):
    """Days stored one part after the other; the second part repeats a day of the first, which it replaces."""
    path, requests = _stored(t)
    one = lambda c: rounded(F.col(f"latency_{c}_ms"), 1).alias(c)
    return ep.stored_days(t.spark, path).select("day", "project", "name", "requests", "errors", "peak", "cpu", "memory", one("p50"), one("p95"), one("p99"))


def _stored(t):
    from tillwork.session import fresh_path, pin

    path, requests = fresh_path(t.spark, "endpoint-days"), pin(_requests(t), "requests")
    middle = requests.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    half = middle["a"] + (middle["b"] - middle["a"]) / 2
    for part in (requests.where(F.col("day") <= half), requests.where(F.col("day") >= half)):
        ep.store_days(part, path, "value", "failed", "user_id", _USES)
    return path, requests


@query("endpoint_period_latency", f"""WITH {_ENDPOINTS} SELECT project, name, {', '.join(f"{r(f'quantile_cont(value, {q}e0)', 4)} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))}
FROM reqs GROUP BY 1, 2""")
def endpoint_period_latency(t):
    """Percentiles of all days from their stored counts; requests are read for the bins that hold them."""
    path, requests = _stored(t)
    found = ep.period_latencies(ep.stored_days(t.spark, path), requests, "value")
    return found.select("project", "name", *[rounded(F.col(f"latency_{c}_ms"), 4).alias(c) for c in ("p50", "p95", "p99")])


_AGED = f"""{_PROJECTS}, last AS (SELECT project, max(day) AS last, min(day) AS first FROM proj GROUP BY 1),
aged AS (SELECT p.*, date_diff('day', day, last) AS age FROM proj p JOIN last l ON p.project = l.project),
daged AS (SELECT p.*, date_diff('day', day, last) AS age FROM det p JOIN last l ON p.project = l.project)"""


def _sum(x: str, cond: str) -> str:
    return f"coalesce(sum({x}) FILTER (WHERE {cond}), 0)::DOUBLE"


@query("endpoint_week_compare", f"""WITH {_AGED}, a AS (SELECT project, coalesce(sum(total_requests) FILTER (WHERE age < 7), 0)::BIGINT AS requests,
  {_sum('total_requests', 'age BETWEEN 7 AND 13')} AS rb, {_sum('error_count', 'age < 7')} AS e7,
  {_sum('CAST(latency_p95_ms AS DECIMAL(18,8)) * total_requests::DECIMAL(12,0)', 'age < 7')} AS p,
  {_sum('CAST(latency_p95_ms AS DECIMAL(18,8)) * total_requests::DECIMAL(12,0)', 'age BETWEEN 7 AND 13')} AS pb,
  {_sum('total_requests', 'age < 3')} AS n3, {_sum('error_count', 'age < 3')} AS e3,
  {_sum('total_requests', 'age BETWEEN 3 AND 6')} AS n4, {_sum('error_count', 'age BETWEEN 3 AND 6')} AS e4,
  count(DISTINCT day) FILTER (WHERE age < 7) AS days7, max(instance_count_peak) FILTER (WHERE age < 7) AS peak_instances,
  avg(instance_count_avg) FILTER (WHERE age < 7 AND instance_count_avg > 0) AS av FROM aged GROUP BY project)
SELECT project, requests, coalesce({pct('requests - rb', 'nullif(rb, 0)', 1)}, 0) AS request_change_pct, {r('p / requests', 0)} AS p95_ms,
  {r('p / requests', 0)} - coalesce({r('pb / nullif(rb, 0)', 0)}, 0) AS p95_change_ms, {r('e7 * 100 / requests')} AS error_rate_pct,
  CASE WHEN days7 < 4 OR abs(e3 * 100 / n3 - e4 * 100 / n4) < 0.01 THEN 'stable' WHEN e3 * 100 / n3 > e4 * 100 / n4 THEN 'up' ELSE 'down' END AS error_trend,
  peak_instances, {r('av', 1)} AS avg_instances FROM a""")
def endpoint_week_compare(t):
    return ep.week_compare(ep.project_metrics(_endpoints(t)))


@query("endpoint_performance", f"""WITH {_AGED}, a AS (SELECT project, name, sum(requests) FILTER (WHERE age < 7) AS requests,
  sum(errors) FILTER (WHERE age < 7) AS errors, 
  CAST(sum(CAST(p50 AS DECIMAL(18,8)) * requests::DECIMAL(12,0)) FILTER (WHERE age < 7) AS DOUBLE) AS p50,
  CAST(sum(CAST(p95 AS DECIMAL(18,8)) * requests::DECIMAL(12,0)) FILTER (WHERE age < 7) AS DOUBLE) AS p95, sum(requests) FILTER (WHERE age BETWEEN 7 AND 13) AS b FROM daged GROUP BY 1, 2)
SELECT project, name, requests::BIGINT AS requests, {r('p50 / requests', 1)} AS avg_latency, {r('p95 / requests', 1)} AS p95_latency,
  errors::BIGINT AS errors, {pct('errors', 'requests')} AS error_rate, coalesce({pct('requests - b', 'b', 1)}, 0) AS trend
FROM a WHERE requests IS NOT NULL""")
def endpoint_performance(t):
    return ep.endpoint_performance(_endpoints(t))


@query("peak_periods", f"""WITH {_AGED} SELECT project, rank_no, day, name, requests, peak AS max_instances FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY requests DESC, day, name) AS rank_no FROM daged WHERE age < 30) WHERE rank_no <= 5""")
def peak_periods(t):
    return ep.peak_periods(_endpoints(t))


@query("endpoint_daily_matrix", f"""WITH {_AGED}, d AS (SELECT project, CAST(unnest(generate_series(CAST(greatest(first, last - 29) AS TIMESTAMP),
  CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM last)
SELECT d.project, d.day, n.name, coalesce(sum(requests), 0)::BIGINT AS requests FROM d JOIN (SELECT DISTINCT project, name FROM daged WHERE age < 30) n ON n.project = d.project
LEFT JOIN daged x ON x.project = d.project AND x.day = d.day AND x.name = n.name GROUP BY 1, 2, 3""")
def endpoint_daily_matrix(t):
    return ep.daily_matrix(_endpoints(t))
