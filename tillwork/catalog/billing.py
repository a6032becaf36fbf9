from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import money, r
from tillwork.operators.reports import billing as b
from tillwork.session import pin

_SERVICES = {"AF": "BigQuery", "RF": "Cloud Run", "NF": "Cloud Storage", "NO": "Vertex AI"}
_MARGINS = {"BigQuery": 10, "Cloud Run": 25, "Cloud Run — inf-1": 30}
_INFERENCE = ("inf-1", "inf-3")


def _bills(t):
    mix = F.concat("l_returnflag", "l_linestatus")
    service = F.coalesce(F.create_map(*[F.lit(x) for p in _SERVICES.items() for x in p])[mix], F.lit("Cloud Logging"))
    cost = (F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_discount").cast("decimal(18,4)")).cast("decimal(28,6)")
    credit = F.struct((-F.col("l_tax") * 100).cast("decimal(28,6)").alias("amount"))
    return t.lineitem.select(
        F.to_date("l_shipdate").alias("day"), service.alias("service"),
        F.concat(F.lit("projects/x/services/inf-"), F.pmod("l_suppkey", F.lit(5))).alias("resource"),
        F.when(F.col("l_linenumber") > 4, "Nvidia T4 GPU").otherwise("N1 core").alias("sku"), cost.alias("cost"),
        F.when(F.col("l_quantity") > 25, F.array(credit)).otherwise(F.array().cast("array<struct<amount:decimal(28,6)>>")).alias("credits"))


def _snapshots(t):
    return pin(b.classify(_bills(t), _INFERENCE, _MARGINS, 15), "snapshots")


_SNAP = f"""bills AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'BigQuery'
    WHEN 'RF' THEN 'Cloud Run' WHEN 'NF' THEN 'Cloud Storage' WHEN 'NO' THEN 'Vertex AI' ELSE 'Cloud Logging' END AS service,
  concat('inf-', l_suppkey % 5) AS container, l_linenumber > 4 AS gpu,
  CAST({money('l_extendedprice')} * {money('l_discount')} AS DECIMAL(28,6))
    + CASE WHEN l_quantity > 25 THEN CAST(-l_tax * 100 AS DECIMAL(28,6)) ELSE 0 END AS net FROM lineitem),
grouped AS (SELECT day, service, CASE WHEN service = 'Cloud Run' THEN container END AS container,
  service = 'Vertex AI' AND gpu AS gpu, CAST(round(sum(net), 2) AS DECIMAL(28,2)) AS cost FROM bills GROUP BY 1, 2, 3, 4),
named AS (SELECT day, CASE WHEN container IN ('inf-1', 'inf-3') THEN 'Inference' WHEN service = 'Vertex AI' THEN 'Training'
    WHEN service IN ('BigQuery', 'Cloud Storage') THEN 'Data' ELSE 'System' END AS category,
  CASE WHEN container IN ('inf-1', 'inf-3') THEN concat('Cloud Run — ', container) WHEN service = 'Vertex AI'
    THEN concat('Vertex AI — ', CASE WHEN gpu THEN 'GPU' ELSE 'CPU' END) ELSE service END AS service_name, cost
  FROM grouped WHERE cost > 0),
margins AS (SELECT *, CASE service_name WHEN 'BigQuery' THEN 10 WHEN 'Cloud Run' THEN 25 WHEN 'Cloud Run — inf-1' THEN 30 ELSE 15 END AS margin_pct,
  CAST(cost * 100 AS BIGINT) AS cents FROM named),
fees AS (SELECT *, cents * margin_pct AS x FROM margins),
snap AS (SELECT day, category, service_name, cost, margin_pct,
  CAST((x // 100 + CASE WHEN x % 100 > 50 OR (x % 100 = 50 AND (x // 100) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(28,2)) AS platform_fee
  FROM fees),
snapshots AS (SELECT *, CAST(cost + platform_fee AS DECIMAL(28,2)) AS total_cost FROM snap)"""


@query("billing_classify", f"""WITH {_SNAP} SELECT day, category, service_name, cost::DOUBLE AS cost, margin_pct,
  platform_fee::DOUBLE AS platform_fee, total_cost::DOUBLE AS total_cost FROM snapshots""")
def billing_classify(t):
    return b.classify(_bills(t), _INFERENCE, _MARGINS, 15).select(
        "day", "category", "service_name", F.col("cost").cast("double"), "margin_pct",
        F.col("platform_fee").cast("double"), F.col("total_cost").cast("double"))


_MONTH = "month AS (SELECT * FROM snapshots WHERE day >= date_trunc('month', (SELECT max(day) FROM snapshots)))"
_LICENCE = r("1000e0 * (1 - 10e0 / 100)")


@query("billing_invoice", f"""WITH {_SNAP}, {_MONTH}, s AS (SELECT {r('sum(total_cost)::DOUBLE * 1.5e0')} AS t FROM month),
n AS (SELECT t, {r(f't + {_LICENCE}')} AS net FROM s), v AS (SELECT *, {r('net * 20 / 100')} AS vat FROM n)
SELECT 'service' AS line, category, service_name, {r('sum(total_cost)::DOUBLE * 1.5e0')} AS amount FROM month GROUP BY 2, 3
UNION ALL SELECT 'category', category, NULL, {r('sum(total_cost)::DOUBLE * 1.5e0')} FROM month GROUP BY 2
UNION ALL SELECT 'subtotal', NULL, NULL, t FROM v UNION ALL SELECT 'license', NULL, NULL, {_LICENCE}
UNION ALL SELECT 'grand_total', NULL, NULL, net FROM v UNION ALL SELECT 'vat', NULL, NULL, vat FROM v
UNION ALL SELECT 'grand_total_with_vat', NULL, NULL, {r('net + vat')} FROM v""")
def billing_invoice(t):
    return b.invoice(_snapshots(t), rate=1.5, license_fee=1000.0, license_discount_pct=10.0)


@query("billing_daily_dense", f"""WITH {_SNAP}, {_MONTH}, d AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', max(day)) AS TIMESTAMP),
  CAST(last_day(max(day)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM snapshots),
c AS (SELECT unnest(['Data', 'Training', 'Inference', 'System']) AS category)
SELECT d.day, c.category, CASE WHEN d.day IN (SELECT day FROM month) THEN coalesce(CAST(sum(total_cost) AS DOUBLE), 0) END AS total
FROM d CROSS JOIN c LEFT JOIN month m ON m.day = d.day AND m.category = c.category GROUP BY 1, 2""")
def billing_daily_dense(t):
    return b.daily_dense(_snapshots(t))


@query("billing_breakdown", f"WITH {_SNAP} SELECT category, sum(total_cost)::DOUBLE AS total FROM snapshots GROUP BY 1 ORDER BY total DESC")
def billing_breakdown(t):
    return b.breakdown(_snapshots(t))


@query("cost_per_run", f"""WITH {_SNAP}, runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, o_orderdate + to_days(CAST(o_custkey % 10 AS INTEGER)) AS completed_at FROM orders
  ORDER BY started_at DESC, run_id DESC LIMIT 10)
SELECT run_id, sum(total_cost)::DOUBLE AS cost FROM runs JOIN snapshots ON day >= CAST(started_at AS DATE) AND day <= CAST(completed_at AS DATE)
WHERE contains(lower(service_name), 'vertex ai') GROUP BY 1""")
def cost_per_run(t):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"),
        F.timestamp_add("DAY", F.pmod("o_custkey", F.lit(10)), F.col("o_orderdate")).alias("completed_at"))
    return b.cost_per_run(runs, _snapshots(t), "Vertex AI")
