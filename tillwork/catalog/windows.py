from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import PRODUCTS, TX, msum, pct, r
from tillwork.operators import pareto as p
from tillwork.operators import rolling
from tillwork.plans.transactions import products, transactions


def _curve_sql(entity: str) -> str:
    return f"""{TX}, totals AS (SELECT {entity}, {msum('sales')} AS revenue FROM tx GROUP BY 1),
ranked AS (SELECT {entity}, revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, {entity}) AS rank_no,
  count(*) OVER () AS n_entities, SUM(revenue) OVER () AS grand_total,
  SUM(revenue) OVER (ORDER BY revenue DESC) AS cumulative FROM totals),
curve AS (SELECT *, {pct('rank_no', 'n_entities')} AS entity_pct, {pct('cumulative', 'grand_total')} AS revenue_pct
  FROM ranked)"""


def _points(entity: str) -> str:
    return f"""SELECT {entity}, rank_no, CAST(revenue AS DOUBLE) AS revenue, CAST(cumulative AS DOUBLE) AS cumulative,
  entity_pct, revenue_pct FROM"""


def _show(df, entity):
    return df.select(entity, "rank_no", F.col("revenue").cast("double"), F.col("cumulative").cast("double"),
                     "entity_pct", "revenue_pct")


def _threshold_sql(entity: str) -> str:
    one = " UNION ALL ".join(
        f"SELECT {x} AS level, min(rank_no) FILTER (WHERE revenue_pct >= {x}) AS entities FROM curve"
        for x in (70, 80, 90, 95))
    return f"""WITH {_curve_sql(entity)}, th AS ({one}), one AS (SELECT max(n_entities) AS n_entities,
  CAST(max(grand_total) AS DOUBLE) AS total_revenue FROM curve)
SELECT level, entities, {pct('entities', 'n_entities')} AS entity_pct, n_entities, total_revenue FROM th, one"""


@query("pareto_product", f"WITH {_curve_sql('product_id')} {_points('product_id')} curve")
def pareto_product(t):
    return _show(p.pareto(transactions(t), "product_id", "sales"), "product_id")


@query("pareto_product_thresholds", _threshold_sql("product_id"))
def pareto_product_thresholds(t):
    return p.thresholds(p.pareto(transactions(t), "product_id", "sales"))


@query("pareto_curve_points", f"""WITH {_curve_sql('product_id')}, th AS (
  SELECT min(rank_no) AS x FROM curve WHERE revenue_pct >= 70 UNION SELECT min(rank_no) FROM curve WHERE revenue_pct >= 80
  UNION SELECT min(rank_no) FROM curve WHERE revenue_pct >= 90 UNION SELECT min(rank_no) FROM curve WHERE revenue_pct >= 95
  UNION SELECT min(rank_no) FROM curve WHERE revenue_pct >= 99.9)
{_points('product_id')} curve WHERE rank_no = 1 OR rank_no = n_entities OR rank_no IN (SELECT x FROM th)
  OR rank_no % greatest(1, CAST(floor(n_entities / 100.0e0 + 0.5e0) AS BIGINT)) = 0""")
def pareto_curve_points(t):
    return _show(p.curve_points(p.pareto(transactions(t), "product_id", "sales")), "product_id")


@query("pareto_customer", f"""WITH {_curve_sql('customer_id')}
{_points('customer_id')} curve WHERE rank_no = 1 OR rank_no = n_entities
  OR rank_no % greatest(1, CAST(floor(n_entities / 50.0e0 + 0.5e0) AS BIGINT)) = 0
  OR revenue_pct BETWEEN 69.5 AND 70.5 OR revenue_pct BETWEEN 79.5 AND 80.5
  OR revenue_pct BETWEEN 89.5 AND 90.5 OR revenue_pct BETWEEN 94.5 AND 95.5""")
def pareto_customer(t):
    return _show(p.banded_points(p.pareto(transactions(t), "customer_id", "sales")), "customer_id")


@query("pareto_customer_thresholds", _threshold_sql("customer_id"))
def pareto_customer_thresholds(t):
    return p.thresholds(p.pareto(transactions(t), "customer_id", "sales"))


@query("topk_per_customer_products", f"""WITH {_curve_sql('product_id')}
SELECT product_id, rank_no, CAST(revenue AS DOUBLE) AS revenue, revenue_pct FROM curve
WHERE CAST(cumulative AS DOUBLE) <= CAST(grand_total AS DOUBLE) * 0.8e0
   OR CAST(cumulative - revenue AS DOUBLE) < CAST(grand_total AS DOUBLE) * 0.8e0""")
def topk_per_customer_products(t):
    return p.threshold_entities(p.pareto(transactions(t), "product_id", "sales"), "product_id", 80)


_DAILY = f"""daily AS (SELECT customer_id, CAST(ts AS DATE) AS day, {msum('sales')} AS daily_total,
  count(DISTINCT product_id) AS daily_products FROM tx GROUP BY 1, 2)"""


@query("rolling_customer_features", f"""WITH {TX}, {_DAILY}
SELECT a.customer_id, a.day, CAST(coalesce(sum(b.daily_total), 0) AS DOUBLE) AS cust_value,
  count(b.day) AS cust_order_days, CAST(coalesce(sum(b.daily_products), 0) AS BIGINT) AS cust_unique_products
FROM daily a LEFT JOIN daily b ON a.customer_id = b.customer_id AND b.day >= a.day - 60 AND b.day < a.day
GROUP BY a.customer_id, a.day""")
def rolling_customer_features(t):
    return rolling.rolling_features(rolling.daily_totals(transactions(t)), 60).select(
        "customer_id", "day", "cust_value", "cust_order_days", "cust_unique_products")


@query("rolling_true_distinct", f"""WITH {TX}, bought AS (SELECT DISTINCT customer_id, product_id, CAST(ts AS DATE) AS day FROM tx),
visits AS (SELECT DISTINCT customer_id, day FROM bought)
SELECT v.customer_id, v.day, count(DISTINCT b.product_id) AS distinct_products
FROM visits v LEFT JOIN bought b ON v.customer_id = b.customer_id AND b.day >= v.day - 60 AND b.day < v.day
GROUP BY v.customer_id, v.day""")
def rolling_true_distinct(t):
    return rolling.true_distinct_products(transactions(t), 60)


@query("recency_days", f"""WITH {TX}, visits AS (SELECT DISTINCT customer_id, CAST(ts AS DATE) AS day FROM tx)
SELECT customer_id, day, coalesce(date_diff('day', lag(day) OVER (PARTITION BY customer_id ORDER BY day), day), 0)
  AS days_since_last_purchase FROM visits""")
def recency_days(t):
    return rolling.rolling_features(rolling.daily_totals(transactions(t))).select(
        "customer_id", "day", "days_since_last_purchase")


@query("dedup_latest", f"""WITH {TX}
SELECT customer_id, product_id, order_id, line_no, store_id, sales, CAST(ts AS DATE) AS day FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, product_id
    ORDER BY ts DESC, order_id DESC, line_no DESC, store_id DESC, sales DESC, quantity DESC, priority DESC) AS rn FROM tx)
WHERE rn = 1""")
def dedup_latest(t):
    return rolling.dedup_latest(transactions(t), ["customer_id", "product_id"]).select(
        "customer_id", "product_id", "order_id", "line_no", "store_id", "sales", F.to_date("ts").alias("day"))


@query("category_revenue_pctile", f"""WITH {TX}, {PRODUCTS}, totals AS (
  SELECT tx.product_id, p.category, {msum('sales')} AS total FROM tx JOIN products p ON tx.product_id = p.product_id
  GROUP BY 1, 2)
SELECT product_id, category, CAST(total AS DOUBLE) AS total,
  {r('percent_rank() OVER (PARTITION BY category ORDER BY total)', 4)} AS revenue_pctile FROM totals""")
def category_revenue_pctile(t):
    facts = transactions(t).join(products(t).select("product_id", "category"), "product_id")
    return rolling.category_percentile(facts, "product_id", "category", "sales").select(
        "product_id", "category", F.col("total").cast("double").alias("total"), "revenue_pctile")


_HISTORY = """pairs AS (SELECT customer_id, product_id, max(ts) AS last_ts FROM tx GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY last_ts DESC, product_id) AS rn FROM pairs),
hist AS (SELECT customer_id, list(product_id ORDER BY rn) AS h FROM ranked WHERE rn <= 50 GROUP BY 1)"""


def _text(array):
    return F.array_join(array.cast("array<string>"), ",")


@query("purchase_history_topk", f"""WITH {TX}, {_HISTORY}
SELECT customer_id, len(h) AS n, array_to_string(h, ',') AS history FROM hist""")
def purchase_history_topk(t):
    hist = rolling.purchase_history(rolling.pair_last_dates(transactions(t)), 50)
    return hist.select("customer_id", F.size("purchase_history").alias("n"),
                       _text(F.col("purchase_history")).alias("history"))


@query("history_exclude_target", f"""WITH {TX}, {_HISTORY}
SELECT pairs.customer_id, product_id, array_to_string(list_filter(h, lambda x: x <> product_id), ',') AS history
FROM pairs JOIN hist ON pairs.customer_id = hist.customer_id""")
def history_exclude_target(t):
    pairs = rolling.pair_last_dates(transactions(t))
    return pairs.join(rolling.purchase_history(pairs, 50), "customer_id").select(
        "customer_id", "product_id", _text(rolling.without_target("purchase_history", "product_id")).alias("history"))


@query("customer_total_over", f"""WITH {TX}
SELECT customer_id, product_id, order_id, line_no, sales,
  CAST(SUM(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY customer_id) AS DOUBLE) AS customer_revenue FROM tx""")
def customer_total_over(t):
    return rolling.group_total(transactions(t), "customer_id", "sales", "customer_revenue").select(
        "customer_id", "product_id", "order_id", "line_no", "sales", "customer_revenue")


@query("running_best", """SELECT event_id, value, max(value) OVER w AS best_value, min(value) OVER w AS lowest_value,
  count(*) OVER w AS run_no FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_best(t):
    log = t.events.select("event_id", "ts", "value", F.col("value").alias("error"))
    out = rolling.running_best(log, ["ts", "event_id"], {"value": "max", "error": "min"})
    return out.select("event_id", "value", "best_value", F.col("best_error").alias("lowest_value"), "run_no")
