from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import PRODUCTS, STORES, TX, msum, pct, r
from tillwork.functions.numbers import exact_sum
from tillwork.operators import joins as j
from tillwork.operators import rolling
from tillwork.plans.dataset_spec import DatasetSpec, JoinSpec
from tillwork.plans.transactions import products, stores, transactions


@query("join_star", f"""WITH {TX}, {PRODUCTS}, {STORES}
SELECT tx.customer_id, tx.product_id, tx.sales, p.name, p.category, s.city, c.c_mktsegment AS segment
FROM tx LEFT JOIN products p ON tx.product_id = p.product_id LEFT JOIN stores s ON tx.store_id = s.store_id
LEFT JOIN customer c ON tx.customer_id = c.c_custkey""")
def join_star(t):
    spec = DatasetSpec(
        primary="tx",
        joins=(JoinSpec("products", "product_id"), JoinSpec("stores", "store_id"),
               JoinSpec("customers", "customer_id", "c_custkey")),
        columns={"tx": ("customer_id", "product_id", "sales"), "products": ("name", "category"),
                 "stores": ("city",), "customers": ("c_mktsegment",)},
        aliases={"customers.c_mktsegment": "segment"},
    )
    return spec.to_df({"tx": transactions(t), "products": products(t), "stores": stores(t),
                       "customers": t.customer})


@query("join_preview", f"""WITH j AS (SELECT o_orderkey, l_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
a AS (SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after,
  count(*) FILTER (WHERE l_orderkey IS NULL) AS unmatched_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_keys
  FROM j)
SELECT *, {pct('unmatched_rows', 'rows_after')} AS unmatched_pct, rows_after > rows_before AS rows_multiplied FROM a""")
def join_preview(t):
    return j.join_report(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "lines")[1]


@query("join_preview_rows", """SELECT o_orderkey, o_custkey, lines_l_partkey, lines_l_linenumber, lines_l_quantity,
  lines_l_extendedprice FROM (
  SELECT o_orderkey, o_custkey, l_partkey AS lines_l_partkey, l_linenumber AS lines_l_linenumber,
         l_quantity AS lines_l_quantity, l_extendedprice AS lines_l_extendedprice
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
ORDER BY o_orderkey, lines_l_partkey, lines_l_linenumber, lines_l_extendedprice LIMIT 10""")
def join_preview_rows(t):
    joined, _ = j.join_report(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "lines")
    cols = ["o_orderkey", "o_custkey", "lines_l_partkey", "lines_l_linenumber", "lines_l_quantity",
            "lines_l_extendedprice"]
    return joined.select(cols).orderBy(
        "o_orderkey", F.col("lines_l_partkey").asc_nulls_last(), "lines_l_linenumber", "lines_l_extendedprice"
    ).limit(10)


def _unique_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count({column}) AS total_rows,
  count(DISTINCT {column}) AS distinct_keys, count({column}) = count(DISTINCT {column}) AS is_unique,
  {r(f'count({column})::DOUBLE / count(DISTINCT {column})')} AS duplication_factor FROM {table}"""


@query("join_key_uniqueness", " UNION ALL ".join(
    _unique_sql(*x) for x in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"))))
def join_key_uniqueness(t):
    return (j.key_uniqueness(t.lineitem, "l_orderkey")
            .unionByName(j.key_uniqueness(t.orders, "o_orderkey"))
            .unionByName(j.key_uniqueness(t.orders, "o_custkey")))


def _detect_sql(table, a, b, score, confidence, source):
    return f"""SELECT '{table}' AS table_name, '{a}' AS primary_column, '{b}' AS secondary_column, {score} AS score,
  '{confidence}' AS confidence, count(*) AS primary_keys, count(o) AS matched_keys,
  {pct('count(o)', 'count(*)')} AS containment_pct, (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM {source} GROUP BY {b})) AS secondary_unique
FROM (SELECT DISTINCT {a} AS k FROM tx) LEFT JOIN (SELECT DISTINCT {b} AS o FROM {source}) ON k = o"""


@query("join_key_detection", f"WITH {TX}, {PRODUCTS}, customers AS (SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance FROM customer) "
       + _detect_sql("products", "product_id", "product_id", 19, "high", "products") + " UNION ALL "
       + _detect_sql("customers", "customer_id", "id", 17, "high", "customers"))
def join_key_detection(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"),
                                  F.col("c_acctbal").alias("balance"))
    return j.detect_join_keys(transactions(t), {"products": products(t), "customers": customers})


@query("semi_join_in_subquery", f"""WITH {TX}
SELECT customer_id, count(*) AS n_rows, CAST({msum('sales')} AS DOUBLE) AS revenue FROM tx
WHERE product_id IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY customer_id""")
def semi_join_in_subquery(t):
    wanted = t.part.where(F.col("p_size") > 40).select(F.col("p_partkey").alias("product_id"))
    return transactions(t).join(wanted, "product_id", "left_semi").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("sales").cast("double").alias("revenue"))


@query("anti_join_pairs", f"""WITH {TX}, cut AS (SELECT max(ts) - INTERVAL 180 DAY AS c FROM tx),
recent AS (SELECT DISTINCT customer_id, product_id FROM tx WHERE ts >= (SELECT c FROM cut)),
earlier AS (SELECT DISTINCT customer_id, product_id FROM tx WHERE ts < (SELECT c FROM cut))
SELECT r.customer_id, r.product_id FROM recent r LEFT JOIN earlier e
  ON r.customer_id = e.customer_id AND r.product_id = e.product_id WHERE e.customer_id IS NULL""")
def anti_join_pairs(t):
    tx = transactions(t)
    cut = tx.select(F.max("ts") - F.expr("INTERVAL 180 DAYS")).scalar()
    recent = tx.where(F.col("ts") >= cut).select("customer_id", "product_id").distinct()
    earlier = tx.where(F.col("ts") < cut).select("customer_id", "product_id").distinct()
    return recent.join(earlier, ["customer_id", "product_id"], "left_anti")


@query("cross_join_candidates", f"""WITH {TX}, pairs AS (SELECT DISTINCT customer_id, product_id FROM tx),
customers AS (SELECT DISTINCT customer_id FROM pairs)
SELECT c.customer_id, count(pp.product_id) AS n_bought, count(*) - count(pp.product_id) AS n_candidates
FROM customers c CROSS JOIN part p LEFT JOIN pairs pp ON pp.customer_id = c.customer_id AND pp.product_id = p.p_partkey
GROUP BY c.customer_id""")
def cross_join_candidates(t):
    catalog = t.part.select(F.col("p_partkey").alias("product_id"))
    return j.candidate_counts(transactions(t), catalog, "customer_id", "product_id")


@query("join_round_robin", f"""WITH {TX}, pairs AS (
  SELECT customer_id, product_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY product_id) AS k
  FROM (SELECT DISTINCT customer_id, product_id FROM tx)),
days_of AS (SELECT customer_id, day, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY day) AS slot,
    count(*) OVER (PARTITION BY customer_id) AS n
  FROM (SELECT DISTINCT customer_id, CAST(ts AS DATE) AS day FROM tx))
SELECT pairs.customer_id, product_id, k, day FROM pairs JOIN days_of d
  ON pairs.customer_id = d.customer_id AND d.slot = 1 + (k - 1) % d.n""")
def join_round_robin(t):
    from tillwork.plans.global_order import with_running

    tx = transactions(t)
    pairs = tx.select("customer_id", "product_id").distinct()
    numbered = with_running(pairs, [F.col("product_id").asc()], position="k", group=["customer_id"])
    days = tx.select("customer_id", F.to_date("ts").alias("day")).distinct()
    return j.round_robin(numbered, days, "customer_id", "k", ["day"])


@query("join_latest_dim", f"""WITH {TX}, latest AS (
  SELECT o_custkey AS customer_id, o_orderpriority AS segment, ROW_NUMBER() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT tx.customer_id, tx.product_id, tx.sales, l.segment
FROM tx LEFT JOIN latest l ON tx.customer_id = l.customer_id AND l.rn = 1""")
def join_latest_dim(t):
    history = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate"), F.col("o_orderkey"),
                              F.col("o_orderpriority").alias("segment"))
    return j.join_latest(transactions(t), history, "customer_id", ["o_orderdate", "o_orderkey"]).select(
        "customer_id", "product_id", "sales", "segment")


@query("join_inner_exclude", f"""WITH {TX}, {PRODUCTS}
SELECT tx.customer_id, tx.product_id, tx.sales, p.category FROM tx
JOIN (SELECT * FROM products WHERE category NOT IN ('PROMO', 'ECONOMY')) p ON tx.product_id = p.product_id""")
def join_inner_exclude(t):
    kept = products(t).where(~F.col("category").isin("PROMO", "ECONOMY")).select("product_id", "category")
    return transactions(t).join(kept, "product_id").select("customer_id", "product_id", "sales", "category")


_DAILY = f"""daily AS (SELECT customer_id, CAST(ts AS DATE) AS day, {msum('sales')} AS daily_total,
  count(DISTINCT product_id) AS daily_products FROM tx GROUP BY 1, 2)"""


@query("range_join_prior_days", f"""WITH {TX}, {_DAILY}
SELECT a.customer_id, a.day, CAST(coalesce(sum(b.daily_total), 0) AS DOUBLE) AS cust_value
FROM daily a LEFT JOIN daily b ON a.customer_id = b.customer_id AND b.day >= a.day - 60 AND b.day < a.day
GROUP BY a.customer_id, a.day""")
def range_join_prior_days(t):
    return rolling.rolling_features(rolling.daily_totals(transactions(t)), 60).select(
        "customer_id", "day", "cust_value")


@query("asof_prior_day", f"""WITH {TX}, {_DAILY}
SELECT a.customer_id, a.day, max(b.day) AS previous_day
FROM daily a LEFT JOIN daily b ON a.customer_id = b.customer_id AND b.day < a.day GROUP BY a.customer_id, a.day""")
def asof_prior_day(t):
    return rolling.rolling_features(rolling.daily_totals(transactions(t))).select(
        "customer_id", "day", "previous_day")
