from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import PRODUCTS, STORES, TX, msum, r
from tillwork.functions.numbers import exact_sum, rounded
from tillwork.operators import filters as f
from tillwork.plans.dataset_spec import DatasetSpec, JoinSpec
from tillwork.plans.transactions import products, stores, transactions


def _summary(df):
    """Rows, entities and exact revenue of what a filter kept."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("customer_id").alias("n_customers"),
        F.count_distinct("product_id").alias("n_products"),
        exact_sum("sales").cast("double").alias("revenue"),
    )


def _summaries(df, name, cases):
    """The summary of several filters in one pass, a row for each.

    Distinct ids are counted as bits of 64 neighbouring numbers, so a task holds a row per 64 ids and never the rows themselves.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("id")) for n, c in enumerate(("customer_id", "product_id"))])
    rows = df.select("sales", *[c.alias(f"_c{i}") for i, c in enumerate(cases.values())], F.inline(sides))
    bit, once, sums, totals = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(F.lit(63)).cast("int")), F.col("side") == 0, [], []
    for i, case in enumerate(cases):
        hit = F.col(f"_c{i}")
        sums += [F.bit_or(F.when(hit, bit)).alias(f"_b{i}"), F.count(F.when(hit & once, 1)).alias(f"_n{i}"),
                 exact_sum(F.when(hit & once, F.col("sales"))).alias(f"_s{i}")]
        found = [F.coalesce(F.sum(F.when(F.col("side") == n, F.bit_count(f"_b{i}"))), F.lit(0)).cast("long") for n in (0, 1)]
        totals.append(F.struct(F.lit(case).alias(name), F.sum(f"_n{i}").alias("n_rows"), found[0].alias("n_customers"), found[1].alias("n_products"),
                               F.sum(f"_s{i}").cast("double").alias("revenue")))
    blocks = rows.groupBy("side", F.shiftright("id", 6).alias("block")).agg(*sums)
    return blocks.agg(F.array(*totals).alias("all")).select(F.inline("all"))


_SUM = f"""count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
  count(DISTINCT product_id) AS n_products, CAST({msum('sales')} AS DOUBLE) AS revenue"""


def _by_customer(df):
    return df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("sales").cast("double").alias("revenue"))


_BY_CUST = f"customer_id, count(*) AS n_rows, CAST({msum('sales')} AS DOUBLE) AS revenue"

_SPEC = DatasetSpec(
    primary="tx",
    joins=(JoinSpec("products", "product_id"),),
    columns={"tx": ("customer_id", "product_id", "sales", "ts"), "products": ("product_id", "name", "category")},
    aliases={"products_name": "title"},
)


@query("select_columns", f"""WITH {TX}, {PRODUCTS}
SELECT tx.customer_id, tx.product_id, tx.sales, CAST(tx.ts AS DATE) AS ts, p.product_id AS products_product_id,
       p.name AS title, p.category
FROM tx LEFT JOIN products p ON tx.product_id = p.product_id""")
def select_columns(t):
    df = _SPEC.to_df({"tx": transactions(t), "products": products(t)})
    return df.withColumn("ts", F.to_date("ts"))


@query("role_rename", f"""WITH {TX}
SELECT customer_id AS user_id, product_id, sales AS revenue FROM tx""")
def role_rename(t):
    spec = DatasetSpec(primary="tx", columns={"tx": ("customer_id", "product_id", "sales")},
                       roles={"user_id": "customer_id", "product_id": "product_id", "revenue": "sales"})
    return spec.to_df({"tx": transactions(t)}, for_analysis=True)


@query("filter_rolling_days", f"""WITH {TX}
SELECT {_BY_CUST} FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 90 DAY GROUP BY customer_id""")
def filter_rolling_days(t):
    return _by_customer(f.rolling_days(transactions(t), "ts", 90))


@query("filter_start_date", f"""WITH {TX}
SELECT {_BY_CUST} FROM tx WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY customer_id""")
def filter_start_date(t):
    return _by_customer(f.start_date(transactions(t), "ts", "2000-01-01"))


@query("filter_category", f"""WITH {TX}
SELECT 'include' AS mode, {_SUM} FROM tx WHERE priority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT 'exclude' AS mode, {_SUM} FROM tx WHERE priority NOT IN ('1-URGENT', '2-HIGH')""")
def filter_category(t):
    picked = ["1-URGENT", "2-HIGH"]
    return _summaries(transactions(t), "mode", {
        mode: f.category_condition("priority", picked, exclude=mode == "exclude") for mode in ("include", "exclude")})


@query("filter_numeric", f"""WITH {TX}
SELECT 'range' AS op, {_SUM} FROM tx WHERE quantity >= 10 AND quantity <= 20
UNION ALL SELECT 'gt' AS op, {_SUM} FROM tx WHERE sales > 50000
UNION ALL SELECT 'lt' AS op, {_SUM} FROM tx WHERE sales < 2000
UNION ALL SELECT 'eq' AS op, {_SUM} FROM tx WHERE quantity = 7
UNION ALL SELECT 'ne' AS op, {_SUM} FROM tx WHERE quantity <> 7 OR quantity IS NULL""")
def filter_numeric(t):
    return _summaries(transactions(t), "op", {
        "range": f.numeric_condition("quantity", "range", low=10, high=20),
        "gt": f.numeric_condition("sales", "gt", value=50000),
        "lt": f.numeric_condition("sales", "lt", value=2000),
        "eq": f.numeric_condition("quantity", "eq", value=7),
        "ne": f.numeric_condition("quantity", "ne", value=7, include_nulls=True),
    })


@query("filter_date_relative", f"""WITH {TX}
SELECT {_BY_CUST} FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 30 DAY GROUP BY customer_id""")
def filter_date_relative(t):
    return _by_customer(f.date_relative(transactions(t), "ts", 30))


@query("filter_date_fixed", f"""WITH {TX}
SELECT {_BY_CUST} FROM tx WHERE ts >= TIMESTAMP '1999-03-01' AND ts <= TIMESTAMP '1999-06-30'
GROUP BY customer_id""")
def filter_date_fixed(t):
    return _by_customer(f.date_fixed(transactions(t), "ts", "1999-03-01", "1999-06-30"))


def _top_sql(entity: str, share: str) -> str:
    return f"""WITH {TX}, totals AS (SELECT {entity}, {msum('sales')} AS total FROM tx GROUP BY {entity}),
run AS (SELECT *, SUM(total) OVER (ORDER BY total DESC) AS running, SUM(total) OVER () AS grand FROM totals),
kept AS (SELECT {entity} FROM run
  WHERE CAST(running AS DOUBLE) <= CAST(grand AS DOUBLE) * {share}
     OR CAST(running - total AS DOUBLE) < CAST(grand AS DOUBLE) * {share})
SELECT {entity}, count(*) AS n_rows, CAST({msum('sales')} AS DOUBLE) AS revenue
FROM tx WHERE {entity} IN (SELECT {entity} FROM kept) GROUP BY {entity}"""


@query("filter_top_revenue_product", _top_sql("product_id", "0.8e0"))
def filter_top_revenue_product(t):
    return f.top_revenue(transactions(t), "product_id", "sales", 80).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("sales").cast("double").alias("revenue"))


@query("filter_top_revenue_customer", _top_sql("customer_id", "0.7e0"))
def filter_top_revenue_customer(t):
    return _by_customer(f.top_revenue(transactions(t), "customer_id", "sales", 70))


@query("filter_entity_count", f"""WITH {TX}, c AS (SELECT customer_id FROM tx GROUP BY 1 HAVING count(*) BETWEEN 30 AND 45),
p AS (SELECT product_id FROM tx GROUP BY 1 HAVING count(*) > 28)
SELECT {_BY_CUST} FROM tx WHERE customer_id IN (SELECT customer_id FROM c)
  AND product_id IN (SELECT product_id FROM p) GROUP BY customer_id""")
def filter_entity_count(t):
    tx = transactions(t)
    df = f.entity_metric(tx, "customer_id", "count", "between", low=30, high=45, base=tx)
    return _by_customer(f.entity_metric(df, "product_id", "count", "gt", value=28, base=tx))


@query("filter_entity_sum_avg", f"""WITH {TX}, c AS (SELECT customer_id FROM tx GROUP BY 1
  HAVING CAST({msum('sales')} AS DOUBLE) / count(sales) > 36000),
p AS (SELECT product_id FROM tx GROUP BY 1 HAVING CAST({msum('sales')} AS DOUBLE) > 1000000)
SELECT {_BY_CUST} FROM tx WHERE customer_id IN (SELECT customer_id FROM c)
  AND product_id IN (SELECT product_id FROM p) GROUP BY customer_id""")
def filter_entity_sum_avg(t):
    tx = transactions(t)
    df = f.entity_metric(tx, "customer_id", "avg", "gt", value=36000, amount="sales", base=tx)
    return _by_customer(f.entity_metric(df, "product_id", "sum", "gt", value=1000000, amount="sales", base=tx))


@query("filter_min_transactions", f"""WITH {TX}
SELECT {_BY_CUST} FROM tx GROUP BY customer_id HAVING count(*) >= 40""")
def filter_min_transactions(t):
    return _by_customer(f.min_transactions(transactions(t), "customer_id", 40))


@query("filter_order", f"""WITH {TX}, {PRODUCTS}, {STORES}, base AS (
  SELECT tx.*, s.city FROM tx LEFT JOIN products p ON tx.product_id = p.product_id LEFT JOIN stores s ON tx.store_id = s.store_id
  WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 365 DAY AND priority <> '5-LOW' AND quantity >= 5
    AND city IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7', 'NATION_9', 'NATION_11') AND category NOT IN ('PROMO')),
totals AS (SELECT product_id, {msum('sales')} AS total FROM base GROUP BY 1),
run AS (SELECT *, SUM(total) OVER (ORDER BY total DESC) AS running, SUM(total) OVER () AS grand FROM totals),
kept AS (SELECT product_id FROM run WHERE CAST(running AS DOUBLE) <= CAST(grand AS DOUBLE) * 0.8e0
     OR CAST(running - total AS DOUBLE) < CAST(grand AS DOUBLE) * 0.8e0),
active AS (SELECT customer_id FROM base GROUP BY 1 HAVING count(*) >= 2)
SELECT {_BY_CUST} FROM base WHERE product_id IN (SELECT product_id FROM kept)
  AND customer_id IN (SELECT customer_id FROM active) GROUP BY customer_id""")
def filter_order(t):
    """Date, category and numeric filters on the joined tables, then the top products and the active customers among them."""
    spec = DatasetSpec(
        primary="tx", timestamp="ts", rolling_days=365,
        joins=(JoinSpec("products", "product_id"), JoinSpec("stores", "store_id")),
        categories=({"column": "priority", "values": ["5-LOW"], "exclude": True},
                    {"column": "stores.city", "values": [f"NATION_{i}" for i in (1, 3, 5, 7, 9, 11)]},
                    {"column": "products.category", "values": ["PROMO"], "exclude": True}),
        numerics=({"column": "quantity", "op": "range", "low": 5},),
        top_revenue=({"entity": "product_id", "amount": "sales", "percent": 80},),
        entity_metrics=({"entity": "customer_id", "metric": "count", "op": "between", "low": 2},),
        columns={"tx": ("customer_id", "product_id", "sales")},
    )
    return _by_customer(spec.to_df({"tx": transactions(t), "products": products(t), "stores": stores(t)}))


@query("dataset_export", f"""WITH {TX}, {PRODUCTS}
SELECT tx.customer_id, CAST(epoch(tx.ts) AS BIGINT) AS ts, coalesce(p.name, '') AS name, coalesce(p.size, 0) AS size
FROM tx LEFT JOIN (SELECT * FROM products WHERE category <> 'LARGE') p ON tx.product_id = p.product_id
WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 30 DAY""")
def dataset_export(t):
    spec = DatasetSpec(primary="tx", timestamp="ts", rolling_days=30, joins=(JoinSpec("products", "product_id"),),
                       columns={"tx": ("customer_id", "ts"), "products": ("name", "size")})
    some = products(t).where(F.col("category") != "LARGE")
    return spec.to_df({"tx": transactions(t), "products": some}, for_export=True)


@query("filter_topn_rank", f"""WITH {TX}
SELECT product_id, {r('total', 2)} AS revenue, rank_no FROM (
  SELECT product_id, total, ROW_NUMBER() OVER (ORDER BY total DESC, product_id) AS rank_no
  FROM (SELECT product_id, {msum('sales')} AS total FROM tx GROUP BY 1)) WHERE rank_no <= 500""")
def filter_topn_rank(t):
    from pyspark.sql import Window

    top = f.top_n_entities(transactions(t), "product_id", "sales", 500)
    # The limit bounds what this window sees.
    rank = F.row_number().over(Window.orderBy(F.col("total").desc(), F.col("product_id")))
    return top.select("product_id", rounded(F.col("total"), 2).alias("revenue"), rank.alias("rank_no"))


@query("filter_min_distinct_products", f"""WITH {TX}, top AS (
  SELECT product_id FROM tx GROUP BY 1 ORDER BY {msum('sales')} DESC, product_id LIMIT 500),
act AS (SELECT customer_id FROM tx WHERE product_id IN (SELECT product_id FROM top) GROUP BY 1
        HAVING count(DISTINCT product_id) > 10)
SELECT {_BY_CUST} FROM tx WHERE customer_id IN (SELECT customer_id FROM act) GROUP BY customer_id""")
def filter_min_distinct_products(t):
    tx = transactions(t)
    top = f.top_n_entities(tx, "product_id", "sales", 500)
    return _by_customer(f.min_distinct_products(tx, "customer_id", "product_id", 10, among=top))


@query("search_category_values", """SELECT p_name AS value, count(*) AS n FROM part
WHERE contains(lower(p_name), 'ri') GROUP BY p_name ORDER BY n DESC, value LIMIT 20""")
def search_category_values(t):
    return f.search_values(t.part, "p_name", "RI")


@query("where_region", f"""WITH {TX}, {STORES}
SELECT customer_id, product_id, store_id, sales FROM tx JOIN stores USING (store_id) WHERE city = 'NATION_3'""")
def where_region(t):
    shops = stores(t).where(F.col("city") == "NATION_3")
    return transactions(t).join(shops, "store_id").select("customer_id", "product_id", "store_id", "sales")
