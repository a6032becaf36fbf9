from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import PRODUCTS, STORES, TX, bucket, msum, r
from tillwork.functions.times import epoch_seconds
from tillwork.operators import negatives, splits
from tillwork.plans import training_view as v
from tillwork.plans.transactions import products, stores, transactions

EXCLUDED = ("PROMO",)


def _facts(t):
    return transactions(t).withColumnRenamed("priority", "target_group")


def _segments(t):
    return t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("segment"),
                           F.col("o_orderdate").alias("updated_at"))


def _examples(t):
    return v.training_examples(_facts(t), products(t).select("product_id", "name", "brand", "category"), stores(t),
                               _segments(t), EXCLUDED)


# The whole history is checked by its own query; wide outputs show its length, newest and oldest entry.
_ENDS_SQL = "len(h) AS n_history, h[1] AS newest, h[len(h)] AS oldest"


def _ends():
    h = F.col("purchase_history")
    return [F.when(h.isNotNull(), F.size(h)).alias("n_history"), F.try_element_at(h, F.lit(1)).alias("newest"),
            F.try_element_at(h, F.lit(-1)).alias("oldest")]


def _text(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


_EXAMPLES = f"""{TX}, {PRODUCTS}, {STORES}, facts AS (SELECT *, CAST(ts AS DATE) AS day FROM tx WHERE sales > 0),
daily AS (SELECT customer_id, day, {msum('sales')} AS daily_total, count(DISTINCT product_id) AS daily_products
  FROM facts GROUP BY 1, 2),
feat AS (SELECT a.customer_id, a.day,
    CAST(coalesce(sum(b.daily_total) FILTER (WHERE b.day >= a.day - 60), 0) AS DOUBLE) AS cust_value,
    coalesce(date_diff('day', max(b.day), a.day), 0) AS days_since_last_purchase,
    count(b.day) FILTER (WHERE b.day >= a.day - 60) AS cust_order_days,
    CAST(coalesce(sum(b.daily_products) FILTER (WHERE b.day >= a.day - 60), 0) AS BIGINT) AS cust_unique_products
  FROM daily a LEFT JOIN daily b ON a.customer_id = b.customer_id AND b.day < a.day GROUP BY 1, 2),
seg AS (SELECT o_custkey AS customer_id, o_orderpriority AS segment, ROW_NUMBER() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderpriority DESC) AS rn FROM orders),
ex AS (SELECT f.customer_id, f.priority AS target_group, f.ts, f.store_id, f.product_id, f.sales, feat.cust_value,
    feat.days_since_last_purchase, feat.cust_order_days, feat.cust_unique_products, s.city, p.name, p.brand, p.category,
    seg.segment
  FROM facts f JOIN products p ON f.product_id = p.product_id AND p.category NOT IN ('PROMO')
  JOIN feat ON f.customer_id = feat.customer_id AND f.day = feat.day
  LEFT JOIN stores s ON f.store_id = s.store_id LEFT JOIN seg ON f.customer_id = seg.customer_id AND seg.rn = 1)"""


@query("training_examples", f"""WITH {_EXAMPLES}
SELECT customer_id, target_group, CAST(ts AS DATE) AS date, store_id, product_id, sales, cust_value,
  days_since_last_purchase, cust_order_days AS cust_order_days_60d, cust_unique_products AS cust_unique_products_60d,
  city, name, brand, category, segment FROM ex""")
def training_examples(t):
    return _examples(t).select(
        "customer_id", "target_group", F.to_date("ts").alias("date"), "store_id", "product_id", "sales", "cust_value",
        "days_since_last_purchase", F.col("cust_order_days").alias("cust_order_days_60d"),
        F.col("cust_unique_products").alias("cust_unique_products_60d"), "city", "name", "brand", "category", "segment")


def _top(source: str) -> str:
    return f"""totals AS (SELECT product_id, {msum('sales')} AS total FROM {source} GROUP BY 1),
run AS (SELECT *, SUM(total) OVER (ORDER BY total DESC) AS running, SUM(total) OVER () AS grand FROM totals),
top AS (SELECT product_id FROM run WHERE CAST(running AS DOUBLE) <= CAST(grand AS DOUBLE) * 0.8e0
  OR CAST(running - total AS DOUBLE) < CAST(grand AS DOUBLE) * 0.8e0)"""


def _hist(source: str) -> str:
    return f"""hist AS (SELECT customer_id, list(product_id ORDER BY rn) AS h FROM (
  SELECT customer_id, product_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY max(ts) DESC, product_id) AS rn
  FROM {source} GROUP BY 1, 2) WHERE rn <= 50 GROUP BY 1),
stats AS (SELECT product_id, count(DISTINCT customer_id) AS unique_buyers, count(*) AS order_count,
  {r(msum('sales'))} AS total_sales, {r(f"CAST({msum('sales')} AS DOUBLE) / count(sales)")} AS avg_sale,
  {r(f"percent_rank() OVER (PARTITION BY min(category) ORDER BY {msum('sales')})", 4)} AS revenue_pctile
  FROM {source} GROUP BY 1)"""


@query("split_last_day", f"""WITH {_EXAMPLES}, {_top('ex')},
cut AS (SELECT CAST(max(ts)::DATE - 29 AS TIMESTAMP) AS c FROM ex),
rows_ AS (SELECT *, CASE WHEN ts >= (SELECT c FROM cut) THEN 'test' ELSE 'train' END AS split FROM ex
  WHERE product_id IN (SELECT product_id FROM top)),
train AS (SELECT * FROM rows_ WHERE split = 'train'), {_hist('train')}
SELECT e.split, e.customer_id, e.product_id, e.sales, e.cust_value, {_ENDS_SQL},
  unique_buyers, order_count, total_sales, avg_sale, revenue_pctile
FROM rows_ e LEFT JOIN hist ON e.customer_id = hist.customer_id LEFT JOIN stats ON e.product_id = stats.product_id""")
def split_last_day(t):
    from tillwork.session import pin

    df = v.train_test_by_last_day(pin(_examples(t), "examples", "zstd"), 80, test_days=30)
    return df.select("split", "customer_id", "product_id", "sales", "cust_value",
                     *_ends(), "unique_buyers", "order_count", "total_sales", "avg_sale", "revenue_pctile")


_ROW = "order_id, line_no, product_id, store_id, sales"
_ROWS = ["order_id", "line_no", "product_id", "store_id", "sales"]


@query("split_time_holdout", f"""WITH {TX}
SELECT {_ROW}, CASE WHEN ts >= CAST((SELECT max(ts)::DATE FROM tx) - 6 AS TIMESTAMP) THEN 'test'
  WHEN {bucket('CAST(epoch(ts) AS BIGINT)', 100)} < 80 THEN 'train' ELSE 'eval' END AS split FROM tx""")
def split_time_holdout(t):
    return splits.time_holdout(transactions(t), "ts", 7).select(*_ROWS, "split")


_STRICT = f"""strict AS (SELECT *, CASE
  WHEN ts >= CAST((SELECT max(ts)::DATE FROM tx) - 29 AS TIMESTAMP) THEN 'test'
  WHEN ts >= CAST((SELECT max(ts)::DATE FROM tx) - 89 AS TIMESTAMP) THEN 'eval' ELSE 'train' END AS split
  FROM tx WHERE ts >= CAST((SELECT max(ts)::DATE FROM tx) - 454 AS TIMESTAMP))"""


@query("split_strict_time", f"WITH {TX}, {_STRICT} SELECT {_ROW}, split FROM strict")
def split_strict_time(t):
    return splits.strict_time(transactions(t), "ts", 365, 60, 30).select(*_ROWS, "split")


@query("split_random_hash", f"""WITH {TX}
SELECT {_ROW}, CASE WHEN b < 16 THEN 'train' WHEN b < 19 THEN 'eval' ELSE 'test' END AS split FROM (
  SELECT *, {bucket("concat_ws('|', order_id, line_no, product_id, store_id)", 20)} AS b FROM tx)""")
def split_random_hash(t):
    return splits.random_hash(transactions(t), _ROWS[:4]).select(*_ROWS, "split")


@query("split_outputs", f"""WITH {TX}, {_STRICT}
SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, CAST({msum('sales')} AS DOUBLE) AS revenue,
  CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM strict GROUP BY split""")
def split_outputs(t):
    from tillwork.functions.numbers import exact_sum

    df = splits.strict_time(transactions(t), "ts", 365, 60, 30)
    path = splits.write_splits(df)
    written = t.spark.read.schema(df.schema).parquet(path)
    out = None
    for name in ("train", "eval", "test"):
        one = splits.split_output(written, name).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"),
            exact_sum("sales").cast("double").alias("revenue"), F.to_date(F.min("ts")).alias("first_day"),
            F.to_date(F.max("ts")).alias("last_day")).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _walk(salt: str, pairs: str, catalog: str) -> str:
    """The walk through the catalogue that proposes negatives, in SQL."""

    def h(text: str) -> str:
        return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"

    def mixed(x: str, key: str) -> str:
        v = f"((({x}) * 40503 + {key}) % 2147483647)"
        return f"(({v} * {v} % 2147483647 * 48271 % 2147483647) // 16)"

    rounds, sides = [], ["l0", "r0"]
    for i in range(negatives.ROUNDS):
        left, right = sides
        if i % 2 == 0:
            rounds.append(f"w{i + 1} AS (SELECT *, ({left} + {mixed(right, f'k{i}')}) % a AS l{i + 1} FROM w{i})")
            sides[0] = f"l{i + 1}"
        else:
            rounds.append(f"w{i + 1} AS (SELECT *, ({right} + {mixed(left, f'k{i}')}) % b AS r{i + 1} FROM w{i})")
            sides[1] = f"r{i + 1}"
    keys = ", ".join(f"{h(f"concat('{salt}_key{i}_', customer_id)")} AS k{i}" for i in range(negatives.ROUNDS))
    return f"""places AS (SELECT product_id, ROW_NUMBER() OVER (ORDER BY product_id) AS place FROM {catalog}),
size_ AS (SELECT count(*) AS m, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS root FROM places),
grid AS (SELECT m, (m + x - 1) // x AS a, x AS b FROM size_, range(1, 100000) t(x)
  WHERE x BETWEEN greatest(1, root // 2) AND 2 * root ORDER BY (x - m % x) % x, x LIMIT 1),
bought AS (SELECT DISTINCT customer_id, product_id FROM {pairs}),
counts AS (SELECT customer_id, count(*) AS p FROM bought GROUP BY 1),
w0 AS (SELECT *, step // b AS l0, step % b AS r0 FROM (
  SELECT customer_id, p, a, b, {keys}, unnest(range(0, least(5 * p + a * b - m, a * b))) AS step FROM counts, grid)),
{", ".join(rounds)},
proposed AS (SELECT w.customer_id, pl.product_id, p, step FROM w{negatives.ROUNDS} w JOIN places pl
  ON pl.place = {sides[0]} * b + {sides[1]} + 1
  WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = w.customer_id AND b.product_id = pl.product_id)),
neg AS (SELECT customer_id, product_id, neg_rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id
  ORDER BY step) AS neg_rank FROM proposed) WHERE neg_rank <= 4 * p)"""


_SELL = "(SELECT p_partkey AS product_id FROM part WHERE p_type NOT IN ('PROMO'))"
_BASE = f"""{TX}, {PRODUCTS}, base AS (SELECT tx.* FROM tx JOIN products USING (product_id) WHERE category NOT IN ('PROMO'))"""


def _catalog(t):
    return products(t).where(~F.col("category").isin(*EXCLUDED)).select("product_id", "name", "brand", "category")


@query("negative_sampling", f"WITH {_BASE}, {_walk('train', 'base', _SELL)} SELECT customer_id, product_id, neg_rank FROM neg")
def negative_sampling(t):
    bought = transactions(t).join(_catalog(t).select("product_id"), "product_id", "left_semi")
    return negatives.sample_negatives(bought, _catalog(t), salt="train")


@query("negative_sampling_test_salt",
       f"WITH {_BASE}, {_walk('test', 'base', _SELL)} SELECT customer_id, product_id, neg_rank FROM neg")
def negative_sampling_test_salt(t):
    bought = transactions(t).join(_catalog(t).select("product_id"), "product_id", "left_semi")
    return negatives.sample_negatives(bought, _catalog(t), salt="test")


_CONTEXTS = """ctx AS (SELECT * FROM (SELECT customer_id, target_group, ts, store_id, cust_value,
    days_since_last_purchase, cust_order_days, cust_unique_products, city, segment,
    ROW_NUMBER() OVER (PARTITION BY customer_id, CAST(ts AS DATE) ORDER BY ts DESC, target_group DESC, store_id DESC) AS rn
  FROM before) WHERE rn = 1),
slots AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ts) AS slot,
  count(*) OVER (PARTITION BY customer_id) AS n FROM ctx)"""
_OUT = """customer_id, product_id, label, sales, CAST(ts AS DATE) AS day, store_id, cust_value, days_since_last_purchase,
  city, segment, category, n_history, newest, oldest, unique_buyers, order_count, total_sales, avg_sale, revenue_pctile"""
_POS_OUT = _OUT.replace("n_history, newest, oldest", "history")


def _show(df, *history):
    return df.select(
        "customer_id", "product_id", "label", "sales", F.to_date("ts").alias("day"), "store_id", "cust_value",
        "days_since_last_purchase", "city", "segment", "category", *history, "unique_buyers", "order_count",
        "total_sales", "avg_sale", "revenue_pctile")


_POS = f"""pos AS (SELECT e.customer_id, e.product_id, 1 AS label, e.sales, e.ts, e.store_id, e.cust_value,
    e.days_since_last_purchase, e.city, e.segment, e.category,
    array_to_string(list_filter(h, lambda x: x <> e.product_id), ',') AS history,
    unique_buyers, order_count, total_sales, avg_sale, revenue_pctile
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, product_id
      ORDER BY ts DESC, target_group DESC, store_id DESC, sales DESC) AS rn FROM train) e
  LEFT JOIN hist ON e.customer_id = hist.customer_id LEFT JOIN stats ON e.product_id = stats.product_id WHERE rn = 1)"""


def _neg(context: str) -> str:
    return f"""negs AS (SELECT n.customer_id, n.product_id, 0 AS label, 0.0::DOUBLE AS sales, c.ts, c.store_id,
    c.cust_value, c.days_since_last_purchase, c.city, c.segment, p.category, {_ENDS_SQL},
    unique_buyers, order_count, total_sales, avg_sale, revenue_pctile
  FROM neg n JOIN {context} JOIN sold p ON n.product_id = p.product_id
  LEFT JOIN hist ON n.customer_id = hist.customer_id LEFT JOIN stats ON n.product_id = stats.product_id)"""


_SLOT = "slots c ON n.customer_id = c.customer_id AND c.slot = 1 + (n.neg_rank - 1) % c.n"
_LATEST = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id
    ORDER BY ts DESC, target_group DESC, store_id DESC) AS rn FROM before) WHERE rn = 1) c ON n.customer_id = c.customer_id"""


# As the view defines them: the last day is held out, the best-selling 80 % of products (over all days) are the
# catalogue, and history, statistics and positives see their rows of the days before.
_VIEW = f"""{_EXAMPLES}, {_top('ex')},
before AS (SELECT * FROM ex WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM ex)),
train AS (SELECT * FROM before WHERE product_id IN (SELECT product_id FROM top)),
sold AS (SELECT product_id, category FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ts DESC) AS rn
  FROM ex WHERE product_id IN (SELECT product_id FROM top)) WHERE rn = 1), {_hist('train')}"""


@query("positives_labelled", f"WITH {_VIEW}, {_POS} SELECT {_POS_OUT} FROM pos")
def positives_labelled(t):
    return _show(v.LabelledView.of(_examples(t)).positives(), _text("purchase_history").alias("history"))


@query("negatives_point_in_time", f"""WITH {_VIEW}, {_walk('train', 'train', 'sold')}, {_CONTEXTS}, {_neg(_SLOT)}
SELECT {_OUT} FROM negs""")
def negatives_point_in_time(t):
    return _show(v.LabelledView.of(_examples(t)).negatives(), *_ends())


@query("negatives_latest_context", f"""WITH {_VIEW}, {_walk('train', 'train', 'sold')}, {_neg(_LATEST)}
SELECT {_OUT} FROM negs""")
def negatives_latest_context(t):
    return _show(v.LabelledView.of(_examples(t)).negatives(point_in_time=False), *_ends())


@query("union_pos_neg", f"""WITH {_VIEW}, {_walk('train', 'train', 'sold')}, {_CONTEXTS}, {_POS}, {_neg(_SLOT)},
both_ AS (SELECT label, customer_id, product_id, sales, ts FROM pos UNION ALL SELECT label, customer_id, product_id, sales, ts FROM negs)
SELECT label, customer_id, count(*) AS n_rows, count(DISTINCT product_id) AS n_products,
  CAST({msum('sales')} AS DOUBLE) AS revenue, CAST(min(ts) AS DATE) AS first_day FROM both_ GROUP BY 1, 2""")
def union_pos_neg(t):
    from tillwork.functions.numbers import exact_sum

    return v.LabelledView.of(_examples(t)).pairs().groupBy("label", "customer_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("product_id").alias("n_products"),
        exact_sum("sales").cast("double").alias("revenue"), F.to_date(F.min("ts")).alias("first_day"))


@query("extract_training_slice", f"""WITH {TX}, {PRODUCTS}, {STORES}, base AS (
  SELECT tx.*, s.city FROM tx JOIN stores s ON tx.store_id = s.store_id
  WHERE ts >= TIMESTAMP '1998-01-01' AND ts <= TIMESTAMP '2000-12-31' AND city IN ('NATION_1', 'NATION_3', 'NATION_8', 'NATION_15')),
top AS (SELECT product_id FROM base GROUP BY 1 ORDER BY {msum('sales')} DESC, product_id LIMIT 800),
act AS (SELECT customer_id FROM base WHERE product_id IN (SELECT product_id FROM top) GROUP BY 1
  HAVING count(DISTINCT product_id) > 2),
kept AS (SELECT * FROM base WHERE customer_id IN (SELECT customer_id FROM act)
  AND product_id IN (SELECT product_id FROM top) AND {bucket('customer_id', 100)} < 50)
SELECT k.customer_id, k.product_id, CAST(SUM(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY k.customer_id) AS DOUBLE)
  AS customer_revenue, city, CAST(epoch(ts) AS BIGINT) AS ts_seconds, coalesce(name, 'N/A') AS name,
  coalesce(brand, 'N/A') AS brand, coalesce(category, 'N/A') AS category
FROM kept k LEFT JOIN products p ON k.product_id = p.product_id""")
def extract_training_slice(t):
    cities = ["NATION_1", "NATION_3", "NATION_8", "NATION_15"]
    df = v.training_slice(transactions(t), products(t), stores(t), cities, "1998-01-01", "2000-12-31", top_n=800,
                          sample_percent=50)
    return df.select("customer_id", "product_id", "customer_revenue", "city",
                     epoch_seconds(F.col("ts")).alias("ts_seconds"), "name", "brand", "category")
