from tillwork.catalog import query
from tillwork.catalog.sqltext import TX, bucket
from tillwork.operators import sampling as s
from tillwork.operators import splits
from tillwork.plans.transactions import transactions

_KEY = ["order_id", "line_no", "product_id", "store_id"]
_KEY_SQL = "concat_ws('|', order_id, line_no, product_id, store_id)"


def _hash(text: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"


@query("preview_limit", f"""WITH {TX}
SELECT order_id::VARCHAR AS order_id, line_no::VARCHAR AS line_no, product_id::VARCHAR AS product_id,
  customer_id::VARCHAR AS customer_id, sales::VARCHAR AS sales, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM (
  SELECT * FROM tx ORDER BY order_id, line_no, product_id, store_id, sales LIMIT 100)""")
def preview_limit(t):
    return s.preview(transactions(t), [*_KEY, "sales"], 100).select(
        "order_id", "line_no", "product_id", "customer_id", "sales", "ts")


@query("random_sample", f"""WITH {TX}
SELECT order_id, line_no, product_id, store_id, sales FROM tx
ORDER BY md5(concat('7:', {_KEY_SQL})), order_id, line_no, product_id, store_id LIMIT 500""")
def random_sample(t):
    return s.random_rows(transactions(t), _KEY, 500, seed="7").select(*_KEY, "sales")


@query("seeded_join_sample", f"""WITH {TX}, sample AS (
  SELECT * FROM tx ORDER BY md5(concat('7:', {_KEY_SQL})), order_id, line_no, product_id, store_id LIMIT 500),
keys AS (SELECT DISTINCT product_id FROM sample)
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT product_id FROM keys)
ORDER BY md5(concat('7:', p_partkey)), p_partkey LIMIT 200""")
def seeded_join_sample(t):
    primary = s.random_rows(transactions(t), _KEY, 500, seed="7")
    out = s.join_key_sample(primary, t.part, "product_id", "p_partkey", ["p_partkey"], 200, seed="7")
    return out.select("p_partkey", "p_name")


@query("percent_sample", f"""WITH {TX}, held AS (SELECT * FROM tx
  WHERE ts < CAST((SELECT max(ts)::DATE FROM tx) - 29 AS TIMESTAMP))
SELECT order_id, line_no, product_id, store_id, sales FROM held
WHERE {_hash(f"concat('7:', {_KEY_SQL})")} < {int(0.25 * (1 << 32))}""")
def percent_sample(t):
    held = splits.split_output(splits.last_days(transactions(t), "ts", 30), "train")
    return s.share_of_rows(held, _KEY, 0.25, seed="7").select(*_KEY, "sales")


@query("hash_sample_customers", f"""WITH {TX}
SELECT customer_id, product_id, order_id, line_no, sales FROM tx WHERE {bucket('customer_id', 100)} < 10""")
def hash_sample_customers(t):
    return s.share_of_entities(transactions(t), "customer_id", 10).select(
        "customer_id", "product_id", "order_id", "line_no", "sales")


@query("distinct_pairs", f"WITH {TX} SELECT DISTINCT customer_id, product_id FROM tx")
def distinct_pairs(t):
    return transactions(t).select("customer_id", "product_id").distinct()
