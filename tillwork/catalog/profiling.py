from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import PRODUCTS, TX, msum, pct, r
from tillwork.operators import profile as p
from tillwork.operators import rolling
from tillwork.plans.dataset_spec import DatasetSpec, JoinSpec
from tillwork.plans.transactions import products, transactions

_NULLS = {
    "distinct_count": "NULL::BIGINT", "uniqueness_pct": "NULL::DOUBLE", "max_length": "NULL::BIGINT",
    "min_length": "NULL::BIGINT", "avg_length": "NULL::DOUBLE", "min_value": "NULL::DOUBLE",
    "max_value": "NULL::DOUBLE", "mean": "NULL::DOUBLE", "stddev": "NULL::DOUBLE", "min_date": "NULL::DATE",
    "max_date": "NULL::DATE", "range_days": "NULL::BIGINT", "true_count": "NULL::BIGINT",
    "false_count": "NULL::BIGINT",
}


def _stat_sql(kind: str, c: str, source: str, label: str | None = None, date_distinct: bool = False) -> str:
    got = dict(_NULLS)
    if kind == "string":
        got |= {"distinct_count": f"count(DISTINCT {c})", "max_length": f"max(length({c}))",
                "uniqueness_pct": pct(f"count(DISTINCT {c})", "count(*)")}
    elif kind == "numeric":
        got |= {"distinct_count": f"count(DISTINCT {c})", "min_value": f"min({c})::DOUBLE",
                "max_value": f"max({c})::DOUBLE", "mean": r(f"avg({c}::DOUBLE)"), "stddev": r(f"stddev_samp({c}::DOUBLE)")}
    elif kind == "date":
        got |= {"min_date": f"min({c}::DATE)", "max_date": f"max({c}::DATE)",
                "range_days": f"date_diff('day', min({c}::DATE), max({c}::DATE))"}
        if date_distinct:
            got["distinct_count"] = f"count(DISTINCT {c})"
    elif kind == "bool":
        got |= {"true_count": f"count(*) FILTER (WHERE {c})", "false_count": f"count(*) FILTER (WHERE NOT {c})"}
    elif kind == "array":
        got |= {"avg_length": r(f"avg(len({c}))", 1), "min_length": f"min(len({c}))", "max_length": f"max(len({c}))"}
    cols = ", ".join(f"{v} AS {k}" for k, v in got.items())
    return f"""SELECT '{label or c}' AS column_name, '{kind}' AS kind, count(*) AS total_rows,
  count(*) FILTER (WHERE {c} IS NULL) AS null_count, {pct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS null_pct,
  {cols} FROM {source}"""


@query("column_stats", "WITH ev AS (SELECT *, value > 100 AS large FROM events) " + " UNION ALL ".join([
    *[_stat_sql(k, c, "ev") for k, c in (
        ("numeric", "event_id"), ("date", "ts"), ("numeric", "user_id"), ("string", "event_type"),
        ("numeric", "value"), ("string", "props"), ("bool", "large"))],
    _stat_sql("array", "embedding", "embeddings"),
]))
def column_stats(t):
    ev = t.events.withColumn("large", F.col("value") > 100)
    return p.column_stats(ev).unionByName(p.column_stats(t.embeddings, ["embedding"]))


_SPEC = DatasetSpec(
    primary="tx", timestamp="ts", rolling_days=365, joins=(JoinSpec("products", "product_id"),),
    columns={"tx": ("customer_id", "sales", "ts"), "products": ("category",)},
    aliases={"tx_customer_id": "tx_customer_id", "tx_sales": "tx_sales", "tx_ts": "tx_ts",
             "products_category": "products_category"},
)
_FILTERED = f"""{TX}, {PRODUCTS}, ds AS (SELECT customer_id AS tx_customer_id, sales AS tx_sales, ts AS tx_ts,
  category AS products_category FROM tx LEFT JOIN products ON tx.product_id = products.product_id
  WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 365 DAY)"""


@query("filtered_column_stats", f"WITH {_FILTERED} " + " UNION ALL ".join(
    _stat_sql(k, c, "ds", date_distinct=True) for k, c in (
        ("numeric", "tx_customer_id"), ("numeric", "tx_sales"), ("date", "tx_ts"), ("string", "products_category"))))
def filtered_column_stats(t):
    df = _SPEC.to_df({"tx": transactions(t), "products": products(t)})
    return p.column_stats(df, date_distinct=True, array_lengths=False)


@query("summary_rows", f"WITH {_FILTERED} SELECT count(*) AS total_rows FROM ds")
def summary_rows(t):
    return _SPEC.to_df({"tx": transactions(t), "products": products(t)}).agg(F.count(F.lit(1)).alias("total_rows"))


@query("dataset_analysis", f"""WITH {TX}, a AS (SELECT count(*) AS total_rows, count(DISTINCT customer_id) AS unique_users,
  count(DISTINCT product_id) AS unique_products FROM tx)
SELECT *, {r('total_rows::DOUBLE / unique_users')} AS rows_per_user,
  {r('total_rows::DOUBLE / unique_products')} AS rows_per_product FROM a""")
def dataset_analysis(t):
    return p.dataset_analysis(transactions(t), "customer_id", "product_id")


@query("sample_values", "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL ORDER BY md5(p_name), value LIMIT 10")
def sample_values(t):
    return p.sample_values(t.part, "p_name", 10)


def _category_sql(column, table, top=None):
    return f"""SELECT '{column}' AS column_name, value, n, {pct('n', 'total')} AS pct, rank_no FROM (
  SELECT {column}::VARCHAR AS value, count(*) AS n, sum(count(*)) OVER () AS total,
    ROW_NUMBER() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS rank_no
  FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}) {f'WHERE rank_no <= {top}' if top else ''}"""


@query("category_values", _category_sql("p_brand", "part") + " UNION ALL " + _category_sql("url", "pages", 20))
def category_values(t):
    few = p.category_values(t.part, "p_brand").withColumn("column_name", F.lit("p_brand"))
    many = p.category_values(t.pages, "url", top=20).withColumn("column_name", F.lit("url"))
    return few.unionByName(many)


def _numeric_sql(c):
    return f"""SELECT '{c}' AS column_name, CASE WHEN bool_and({c} = floor({c})) THEN 'INTEGER' ELSE 'FLOAT' END AS value_type,
  min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, {r(f'avg({c}::DOUBLE)')} AS mean,
  count(DISTINCT {c}) AS distinct_count FROM lineitem"""


@query("numeric_profile", " UNION ALL ".join(_numeric_sql(c) for c in ("l_quantity", "l_discount", "l_linenumber")))
def numeric_profile(t):
    return p.numeric_profile(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"])


def _date_sql(table, c):
    return f"""SELECT '{c}' AS column_name,
  CASE WHEN bool_and({c} = date_trunc('day', {c})) THEN 'DATE' ELSE 'TIMESTAMP' END AS value_type,
  min({c})::DATE AS min_date, max({c})::DATE AS max_date, count(DISTINCT {c}) AS distinct_count FROM {table}"""


@query("date_profile", _date_sql("orders", "o_orderdate") + " UNION ALL " + _date_sql("events", "ts"))
def date_profile(t):
    return p.date_profile(t.orders, ["o_orderdate"]).unionByName(p.date_profile(t.events, ["ts"]))


_SHARES = ", ".join(
    f"CAST(floor(quantile_cont(n, {q})) AS BIGINT) AS {name}"
    for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)))


@query("customer_txn_distribution", f"""WITH {TX}, c AS (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1)
SELECT count(*) AS customers, CAST(sum(n) AS BIGINT) AS transactions, min(n) AS min_n, max(n) AS max_n,
  {r('sum(n)::DOUBLE / count(*)')} AS mean_n, {_SHARES} FROM c""")
def customer_txn_distribution(t):
    return p.transaction_distribution(transactions(t), "customer_id")[0]


@query("customer_txn_histogram", f"""WITH {TX}, c AS (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1)
SELECT n, count(*) AS customers, {pct('count(*)', '(SELECT count(*) FROM c)')} AS customer_pct
FROM c GROUP BY n""")
def customer_txn_histogram(t):
    return p.transaction_distribution(transactions(t), "customer_id")[1]


_SPEND = ", ".join(
    f"{r(f'quantile_cont(CAST(spend AS DOUBLE), {q})')} AS {name}"
    for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)))


@query("customer_spend_distribution", f"""WITH {TX}, c AS (SELECT customer_id, {msum('sales')} AS spend FROM tx GROUP BY 1
  HAVING {msum('sales')} > 0)
SELECT count(*) AS customers, {r('sum(spend)')} AS total_spend, {r('min(spend)')} AS min_spend,
  {r('max(spend)')} AS max_spend, {r('CAST(sum(spend) AS DOUBLE) / count(*)')} AS mean_spend, {_SPEND} FROM c""")
def customer_spend_distribution(t):
    return p.spend_distribution(transactions(t), "customer_id", "sales")


_NUM, _STR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus")


def _feature_sql(c, table="lineitem"):
    return f"""SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS missing,
  {pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct, {r(f'avg({c})', 4)} AS mean,
  {r(f'stddev_pop({c})', 4)} AS std_dev, count(*) FILTER (WHERE {c} = 0) AS zeros,
  {pct(f'count(*) FILTER (WHERE {c} = 0)', f'count({c})')} AS zeros_pct, min({c}) AS min_value, max({c}) AS max_value,
  {r(f'median({c})', 4)} AS median FROM {table}"""


@query("data_statistics", " UNION ALL ".join(_feature_sql(c) for c in _NUM))
def data_statistics(t):
    return p.numeric_statistics(t.lineitem, _NUM)


def _histogram_sql(c):
    w = f"((hi - lo) / 10.0e0)"
    return f"""SELECT '{c}' AS feature, bucket, {r(f'(lo + {w} * bucket)', 4)} AS low,
  {r(f'(lo + {w} * (bucket + 1))', 4)} AS high, count(*) AS n FROM (
  SELECT lo, hi, CAST(least(floor(({c} - lo) / {w}), 9) AS INTEGER) AS bucket
  FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)) GROUP BY bucket, lo, hi"""


@query("data_statistics_histogram", " UNION ALL ".join(_histogram_sql(c) for c in _NUM))
def data_statistics_histogram(t):
    return p.numeric_histogram(t.lineitem, _NUM)


def _string_sql(c, table, binary=False):
    length = f"avg(octet_length(encode({c})))" if binary else f"avg(length({c}))"
    return f"""SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS missing,
  {pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct, count(DISTINCT {c}) AS unique_values,
  {r(length, 4)} AS avg_length FROM {table}"""


@query("data_statistics_strings", " UNION ALL ".join(
    [_string_sql("text", "documents"), _string_sql("lang", "documents"), _string_sql("source", "documents"),
     _string_sql("html", "pages", binary=True)]))
def data_statistics_strings(t):
    raw = t.pages.select(F.col("html").cast("binary").alias("html"))
    return p.string_statistics(t.documents, ["text", "lang", "source"]).unionByName(
        p.string_statistics(raw, ["html"]))


def _top_sql(c, table):
    return f"""SELECT '{c}' AS feature, rank_no, value, n, {pct('n', 'total')} AS pct FROM (
  SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER () AS total,
    ROW_NUMBER() OVER (ORDER BY count(*) DESC, {c}) AS rank_no FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})
  WHERE rank_no <= 10"""


@query("data_statistics_top_values", " UNION ALL ".join(_top_sql(c, "documents") for c in ("lang", "source", "text")))
def data_statistics_top_values(t):
    return p.top_values(t.documents, ["lang", "source", "text"])


@query("data_statistics_missing", """SELECT count(*) AS n_rows, 2 AS n_features,
  """ + r("(" + r("(count(*) FILTER (WHERE q IS NULL)) * 100e0 / count(*)", 8) + " + "
          + r("(count(*) FILTER (WHERE doc_id IS NULL)) * 100e0 / count(*)", 8) + ") / 2.0e0") + """ AS avg_missing_pct
FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def data_statistics_missing(t):
    df = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").alias("q")), "doc_id", "left")
    return p.average_missing(df)


@query("schema_report", """WITH d AS (SELECT d.doc_id, d.lang, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, '{ty}' AS value_type,
  CASE WHEN count({c}) = count(*) THEN 'required' ELSE 'optional' END AS need,
  {r(f'count({c})::DOUBLE / count(*)', 4)} AS presence, {dom} AS domain FROM d""" for c, ty, dom in (
    ("doc_id", "INT", "NULL::VARCHAR"),
    ("lang", "STRING", "CASE WHEN count(DISTINCT lang) <= 20 THEN string_agg(DISTINCT lang, '|' ORDER BY lang) END"),
    ("text", "STRING", "CASE WHEN count(DISTINCT text) <= 20 THEN string_agg(DISTINCT text, '|' ORDER BY text) END"),
    ("quality", "INT", "NULL::VARCHAR"))))
def schema_report(t):
    df = t.documents.select("doc_id", "lang", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return p.schema_report(df, domain_up_to=20)


@query("product_stats", f"""WITH {TX}
SELECT product_id, count(DISTINCT customer_id) AS unique_buyers, count(*) AS order_count, {r(msum('sales'))} AS total_sales,
  {r(f"CAST({msum('sales')} AS DOUBLE) / count(sales)")} AS avg_sale FROM tx GROUP BY product_id""")
def product_stats(t):
    return rolling.product_stats(transactions(t))


@query("daily_customer_totals", f"""WITH {TX}
SELECT customer_id, CAST(ts AS DATE) AS day, CAST({msum('sales')} AS DOUBLE) AS daily_total,
  count(DISTINCT product_id) AS daily_products FROM tx GROUP BY 1, 2""")
def daily_customer_totals(t):
    return rolling.daily_totals(transactions(t)).withColumn("daily_total", F.col("daily_total").cast("double"))


@query("pair_last_date", f"""WITH {TX}
SELECT customer_id, product_id, CAST(max(ts) AS DATE) AS last_day FROM tx GROUP BY 1, 2""")
def pair_last_date(t):
    return rolling.pair_last_dates(transactions(t)).select(
        "customer_id", "product_id", F.to_date("last_ts").alias("last_day"))
