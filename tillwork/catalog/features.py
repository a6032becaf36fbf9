from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import TX, bucket, r
from tillwork.functions.numbers import rounded
from tillwork.functions.times import PERIOD_DAYS, cyclical, epoch_seconds
from tillwork.operators import features as f
from tillwork.operators import rolling, splits
from tillwork.plans.feature_model import FeatureSpec
from tillwork.plans.transactions import transactions
from tillwork.session import pin

_ROWS = ["order_id", "line_no", "product_id", "store_id", "sales"]
_ROW = ", ".join(_ROWS)

_SPLIT = f"""sp AS (SELECT *, CASE WHEN ts >= CAST((SELECT max(ts)::DATE FROM tx) - 29 AS TIMESTAMP) THEN 'test'
  WHEN {bucket('CAST(epoch(ts) AS BIGINT)', 100)} < 80 THEN 'train' ELSE 'eval' END AS split FROM tx),
fit AS (SELECT * FROM sp WHERE split <> 'test')"""


def _split(t):
    return splits.time_holdout(transactions(t), "ts", 30)


def _written_split(t, *columns):
    """The split of lines that are joined and written once, so that fitting, the cut of time and the rows themselves read the same files."""
    lines = pin(transactions(t).select(*dict.fromkeys([*_ROWS, *columns, "ts"])), "lines")
    return splits.time_holdout(lines, "ts", 30)


def _fit(t):
    return _split(t).where(F.col("split") != "test")


_VOCAB = """vocab AS (SELECT token, n, idx FROM (SELECT token, n, ROW_NUMBER() OVER (ORDER BY n DESC, token) - 1 AS idx FROM (
  SELECT coalesce(CAST(customer_id AS VARCHAR), '') AS token, count(*) AS n FROM fit GROUP BY 1 HAVING count(*) >= 30)))"""


@query("vocabulary", f"""WITH {TX}, {_SPLIT}, {_VOCAB} SELECT token, n, idx FROM vocab""")
def vocabulary(t):
    return f.fit_vocabulary(_fit(t), "customer_id", min_count=30)


@query("vocabulary_apply", f"""WITH {TX}, {_SPLIT}, {_VOCAB}
SELECT {_ROW}, customer_id, coalesce(idx, (SELECT count(*) FROM vocab)) AS customer_idx
FROM sp LEFT JOIN vocab ON token = CAST(customer_id AS VARCHAR)""")
def vocabulary_apply(t):
    vocab = f.fit_vocabulary(_fit(t), "customer_id", min_count=30)
    return f.apply_vocabulary(_split(t), "customer_id", vocab, "customer_idx").select(
        *_ROWS, "customer_id", "customer_idx")


_SORTED = """sv AS (SELECT value, ROW_NUMBER() OVER (ORDER BY value) AS idx FROM (
  SELECT DISTINCT product_id AS value FROM fit))"""


def _products_seen(t):
    return f.fit_sorted_vocabulary(_fit(t), "product_id")


@query("vocabulary_sorted", f"""WITH {TX}, {_SPLIT}, {_SORTED}
SELECT {_ROW}, coalesce(idx, 0) AS product_idx FROM sp LEFT JOIN sv ON value = product_id""")
def vocabulary_sorted(t):
    return f.apply_sorted_vocabulary(_split(t), "product_id", _products_seen(t), "product_idx").select(*_ROWS, "product_idx")


@query("zscore", f"""WITH {TX}, {_SPLIT}, m AS (SELECT avg(sales) AS m, stddev_pop(sales) AS s, avg(quantity) AS qm,
  stddev_samp(quantity) + 1e-8 AS qs FROM fit)
SELECT {_ROW}, {r('(sales - m) / s', 6)} AS sales_z, {r('(quantity - qm) / qs', 6)} AS quantity_z FROM sp, m""")
def zscore(t):
    rows = _written_split(t, "quantity")
    fit = rows.where(F.col("split") != "test")
    pop, smp = f.fit_moments(fit, ["sales"]), f.fit_moments(fit, ["quantity"], null_as_zero=False, sample=True)
    return rows.select(
        *_ROWS, rounded(f.zscore("sales", pop["sales"]), 6).alias("sales_z"),
        rounded(f.zscore("quantity", smp["quantity"], null_as_zero=False), 6).alias("quantity_z"))


@query("minmax_scale", f"""WITH {TX}, {_SPLIT}, m AS (SELECT min(sales) AS lo, max(sales) AS hi FROM fit)
SELECT {_ROW}, {r('(sales - lo) / (hi - lo)', 6)} AS sales_01 FROM sp, m""")
def minmax_scale(t):
    return _split(t).select(*_ROWS, rounded(f.minmax(F.col("sales"), f.fit_range(_fit(t), "sales")), 6).alias("sales_01"))


def _digitize(x: str, bounds: str) -> str:
    return f"len(list_filter({bounds}, lambda b: b <= {x}))"


_QUANTILES = ", ".join(f"quantile_cont(sales, {k}/20.0e0)" for k in range(1, 20))


@query("quantile_bucketize", f"""WITH {TX}, {_SPLIT}, q AS (SELECT [{_QUANTILES}] AS b FROM fit)
SELECT {_ROW}, {_digitize('sales', 'b')} AS sales_bucket FROM sp, q""")
def quantile_bucketize(t):
    bounds = f.fit_quantiles(_fit(t), ["sales"], 20)
    return _split(t).select(*_ROWS, f.bucket_of(F.col("sales"), bounds["sales"]).alias("sales_bucket"))


@query("linear_buckets", f"""WITH {TX}, m AS (SELECT min(sales) AS lo, max(sales) AS hi,
  min(CAST(epoch(ts) AS BIGINT))::DOUBLE AS tlo, max(CAST(epoch(ts) AS BIGINT))::DOUBLE AS thi FROM tx)
SELECT {_ROW}, CAST(greatest(0, least(1000, floor((sales - lo) / ((hi - lo) / 999)) + 1)) AS INTEGER) AS sales_bucket,
  CAST(greatest(0, least(120, floor((CAST(epoch(ts) AS BIGINT)::DOUBLE - tlo) / ((thi - tlo) / 119)) + 1)) AS INTEGER) AS time_bucket
FROM tx, m""")
def linear_buckets(t):
    tx = transactions(t).withColumn("seconds", epoch_seconds(F.col("ts")).cast("double"))
    return tx.select(
        *_ROWS, f.linear_bucket(F.col("sales"), f.fit_range(tx, "sales"), 1000).alias("sales_bucket"),
        f.linear_bucket(F.col("seconds"), f.fit_range(tx, "seconds"), 120).alias("time_bucket"))


_CLIP = "c AS (SELECT quantile_cont(sales, 0.05e0) AS lo, quantile_cont(sales, 0.95e0) AS hi FROM fit)"


@query("clip_percentile", f"""WITH {TX}, {_SPLIT}, {_CLIP}
SELECT {_ROW}, {r('least(greatest(sales, lo), hi)', 4)} AS clipped FROM sp, c""")
def clip_percentile(t):
    target = f.fit_target(_fit(t), "sales", clip_low=5, clip_high=95)
    return _split(t).select(*_ROWS, rounded(target.transform(F.col("sales")), 4).alias("clipped"))


_LOG = "ln(1e0 + greatest(least(greatest(sales, lo), hi), 0e0))"


@query("log1p_target", f"""WITH {TX}, {_SPLIT}, {_CLIP} SELECT {_ROW}, {r(_LOG, 6)} AS log_sales FROM sp, c""")
def log1p_target(t):
    target = f.fit_target(_fit(t), "sales", clip_low=5, clip_high=95, log=True)
    return _split(t).select(*_ROWS, rounded(target.transform(F.col("sales")), 6).alias("log_sales"))


@query("inverse_target", f"""WITH {TX}, {_SPLIT}, {_CLIP},
y AS (SELECT {_LOG} AS y FROM fit, c), n AS (SELECT min(y) AS a, max(y) AS b FROM y)
SELECT {_ROW}, {r(f'({_LOG} - a) / (b - a)', 6)} AS scaled, {r('least(greatest(sales, lo), hi)', 2)} AS restored
FROM sp, c, n""")
def inverse_target(t):
    target = f.fit_target(_fit(t), "sales", clip_low=5, clip_high=95, log=True, norm="minmax")
    scaled = target.transform(F.col("sales"))
    # The way back is exact up to floating-point noise; two digits settle it.
    return _split(t).select(*_ROWS, rounded(scaled, 6).alias("scaled"),
                            rounded(F.round(target.inverse(scaled), 6), 2).alias("restored"))


def _cycle_sql(name: str, seconds: str) -> str:
    days = f"({seconds})::DOUBLE / 86400e0" + (" + 4e0" if name == "weekly" else "")
    length = f"{PERIOD_DAYS[name]!r}e0"
    frac = f"((({days}) % {length}) / {length} * 2e0 * pi())"
    return f"{r(f'sin({frac})', 6)} AS {name}_sin, {r(f'cos({frac})', 6)} AS {name}_cos"


@query("cyclical_time", "SELECT event_id, " + ", ".join(_cycle_sql(n, "floor(epoch(ts))") for n in PERIOD_DAYS)
       + " FROM events")
def cyclical_time(t):
    seconds = epoch_seconds(F.col("ts"))
    cols = []
    for name in PERIOD_DAYS:
        for part, c in zip(("sin", "cos"), cyclical(seconds, name)):
            cols.append(rounded(c, 6).alias(f"{name}_{part}"))
    return t.events.select("event_id", *cols)


@query("cyclical_calendar", "SELECT event_id, " + ", ".join(
    f"{r(f'{fn}(2e0 * pi() * ({expr}) / {length})', 6)} AS {name}_{fn}"
    for name, expr, length in (
        ("weekday", "isodow(ts) - 1", "7e0"), ("month_day", "day(ts)", "31e0"),
        ("week", "(floor(epoch(ts))::DOUBLE / 86400e0 / 7e0) % 52e0", "52e0"),
        ("month", "(floor(epoch(ts))::DOUBLE / 86400e0 / 30.44e0) % 12e0", "12e0"),
        ("legacy_day", "(floor(epoch(ts))::DOUBLE / 86400e0 + 3e0) % 7e0", "7e0"),
        ("legacy_month_day", "(floor(epoch(ts))::DOUBLE / 86400e0) % 30.44e0", "30.44e0"))
    for fn in ("sin", "cos")) + " FROM events")
def cyclical_calendar(t):
    from tillwork.functions.times import calendar_cycles

    return t.events.select("event_id", *[
        rounded(c, 6).alias(name) for name, c in calendar_cycles(F.col("ts")).items()])




@query("hash_cross", f"""WITH {TX}, {_SPLIT}, q AS (SELECT [{_QUANTILES}] AS b FROM fit)
SELECT {_ROW}, {bucket("concat_ws('_x_', coalesce(priority, ''), coalesce(CAST(nullif(store_id, 3) AS VARCHAR), ''), CAST("
                       + _digitize('sales', 'b') + " AS VARCHAR))", 5000)} AS crossed FROM sp, q""")
def hash_cross(t):
    bounds = f.fit_quantiles(_fit(t), ["sales"], 20)
    parts = [F.col("priority"), F.nullif(F.col("store_id"), F.lit(3)), f.bucket_of(F.col("sales"), bounds["sales"])]
    return _split(t).select(*_ROWS, f.hash_cross(parts, 5000).alias("crossed"))


_QQ = ", ".join(f"quantile_cont(quantity, {k}/20.0e0)" for k in range(1, 20))


def _bin(x: str) -> str:
    return f"CAST(greatest(0, least(9, floor({x} * 10 / 21.0e0))) AS BIGINT)"


@query("bin_cross", f"""WITH {TX}, {_SPLIT}, q AS (SELECT [{_QUANTILES}] AS b, [{_QQ}] AS c FROM fit)
SELECT {_ROW}, ({_bin(_digitize('sales', 'b'))} * 31 + {_bin(_digitize('quantity', 'c'))}) % 100 AS crossed FROM sp, q""")
def bin_cross(t):
    bounds = f.fit_quantiles(_fit(t), ["sales", "quantity"], 20)
    a, b = (f.bucket_of(F.col(c), bounds[c]) for c in ("sales", "quantity"))
    return _split(t).select(*_ROWS, f.bin_cross(a, b, 20, 100).alias("crossed"))


_HIST = """hist AS (SELECT customer_id, list(product_id ORDER BY rn) AS h FROM (
  SELECT customer_id, product_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY max(ts) DESC, product_id) AS rn
  FROM tx GROUP BY 1, 2) WHERE rn <= 50 GROUP BY 1)"""


@query("history_encode", f"""WITH {TX}, {_SPLIT}, {_SORTED}, {_HIST},
e AS (SELECT customer_id, unnest(h) AS value, generate_subscripts(h, 1) AS pos FROM hist),
enc AS (SELECT customer_id, list(coalesce(idx, 0) ORDER BY pos) AS ids FROM e LEFT JOIN sv USING (value) GROUP BY 1)
SELECT customer_id, array_to_string(list_resize(ids, 50, 0), ',') AS ids FROM enc""")
def history_encode(t):
    hist = rolling.purchase_history(rolling.pair_last_dates(transactions(t)))
    enc = f.encode_history(hist, "customer_id", "purchase_history", _products_seen(t), 50)
    return enc.select("customer_id", F.array_join(F.col("history_ids").cast("array<string>"), ",").alias("ids"))


_DIMS = 64


@query("history_masked_mean", f"""WITH {TX}, {_HIST}, e AS (SELECT customer_id, unnest(h) AS vec_id FROM hist),
j AS (SELECT customer_id, embedding AS v FROM e JOIN embeddings USING (vec_id))
SELECT customer_id, count(*) AS n_items, """ + ", ".join(
    f"{r(f'avg(v[{i}]::DOUBLE)', 6)} AS d{i}" for i in (1, 32, 64)) + " FROM j GROUP BY 1")
def history_masked_mean(t):
    hist = rolling.purchase_history(rolling.pair_last_dates(transactions(t)))
    out = f.history_mean(hist, "customer_id", "purchase_history", t.embeddings, "vec_id", "embedding", _DIMS)
    return out.select("customer_id", "n_items", *[
        rounded(F.col("mean_vector")[i - 1], 6).alias(f"d{i}") for i in (1, 32, 64)])


@query("taste_padding_raw", f"""WITH {TX}, {_HIST}
SELECT customer_id, array_to_string(list_resize(h, 50, 0), ',') AS padded FROM hist""")
def taste_padding_raw(t):
    hist = rolling.purchase_history(rolling.pair_last_dates(transactions(t)))
    return hist.select("customer_id", F.array_join(
        f.pad_right(F.col("purchase_history"), 50).cast("array<string>"), ",").alias("padded"))


@query("regexp_extract_resource", """SELECT event_id, nullif(regexp_extract(path, '(?:services|jobs)/([^/]+)', 1), '') AS service
FROM (SELECT event_id, concat('projects/p', user_id, CASE event_type WHEN 'click' THEN '/services/' WHEN 'view' THEN '/jobs/'
  ELSE '/disks/' END, event_type, '-', user_id % 7, '/revisions/', event_id) AS path FROM events)""")
def regexp_extract_resource(t):
    kind = F.when(F.col("event_type") == "click", "/services/").when(F.col("event_type") == "view", "/jobs/") \
        .otherwise("/disks/")
    path = F.concat(F.lit("projects/p"), F.col("user_id"), kind, F.col("event_type"), F.lit("-"),
                    F.pmod(F.col("user_id"), F.lit(7)), F.lit("/revisions/"), F.col("event_id"))
    return t.events.select("event_id", f.resource_service(path).alias("service"))


@query("unnest_credits", """SELECT o_orderpriority AS service, CAST(sum(cost) + sum(coalesce(credit, 0)) AS DOUBLE) AS net FROM (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS cost,
    sum(CASE WHEN l_linenumber > 1 THEN CAST(-l_discount AS DECIMAL(28,6)) END) AS credit FROM lineitem GROUP BY 1)
JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def unnest_credits(t):
    credit = F.struct((-F.col("l_discount")).cast("decimal(28,6)").alias("amount"))
    lines = t.lineitem.select(
        "l_orderkey", F.col("l_extendedprice").alias("cost"),
        F.when(F.col("l_linenumber") > 1, F.array(credit)).otherwise(F.array().cast("array<struct<amount:decimal(28,6)>>"))
        .alias("credits"))
    rows = lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("service")).agg(
        F.sum(f.net_cost(F.col("cost"), F.col("credits"))).cast("double").alias("net"))


@query("analyze_train_eval_only", f"""WITH {TX}, {_SPLIT}, {_VOCAB}, m AS (SELECT avg(sales) AS m, stddev_pop(sales) AS s FROM fit),
q AS (SELECT [{', '.join(f'quantile_cont(quantity, {k}/10.0e0)' for k in range(1, 10))}] AS b FROM fit)
SELECT {_ROW}, split, coalesce(idx, (SELECT count(*) FROM vocab)) AS customer_id_idx, {r('(sales - m) / s', 6)} AS sales_z,
  {_digitize('quantity', 'b')} AS quantity_bucket
FROM sp LEFT JOIN vocab ON token = CAST(customer_id AS VARCHAR), m, q""")
def analyze_train_eval_only(t):
    spec = FeatureSpec(vocabulary={"customer_id": 30}, scaled=("sales",), bucketed={"quantity": 10})
    rows = _written_split(t, "quantity", "customer_id")
    model = spec.fit(rows.where(F.col("split") != "test"))
    out = model.transform(rows, keep=[*_ROWS, "split"])
    return out.withColumn("sales_z", rounded(F.col("sales_z"), 6))
