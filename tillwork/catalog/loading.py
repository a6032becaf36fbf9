import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.catalog import query
from tillwork.catalog.sqltext import bucket, msum
from tillwork.functions.numbers import exact_sum
from tillwork.session import fresh_path
from tillwork.sources import files, loads, sliced, tables
from tillwork.streaming import incremental

_LINE_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
_LINES = ", ".join(_LINE_COLS)


def _schema(df):
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


@query("scan_csv", f"SELECT {_LINES} FROM lineitem")
def scan_csv(t):
    rows, path = t.lineitem.select(*_LINE_COLS), fresh_path(t.spark, "csv")
    rows.write.csv(path, header=True, sep=";")
    return files.read_csv(t.spark, path, _schema(rows), sep=";")


def _dirty_lines(t):
    kind = F.col("event_type")
    fields = [F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind, F.col("value").cast("string")]
    line = F.when(kind == "error", F.concat_ws(",", *fields, F.lit("surplus"))) \
        .when(kind == "signup", F.concat_ws(",", *fields[:3])) \
        .when(kind == "click", F.concat_ws(",", fields[0], fields[1], kind, F.lit("not a number"))) \
        .when(kind == "view", F.concat_ws(",", fields[0], fields[1], F.lit(""), fields[3])) \
        .otherwise(F.concat_ws(",", *fields))
    path = fresh_path(t.spark, "dirty-csv")
    t.events.select(line.alias("value")).write.text(path)
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("event_type", "string").add("value", "double")
    return files.read_csv_split(t.spark, path, schema, header=False)


@query("scan_csv_reject", """SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type, value
FROM events WHERE event_type IN ('view', 'purchase')""")
def scan_csv_reject(t):
    return _dirty_lines(t)[0]


@query("scan_csv_reject_lines", """SELECT CAST(event_id AS VARCHAR) AS event_id, concat_ws(',', event_id, user_id, event_type,
  CASE event_type WHEN 'error' THEN concat(CAST(value AS VARCHAR), ',surplus') WHEN 'click' THEN 'not a number' END) AS line
FROM events WHERE event_type IN ('error', 'signup', 'click')""")
def scan_csv_reject_lines(t):
    return _dirty_lines(t)[1].select("event_id", F.col(files.REJECTED).alias("line"))


@query("scan_parquet", f"SELECT {_LINES} FROM lineitem")
def scan_parquet(t):
    return files.read_parquet(t.spark, f"{t.root}/lineitem.parquet", _LINE_COLS)


_EVENT_COLS = ["event_id", "user_id", "event_type", "value"]


@query("scan_json", """SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'""")
def scan_json(t):
    rows, path = t.events.select(*_EVENT_COLS), fresh_path(t.spark, "json")
    text = F.to_json(F.struct(*_EVENT_COLS))
    rows.select(F.when(F.col("event_type") == "error", F.concat(text, F.lit("}}"), F.lit("{"))).otherwise(text)
                .alias("value")).select(F.when(F.col("value").endswith("}}{"), F.regexp_replace("value", "\\}.*$", ""))
                                        .otherwise(F.col("value")).alias("value")).write.text(path)
    return files.read_json_split(t.spark, path, _schema(rows))[0]


@query("scan_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json_array(t):
    """One JSON array per region, as single documents."""
    path = fresh_path(t.spark, "json-array")
    docs = t.nation.groupBy("n_regionkey").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value"))
    docs.select("value").repartition(8, "value").write.text(path)
    return files.read_json(t.spark, path, _schema(t.nation), multiline=True)


@query("scan_table_full", f"SELECT {_LINES} FROM lineitem")
def scan_table_full(t):
    return tables.read_table(t.spark, f"{t.root}/lineitem.parquet", _LINE_COLS)


@query("scan_table_incremental", """SELECT 'inclusive' AS mode, o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'
UNION ALL SELECT 'strict', o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01'""")
def scan_table_incremental(t):
    out = None
    for mode in ("inclusive", "strict"):
        one = tables.since(t.orders, "o_orderdate", "2001-06-01", strict=mode == "strict").select(
            F.lit(mode).alias("mode"), "o_orderkey", "o_custkey")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_documents", """SELECT CAST(event_id AS VARCHAR) AS document_id, '2024-02-01T00:00:00' AS _extracted_at, event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, to_json({'user': user_id, 'deep': {'value': value}})::VARCHAR AS body,
  to_json([event_type, CAST(user_id AS VARCHAR)])::VARCHAR AS tags, NULL::VARCHAR AS nickname FROM events""")
def scan_documents(t):
    docs = t.events.select(
        "event_id", "event_type", "ts",
        F.struct(F.col("user_id").alias("user"), F.struct(F.col("value")).alias("deep")).alias("body"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"))
    return tables.flatten_documents(docs, "event_id", F.lit("2024-02-01T00:00:00"),
                                    ["event_type", "ts", "body", "tags", "nickname"])


@query("partitioned_read_date", """SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS slice_start, count(*) AS n_rows,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1""")
def partitioned_read_date(t):
    span = t.events.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b")).first()
    plan = tables.TimeSlices(span["a"], span["b"] + dt.timedelta(microseconds=1), seconds=3600)
    sliced = t.events.withColumn("slice_start", plan.start_of(F.col("ts")))
    return sliced.groupBy(F.date_format("slice_start", "yyyy-MM-dd HH:mm:ss").alias("slice_start")).agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("value").cast("double").alias("total"))


@query("partitioned_read_hash", f"""WITH n AS (SELECT greatest(1, count(*) // 5000) AS slices FROM lineitem)
SELECT {bucket('l_orderkey', '(SELECT slices FROM n)')} AS slice, count(*) AS n_rows,
  CAST({msum('l_extendedprice')} AS DOUBLE) AS total FROM lineitem GROUP BY 1""")
def partitioned_read_hash(t):
    slices = tables.hash_slices(t.lineitem.count(), target=5000)
    return t.lineitem.groupBy(tables.hash_slice(F.col("l_orderkey"), slices).alias("slice")).agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("l_extendedprice").cast("double").alias("total"))


# Slices that are read: a partition of the scan is a run of them.
@query("sliced_read_time", f"""WITH s AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) + INTERVAL 1 MICROSECOND AS b, count(*) AS n FROM events),
w AS (SELECT a, 86400 // least(86400, greatest(1, CAST(ceil(floor(n / (1 + (epoch_us(b) - epoch_us(a)) // 86400000000)) / 100) AS BIGINT))) AS secs FROM s)
SELECT CAST((epoch_us(ts) - epoch_us(a)) // (secs * 1000000) AS INT) AS slice, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_at,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_at, CAST({msum('value')} AS DOUBLE) AS total FROM events, w GROUP BY 1""")
def sliced_read_time(t):
    rows = sliced.read_time_slices(t.spark, f"{t.root}/events.parquet", "ts", ["ts", "value"], target=100, number="slice")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_rows"), at(F.min("ts")).alias("first_at"), at(F.max("ts")).alias("last_at"), exact_sum("value").cast("double").alias("total"))


@query("sliced_read_number", f"""WITH s AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b, count(*) AS c FROM lineitem),
w AS (SELECT *, greatest(1, least(b - a + 1, c // 5000)) AS n FROM s)
SELECT CAST(slice AS INT) AS slice, count(*) AS n_rows, CAST({msum('l_extendedprice')} AS DOUBLE) AS total
FROM lineitem, (SELECT a + (b + 1 - a) * i // n AS low, a + (b + 1 - a) * (i + 1) // n AS high, i AS slice FROM (SELECT *, unnest(range(n)) AS i FROM w))
WHERE l_orderkey >= low AND l_orderkey < high GROUP BY 1""")
def sliced_read_number(t):
    rows = sliced.read_number_slices(t.spark, f"{t.root}/lineitem.parquet", "l_orderkey", ["l_extendedprice"], target=5000, number="slice")
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n_rows"), exact_sum("l_extendedprice").cast("double").alias("total"))


@query("sliced_read_hash", f"""SELECT {bucket('c_name', 7)}::INT AS slice, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1""")
def sliced_read_hash(t):
    """A text key: the table is laid out by bucket once, then each slice reads its own files."""
    path = sliced.lay_out_by_hash(t.customer, "c_name", 7)
    return sliced.read_hash_slices(t.spark, path, 7).groupBy(F.spark_partition_id().alias("slice")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("total"))


_FILES = """files AS (SELECT concat(source, '/', doc_id) AS path, n_chars AS size,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS modified FROM documents),
registry AS (SELECT concat(d.source, '/', d.doc_id) AS path, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS size,
  TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE + CASE WHEN toxic = 1 THEN INTERVAL 2 SECOND
    ELSE INTERVAL 500 MILLISECOND END AS modified
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'de'),
state AS (SELECT f.path, f.size, f.modified, CASE WHEN r.path IS NULL THEN 'new' WHEN f.size <> r.size THEN 'resized'
  WHEN abs(epoch_us(f.modified) - epoch_us(r.modified)) > 1000000 THEN 'modified' ELSE 'unchanged' END AS state
  FROM files f LEFT JOIN registry r ON f.path = r.path)"""


def _listing(t):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    at = F.timestamp_add("MINUTE", F.col("doc_id"), base)
    listing = t.documents.select(path, F.col("n_chars").alias("size"), at.alias("modified"))
    known = t.documents.where(F.col("lang") != "de").join(t.labels, "doc_id", "left")
    registry = known.select(
        path, (F.col("n_chars") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("size"),
        F.timestamp_add("MICROSECOND", F.when(F.col("toxic") == 1, 2_000_000).otherwise(500_000), at).alias("modified"))
    return listing, registry


@query("file_change_detection", f"WITH {_FILES} SELECT path, size, state FROM state")
def file_change_detection(t):
    return loads.file_changes(*_listing(t)).select("path", "size", "state")


@query("file_select_modes", f"""WITH {_FILES}
SELECT 'changed' AS mode, path, size FROM state WHERE state <> 'unchanged'
UNION ALL (SELECT 'latest', path, size FROM files ORDER BY modified DESC, path DESC LIMIT 1)
UNION ALL SELECT 'listed', path, size FROM files WHERE path IN (SELECT concat(source, '/', doc_id) FROM documents WHERE doc_id IN (1, 5, 9))""")
def file_select_modes(t):
    listing, registry = _listing(t)
    wanted = [r["path"] for r in t.documents.where(F.col("doc_id").isin(1, 5, 9)).select(
        F.concat_ws("/", "source", "doc_id").alias("path")).collect()]
    modes = {"changed": loads.changed_files(listing, registry), "latest": loads.latest_file(listing),
             "listed": loads.listed_files(listing, wanted)}
    out = None
    for mode, df in modes.items():
        one = df.select(F.lit(mode).alias("mode"), "path", "size")
        out = one if out is None else out.unionByName(one)
    return out


_ORDER_SUM = "count(*) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total"


def _orders_sum(df, by="o_orderpriority"):
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), exact_sum("o_totalprice").cast("double").alias("total"))


@query("load_catalog", f"SELECT o_orderpriority, {_ORDER_SUM} FROM orders GROUP BY 1")
def load_catalog(t):
    path = fresh_path(t.spark, "catalog")
    loads.load_full(t.orders.where(F.col("o_orderstatus") == "F"), path)
    loads.load_full(t.orders, path)
    return _orders_sum(loads.read_full(t.spark, path))


_MARK = "(SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')"


@query("load_transactional", f"""SELECT 'append' AS mode, o_orderpriority, {_ORDER_SUM} FROM (
  SELECT * FROM orders WHERE o_orderdate <= {_MARK} UNION ALL SELECT * FROM orders WHERE o_orderdate >= {_MARK}) GROUP BY 2
UNION ALL SELECT 'dedup', o_orderpriority, {_ORDER_SUM} FROM orders GROUP BY 2""")
def load_transactional(t):
    first = t.orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    mark = loads.next_mark(first, "o_orderdate").first()["mark"]
    second = tables.since(t.orders, "o_orderdate", mark.isoformat(" "))
    out = None
    for mode, keys in (("append", None), ("dedup", ["o_orderkey"])):
        path = fresh_path(t.spark, "transactional")
        loads.load_append(first, path)
        loads.load_append(second, path, keys, "o_orderdate" if keys else None, mark)
        one = _orders_sum(t.spark.read.schema(t.orders.schema).parquet(path)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query("high_water_mark", """SELECT 'fresh' AS state, '1999-01-01' AS start_at, CAST(max(o_orderdate) AS DATE) AS mark, count(*) AS n_rows
  FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'
UNION ALL SELECT 'resumed', '2001-07-01', CAST(max(o_orderdate) AS DATE), count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01'
UNION ALL SELECT 'stale', '2000-01-01T00:00:00', CAST(max(o_orderdate) AS DATE), count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def high_water_mark(t):
    nothing = t.orders.where(F.col("o_orderkey") < 0)
    cases = {"fresh": (None, "1999-01-01", nothing), "resumed": ("2001-07-01", "1999-01-01", t.orders),
             "stale": ("2001-07-01", None, nothing)}
    out = None
    for state, args in cases.items():
        start = loads.start_mark(*args)
        one = loads.next_mark(tables.since(t.orders, "o_orderdate", start), "o_orderdate").select(
            F.lit(state).alias("state"), F.lit(start).alias("start_at"), F.to_date("mark").alias("mark"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("partitioned_sink", """SELECT CAST(ts AS DATE) AS dt, count(*) AS n_rows, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1""")
def partitioned_sink(t):
    path = fresh_path(t.spark, "by-day")
    loads.write_by_day(t.events, path, "ts")
    schema = T.StructType([*t.events.schema.fields, T.StructField("dt", T.DateType())])
    days = loads.read_days(t.spark, path, schema, "2024-01-10", "2024-01-20")
    return days.groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"), exact_sum("value").cast("double").alias("total"))


@query("stream_incremental_load", f"SELECT o_orderpriority, {_ORDER_SUM} FROM orders GROUP BY 1")
def stream_incremental_load(t):
    """Two runs over a folder that receives files in between; a third run finds nothing new."""
    landing, dest, state = (fresh_path(t.spark, n) for n in ("landing", "loaded", "checkpoint"))
    schema = _schema(t.orders)
    done = F.col("o_orderstatus") == "F"
    for part in (t.orders.where(done), t.orders.where(~done), None):
        if part is not None:
            part.write.mode("append").parquet(landing)
        incremental.load_new_files(t.spark, landing, dest, state, schema, glob="*.parquet")
    return _orders_sum(incremental.loaded(t.spark, dest, schema))


@query("load_reconcile", """SELECT o_orderpriority, count(*) AS n_read, count(*) FILTER (WHERE o_totalprice < 20000) AS n_rejected,
  count(*) FILTER (WHERE o_totalprice >= 20000) AS n_found, true AS agrees FROM orders GROUP BY 1""")
def load_reconcile(t):
    ok = F.col("o_totalprice") >= 20000
    path = fresh_path(t.spark, "reconciled")
    loads.load_append(t.orders.where(ok), path)
    written = t.spark.read.schema(t.orders.schema).parquet(path)
    return loads.reconcile(t.orders, t.orders.where(~ok), written, "o_orderpriority")


@query("load_counted", """SELECT o_orderpriority, count(*) AS n_read, count(*) FILTER (WHERE o_totalprice < 20000) AS n_rejected,
  count(*) FILTER (WHERE o_totalprice >= 20000) AS n_written, true AS agrees FROM orders GROUP BY 1""")
def load_counted(t):
    return loads.load_counted(t.orders, F.col("o_totalprice") >= 20000, fresh_path(t.spark, "counted"), "o_orderpriority")
