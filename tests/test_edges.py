"""Hand-made rows: ties, NULLs, empty input, boundaries, bad lines, stale marks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork import session
from tillwork.functions import casts
from tillwork.functions.names import clean_name, clean_names
from tillwork.functions.numbers import exact_sum, rounded
from tillwork.operators import filters, joins, pareto, profile, rolling, splits
from tillwork.operators import typing as ty
from tillwork.operators.features import fit_target
from tillwork.operators.reports import runs as run_reports
from tillwork.plans.dataset_spec import DatasetSpec, JoinSpec
from tillwork.plans.feature_model import FeatureSpec
from tillwork.plans.global_order import percentiles
from tillwork.session import fresh_path
from tillwork.sources import files, loads, tables
from tillwork.streaming import incremental


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        (1, "a", 50.0, ts("2024-01-01")), (1, "b", 30.0, ts("2024-01-10")), (2, "a", 50.0, ts("2024-02-01")),
        (2, "c", 10.0, ts("2024-02-01")), (3, "d", 10.0, ts("2024-03-01")), (None, "e", 5.0, ts("2024-03-01")),
        (4, None, 7.0, ts("2024-03-02")), (4, "f", None, ts("2024-03-02")),
    ]
    return spark.createDataFrame(rows, "customer_id int, product_id string, sales double, ts timestamp_ntz")


def ids(df, column):
    return sorted({r[0] for r in df.select(column).collect()}, key=str)


def test_exact_sum_of_negatives_and_nulls(spark):
    df = spark.createDataFrame([("x", -1.25), ("x", 0.05), ("x", None), ("y", None)], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert float(got["x"]) == -1.2 and got["y"] is None


def test_rounding_is_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (-0.0001,)], "v double")
    assert [r[0] for r in df.select(rounded(F.col("v"), 0)).collect()] == [3.0, -3.0, 0.0]


def test_top_revenue_keeps_the_crossing_product_and_its_ties(tx):
    # a 100, b 30, c 10, d 10, e 5; total 155. c and d tie: their running sum is 150.
    assert ids(filters.top_revenue(tx, "product_id", "sales", 64), "product_id") == ["a"]
    assert ids(filters.top_revenue(tx, "product_id", "sales", 65), "product_id") == ["a", "b"]
    assert ids(filters.top_revenue(tx, "product_id", "sales", 95), "product_id") == ["a", "b", "c", "d"]


def test_excluding_a_category_drops_null(tx):
    assert ids(filters.category(tx, "product_id", ["a"], exclude=True), "product_id") == ["b", "c", "d", "e", "f"]


def test_numeric_nulls_only_on_request(tx):
    assert filters.numeric(tx, "sales", "range", low=10, high=30).count() == 3
    assert filters.numeric(tx, "sales", "range", low=10, high=30, include_nulls=True).count() == 4
    assert filters.numeric(tx, "sales", "ne", value=50.0).count() == 5


def test_date_boundaries_are_inclusive(tx):
    assert filters.date_fixed(tx, "ts", "2024-01-10", "2024-02-01").count() == 3
    assert filters.rolling_days(tx, "ts", 1).count() == 4
    with pytest.raises(ValueError):
        filters.date_relative(tx, "ts", 8)


def test_entity_filters_see_the_dated_base_only_with_a_date_filter(tx):
    metric = ({"entity": "customer_id", "metric": "count", "op": "between", "low": 2},)
    plain = DatasetSpec(primary="tx", categories=({"column": "product_id", "values": ["a"]},), entity_metrics=metric)
    assert ids(plain.filtered({"tx": tx}), "customer_id") == [1, 2]
    dated = DatasetSpec(primary="tx", timestamp="ts", start_date="2024-01-05",
                        categories=({"column": "product_id", "values": ["a", "b"]},), entity_metrics=metric)
    assert dated.filtered({"tx": tx}).count() == 0


def test_spec_round_trip():
    spec = DatasetSpec(primary="tx", joins=(JoinSpec("p", "product_id"),), rolling_days=3, timestamp="ts")
    assert DatasetSpec.from_json(spec.to_json()).to_json() == spec.to_json()


def test_pareto_is_monotone_and_ends_at_hundred(tx):
    rows = pareto.pareto(tx, "product_id", "sales").orderBy("rank_no").collect()
    assert [r["product_id"] for r in rows] == ["a", "b", "c", "d", "e"]
    shares = [r["revenue_pct"] for r in rows]
    assert shares == sorted(shares) and shares[-1] == 100.0 and rows[2]["cumulative"] == rows[3]["cumulative"]


def test_key_uniqueness_ignores_null(tx):
    r = joins.key_uniqueness(tx, "customer_id").first()
    assert (r["total_rows"], r["distinct_keys"], r["is_unique"], r["duplication_factor"]) == (7, 4, False, 1.75)


def test_rolling_window_leaves_out_the_own_day_and_day_61(spark):
    days = [("2024-01-01", 10.0), ("2024-03-01", 20.0), ("2024-03-02", 40.0)]  # 60 and 61 days after the first
    df = spark.createDataFrame([(1, 7, v, ts(d)) for d, v in days], "customer_id int, product_id int, sales double, ts timestamp_ntz")
    rows = rolling.rolling_features(rolling.daily_totals(df), 60).orderBy("day").collect()
    assert [r["cust_value"] for r in rows] == [0.0, 10.0, 20.0]
    assert [r["days_since_last_purchase"] for r in rows] == [0, 60, 1]
    true = rolling.true_distinct_products(df, 60).orderBy("day").collect()
    assert [r["distinct_products"] for r in true] == [0, 1, 1]


def test_splits_of_the_last_days(tx):
    got = {(r["product_id"], r["split"]) for r in splits.strict_time(tx, "ts", 30, 1, 1).collect()}
    assert got == {("a", "train"), ("c", "train"), ("d", "eval"), ("e", "eval"), (None, "test"), ("f", "test")}


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double, c date, d boolean, e array<int>")
    rows = {r["column_name"]: r for r in profile.column_stats(empty).collect()}
    assert rows["a"]["distinct_count"] == 0 and rows["b"]["mean"] is None and rows["a"]["null_pct"] is None


# Names, casts, types -------------------------------------------------------------------------------------

def test_clean_names():
    assert [clean_name(n) for n in ("Customer  Key", "1st-Name", "%%%", "_a__b_")] == \
        ["customer_key", "col_1st_name", "column", "a_b"]
    assert list(clean_names(["a b", "a-b", "A B"]).values()) == ["a_b", "a_b_2", "a_b_3"]
    assert len(clean_name("x" * 400)) == 300


def test_standard_cast_defaults(spark):
    df = spark.createDataFrame([("7",), ("7.0",), ("x",), (None,)], "v string")
    out = casts.cast_standard(df.select(F.col("v").alias("i"), F.col("v").alias("f"), F.col("v").alias("s")),
                              {"i": "INTEGER", "f": "FLOAT", "s": "STRING"})
    assert [tuple(r) for r in out.collect()] == [(7, 7.0, "7"), (7, 7.0, "7.0"), (0, None, "x"), (0, None, None)]


def test_epoch_integer(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024",), ("none",), ("12.9",), ("oops",)], "v string")
    assert [r[0] for r in df.select(casts.epoch_integer(F.col("v"))).collect()] == [1704067200, 2024, None, 12, None]


def test_serialize_nested(spark):
    df = spark.sql("SELECT array(double('nan'), 1.5D, double('infinity')) AS a, named_struct('x', date '2024-01-02') AS s, "
                   "timestamp_ntz '2024-01-02 03:04:05.5' AS t, X'6869' AS b")
    r = casts.serialize(df).first()
    assert (r["a"], r["s"]["x"], r["t"], r["b"]) == ([None, 1.5, None], "2024-01-02", "2024-01-02T03:04:05.500000", "aGk=")


def test_serialize_values_on_odd_events(spark, tmp_path):
    """Whole seconds, long properties, numbers with an exponent, ties of the fifth digit and a missing type."""
    import duckdb

    import __spark_entry__ as entry

    numbers = [0.0, 0.0005, 1e-6, 9.5e-7, 12345678.5, 1e7, 2.5e20 / 1e9, 1.5, 4.06495, 3.8642499999999997, -1.00005, None, 29.27]
    rows = [(i, dt.datetime(2024, 1, 2, 3, 4, 5, 0 if i % 2 else 250), i, kind, x, '{"k": "' + "é" * i * 9 + '"}')
            for i, (x, kind) in enumerate((x, k) for x in numbers for k in ("view", "click", "error", "signup", None))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rel = con.execute(entry.oracle_sql()["serialize_values"])
    names = [d[0] for d in rel.description]
    got = entry.queries()["serialize_values"](spark, str(tmp_path)).select(names).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == sorted(rel.fetchall(), key=lambda r: r[0])


def test_schema_from_warehouse_types(spark):
    ddl = casts.schema_ddl({"a b": "INT64", "c": "Numeric", "d": "timestamp"})
    assert spark.createDataFrame([], ddl).dtypes == [("a b", "bigint"), ("c", "decimal(38,9)"), ("d", "timestamp_ntz")]


def test_zero_one_strings_are_integers_not_booleans(spark):
    df = spark.createDataFrame([("0", "yes", "2024-01-01", ""), ("1", "no", "2024-01-02", "")],
                               "flag string, ok string, ship_date string, empty string")
    got = {r["column_name"]: r["suggested_type"] for r in ty.infer_string_types(df).collect()}
    assert got == {"flag": "INT64", "ok": "BOOL", "ship_date": "DATE", "empty": None}


def test_headerless_file_schema(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "_c0 string, _c1 string")
    rows = [tuple(r) for r in ty.infer_file_schema(df, header=False).collect()]
    assert rows == [("column_0", "column_0", "INT64", "REQUIRED"), ("column_1", "column_1", "STRING", "NULLABLE")]


# Sources and loads ---------------------------------------------------------------------------------------

def test_bad_lines_do_not_depend_on_the_chosen_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\nx,1,2\ny,3\nz,4,5,6\n\nq,,w\nv,,9\n")
    schema = T.StructType().add("a", "string").add("b", "integer").add("c", "integer")
    good, bad = files.read_csv_split(spark, str(tmp_path), schema)
    assert [tuple(r) for r in good.orderBy("a").collect()] == [("v", None, 9), ("x", 1, 2)]
    assert good.count() == 2 and [r[0] for r in good.select("a").orderBy("a").collect()] == ["v", "x"]
    assert bad.count() == 3
    assert sorted(r[0] for r in bad.select(files.REJECTED).collect()) == ["q,,w", "y,3", "z,4,5,6"]


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"a": 1}\n{"a": \n{"a": "x"}\n')
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    schema = T.StructType().add("a", "long")
    good, bad = files.read_json_split(spark, str(tmp_path / "lines"), schema)
    assert [r["a"] for r in good.collect()] == [1] and bad.count() == 2
    assert files.read_json(spark, str(tmp_path / "array"), schema, multiline=True).count() == 2


def test_file_listing_and_changes(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "22")):
        (tmp_path / name).write_text(text)
    listing = files.list_files(spark, str(tmp_path), "*.csv")
    assert listing.count() == 2
    assert loads.changed_files(listing, listing).count() == 0
    assert loads.changed_files(listing, listing.where(F.col("size") == 1)).count() == 1


def test_stale_mark_over_an_empty_destination(spark):
    empty = spark.createDataFrame([], "a int")
    assert loads.start_mark("2024-05-01", None, empty) == loads.HISTORY_START
    assert loads.start_mark("2024-05-01", "2023-01-01", empty) == "2023-01-01"
    assert loads.start_mark("2024-05-01", "2023-01-01", spark.range(1)) == "2024-05-01"
    with pytest.raises(ValueError):
        loads.start_mark(None, None)


def test_time_slices_cover_the_span():
    start, end = ts("2024-01-01"), ts("2024-01-03T05:00:00")
    for rows, seconds in ((1000, 86_400), (1_000_000, 86_400 // 7), (100_000_000, 86_400 // 667)):
        plan = tables.TimeSlices.plan(start, end, rows)
        bounds = plan.bounds()
        assert plan.seconds == seconds and bounds[0][0] == start and bounds[-1][1] == end
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_hash_slices_hold_every_row_once(spark):
    df = spark.range(500).select(F.when(F.col("id") != 3, F.col("id")).alias("k"))
    df.createOrReplaceTempView("hash_rows")
    parts = [spark.sql(f"SELECT * FROM hash_rows WHERE {p}").count() for p in tables.hash_predicates("k", 7)]
    assert sum(parts) == 500 and min(parts) > 0
    assert (tables.hash_slices(10), tables.hash_slices(120_000), tables.hash_slices(10 ** 9)) == (1, 2, 20_000)


def test_repeated_stream_run_loads_nothing_twice(spark):
    landing, dest, state = (fresh_path(spark, n) for n in ("landing", "dest", "state"))
    schema = T.StructType().add("id", "long")
    spark.range(10).write.mode("append").parquet(landing)
    for _ in range(2):
        incremental.load_new_files(spark, landing, dest, state, schema, glob="*.parquet")
    spark.range(10, 15).write.mode("append").parquet(landing)
    incremental.load_new_files(spark, landing, dest, state, schema, glob="*.parquet")
    out = incremental.loaded(spark, dest, schema)
    assert out.count() == 15 and out.select("id").distinct().count() == 15 and out.select("batch").distinct().count() == 2


def test_reconcile_finds_lost_rows(spark):
    source = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2, "b string")
    rows = {r["b"]: r["agrees"] for r in loads.reconcile(source, source.limit(0), source.where("b = 'x'"), "b").collect()}
    assert rows == {"x": True, "y": False}


def test_error_order(spark):
    df = spark.createDataFrame([("Config table missing",), ("Load failed",), ("",), (None,)], "m string")
    rows = df.select(run_reports.error_stage(F.col("m")), run_reports.error_kind(F.col("m"))).collect()
    assert [r[0] for r in rows][:3] == ["init", "load", "unknown"] and rows[3][1] == "Unknown"


# Values and sizes beyond the ordinary --------------------------------------------------------------------------

def test_exact_sum_beyond_the_range_of_longs(spark):
    df = spark.createDataFrame([(5e15,), (5e15,), (0.25,), (-0.00005,)], "v double")
    assert str(df.select(exact_sum("v").alias("s")).first()["s"]) == "10000000000000000.2499"


def test_rounding_of_large_values(spark):
    df = spark.createDataFrame([(3e15,), (-1e300,), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(rounded(F.col("v"), 4)).collect()] == [3e15, -1e300, float("inf"), None]


def test_percentiles_with_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (3.0,)], "v double")
    row = percentiles(df, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (row["low"], row["mid"], row["high"]) == (float("-inf"), 2.0, float("inf"))


def test_csv_with_doubled_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('1,"a ""b"", c",x\n2,"two\nlines",y\n3,plain\n')
    schema = T.StructType().add("k", "integer").add("v", "string").add("w", "string")
    good, bad = files.read_csv_split(spark, str(path), schema, header=False, multiline=True)
    assert sorted(map(tuple, good.collect())) == [(1, 'a "b", c', "x"), (2, "two\nlines", "y")]
    assert [r["k"] for r in bad.collect()] == ["3"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(path), schema, header=False, multiline=True).collect()


def test_offsets_in_times_are_applied(spark):
    rows = [("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01T02:00:00+02:00", 1704067200), ("2024-01-01T00:00:00", 1704067200),
            ("2023-12-31T19:00:00-0500", 1704067200), ("2024-01-01", 1704067200)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = df.select(casts.epoch_integer(F.col("t")), F.unix_timestamp(casts.for_schema(F.col("t"), T.StringType(), "TIMESTAMP").cast("timestamp"))).collect()
    assert [tuple(r) for r in got] == [(s, s) for _, s in rows]


def test_a_vocabulary_keeps_every_token(spark):
    df = spark.range(20).selectExpr("cast(id as string) as c")
    assert FeatureSpec(vocabulary={"c": 1}).fit(df).vocabularies["c"].count() == 20


def test_a_ten_day_run_counts_ten_days(spark):
    rows = [(1, "gpu", 2, ts("2024-01-01"), ts("2024-01-11")), (2, "cpu", 1, ts("2024-01-20"), ts("2024-01-20T01:00:00"))]
    runs = spark.createDataFrame(rows, "run_id int, device string, devices int, started_at timestamp_ntz, completed_at timestamp_ntz")
    got = {(r["day"], r["device"]): r["device_hours"] for r in run_reports.resource_hours_by_day(runs, "device", "devices").collect()}
    assert len([k for k in got if k[1] == "gpu"]) == 10 and set(got.values()) == {48.0, 1.0}


def test_clipping_takes_the_percentile_that_was_asked_for(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as v")
    assert fit_target(df, "v", clip_high=99.95).upper == pytest.approx(9995.0)


def test_time_slices_cover_the_table(spark):
    events = spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) as ts")
    plan = tables.TimeSlices.plan(ts("2024-01-01"), ts("2024-01-06"), 1000, target=40)
    parts = [[r["id"] for r in events.where(p).select("id").collect()] for p in plan.predicates("ts")]
    assert sorted(sum(parts, [])) == list(range(1000)) and len(parts) > 5


def test_the_shared_folder_without_a_setting(spark, monkeypatch):
    class Context:
        master, applicationId = "local[2]", "app-without-setting"

    class Plain:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    first = session.shared_dir(Plain())
    assert os.path.isdir(first) and session.shared_dir(Plain()) == first
    monkeypatch.setattr(Context, "master", "spark://somewhere:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(Plain())


def test_release_deletes_written_intermediates(spark):
    path = session.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.pin(spark.range(2)).count() == 2
    session.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_keyed_append_reads_the_destination_from_the_mark(spark, tmp_path):
    rows = [(1, ts("2024-01-01")), (2, ts("2024-01-02")), (3, ts("2024-01-02"))]
    first = spark.createDataFrame(rows, "k int, at timestamp_ntz")
    loads.load_append(first, str(tmp_path / "t"))
    again = spark.createDataFrame([(2, ts("2024-01-02")), (3, ts("2024-01-02")), (4, ts("2024-01-03")), (4, ts("2024-01-03"))], first.schema)
    loads.load_append(again, str(tmp_path / "t"), ["k"], "at", "2024-01-02")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3, 4]
