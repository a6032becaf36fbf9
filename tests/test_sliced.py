"""Sliced reads: what a slice opens, that slices are the table once, pushed filters, keys of any type."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tillwork.sources import sliced, tables

DAY = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def timed(spark, tmp_path_factory):
    """Ten days of rows in ten files of small row groups, and a file of rows without a time."""
    path = str(tmp_path_factory.mktemp("timed") / "t")
    rows = [(i, DAY + dt.timedelta(minutes=6 * i), None if i % 5 == 0 else f"name {i % 7}") for i in range(2400)]
    df = spark.createDataFrame(rows + [(9000 + i, None, "none") for i in range(3)], "id long, ts timestamp_ntz, name string")
    days = df.repartitionByRange(11, F.to_date("ts").asc_nulls_first(), "id").sortWithinPartitions("ts")
    days.write.option("parquet.block.size", 1024).option("parquet.page.size", 256).parquet(path)
    return path


def test_slices_are_the_table_once_and_open_only_their_rows(spark, timed):
    table = spark.read.parquet(timed)
    got = sliced.read_time_slices(spark, timed, "ts", target=120)
    assert got.schema == table.schema and got.rdd.getNumPartitions() == 20
    placed = got.select("*", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["id"], r["ts"], r["name"]) for r in placed) == sorted(map(tuple, table.collect()))
    assert all(r["p"] == (0 if r["ts"] is None else (r["ts"] - DAY) // dt.timedelta(hours=12)) for r in placed)
    files = sliced.file_ranges(table, "ts")
    assert len(files) > 8
    bounds = tables.TimeSlices(DAY, DAY + dt.timedelta(days=10), 43_200).bounds()
    slices = sliced.range_slices(files, bounds)
    assert all(1 <= len(s.files) <= 3 for s in slices)  # not all files
    reader = sliced.SlicedReader(table.schema, "ts", slices)
    for s, (a, b) in list(zip(slices, bounds))[1:]:
        opened = [g for f in reader.fragments(s) for g in f.row_groups]
        whole = sum(len(f.row_groups) for p in s.files for f in [sliced.ds.dataset(p.removeprefix("file://")).get_fragments().__next__()])
        rows = sum(b_.num_rows for b_ in reader.read(s))
        assert rows == 120 and len(opened) <= whole


def test_a_part_of_the_time(spark, timed):
    a, b = DAY + dt.timedelta(hours=30), DAY + dt.timedelta(hours=51)
    got = sliced.read_time_slices(spark, timed, "ts", ["id"], target=50, start=a, end=b)
    assert got.columns == ["id", "ts"]
    assert sorted(r["id"] for r in got.collect()) == list(range(300, 510))


@pytest.mark.parametrize("condition,wanted", [
    ("ts >= timestamp_ntz'2024-03-05 00:00:00'", None), ("ts < timestamp_ntz'2024-03-02 00:00:00' AND name = 'name 3'", None),
    ("ts IS NULL", 3), ("name IS NULL", 480), ("id IN (5, 7, 9001)", 3), ("id > 2390 AND id <= 9000 AND name IS NOT NULL", None),
    ("ts > timestamp_ntz'2030-01-01 00:00:00'", 0), ("length(name) = 4 OR id = 1", 4), ("ts = timestamp_ntz'2024-03-01 00:06:00'", 1)])
def test_pushed_filters_give_the_rows_that_spark_gives(spark, timed, condition, wanted):
    want = sorted(map(tuple, spark.read.parquet(timed).where(condition).collect()), key=str)
    assert wanted is None or len(want) == wanted
    spark.conf.set(sliced.PUSHDOWN, "true")
    try:
        got = sliced.read_time_slices(spark, timed, "ts", target=120).where(condition)
        assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.unset(sliced.PUSHDOWN)
    assert sorted(map(tuple, sliced.read_time_slices(spark, timed, "ts", target=120).where(condition).collect()), key=str) == want


def test_pushed_times_leave_slices_out(spark, timed):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan, Not

    table = spark.read.parquet(timed)
    bounds = tables.TimeSlices(DAY, DAY + dt.timedelta(days=10), 43_200).bounds()
    reader = sliced.PushingReader(table.schema, "ts", sliced.range_slices(sliced.file_ranges(table, "ts"), bounds))
    other = Not(LessThan(("id",), 3))
    left = list(reader.pushFilters([GreaterThanOrEqual(("ts",), DAY + dt.timedelta(days=2)), LessThan(("ts",), DAY + dt.timedelta(days=3)), other]))
    assert left == [other] and [(s.low, s.high) for s in reader.partitions()] == bounds[4:6]
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(480, 720)) and to_arrow_schema(table.schema).names == ["id", "ts", "name"]


def test_number_slices(spark, tmp_path):
    rows = [(i * i, str(i)) for i in range(-30, 200)] + [(None, "none")]
    spark.createDataFrame(rows, "k long, v string").repartition(4).write.parquet(str(tmp_path / "n"))
    got = sliced.read_number_slices(spark, str(tmp_path / "n"), "k", target=40)
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    empty = str(tmp_path / "e")
    spark.createDataFrame([], "k long, ts timestamp_ntz").write.parquet(empty)
    assert sliced.read_number_slices(spark, empty, "k").count() == 0 and sliced.read_time_slices(spark, empty, "ts").count() == 0


def test_text_keys_have_one_slice_everywhere(spark, tmp_path):
    keys = [None, "", "a", "ü 漢", "O'Neil", "a" * 5000, *[f"key {i}" for i in range(500)], *["hot"] * 400]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n long")
    df.createOrReplaceTempView("keyed")
    want = {r["n"]: r["s"] for r in df.select("n", tables.hash_slice(F.col("k"), 6).alias("s")).collect()}
    by_spark, con = {}, duckdb.connect()
    con.execute("CREATE TABLE keyed AS SELECT unnest(?) AS k, unnest(?) AS n", [keys, list(range(len(keys)))])
    by_duck = {}
    for i, (p, q) in enumerate(zip(tables.hash_predicates("k", 6, "spark"), tables.hash_predicates("k", 6, "duckdb"))):
        for r in spark.sql(f"SELECT n FROM keyed WHERE {p}").collect():
            assert by_spark.setdefault(r["n"], i) == i
        for (n,) in con.execute(f"SELECT n FROM keyed WHERE {q}").fetchall():
            assert by_duck.setdefault(n, i) == i
    assert by_spark == want and by_duck == want
    path = sliced.lay_out_by_hash(df, "k", 6)
    got = sliced.read_hash_slices(spark, path, 6)
    assert got.schema == df.schema and {r["n"]: r["p"] for r in got.select("n", F.spark_partition_id().alias("p")).collect()} == want
    only = sliced.read_hash_slices(spark, path, 6, only=[4])
    assert only.rdd.getNumPartitions() == 1 and {r["n"] for r in only.collect()} == {n for n, s in want.items() if s == 4}


def test_whole_number_keys_have_the_same_rule(spark):
    df = spark.range(-50, 50).withColumnRenamed("id", "k")
    df.createOrReplaceTempView("numbered")
    want = {r["k"]: r["s"] for r in df.select("k", tables.hash_slice(F.col("k"), 5).alias("s")).collect()}
    got = {r["k"]: i for i, p in enumerate(tables.hash_predicates("k", 5)) for r in spark.sql(f"SELECT k FROM numbered WHERE {p}").collect()}
    assert got == want


def test_many_small_slices_are_few_partitions(spark, timed, tmp_path):
    """The number of partitions, and so of passes over rows in no order, does not grow with the number of slices."""
    table, most = spark.read.parquet(timed), 2 * spark.sparkContext.defaultParallelism
    got = sliced.read_time_slices(spark, timed, "ts", ["id"], target=2, number="part")
    assert got.columns == ["id", "ts", "part"] and got.rdd.getNumPartitions() <= most
    rows = got.collect()
    assert sorted((r["id"], r["ts"]) for r in rows) == sorted(map(tuple, table.select("id", "ts").collect()))
    assert all(r["part"] == (0 if r["ts"] is None else (r["ts"] - DAY) // dt.timedelta(minutes=12)) for r in rows)
    a, b = DAY + dt.timedelta(hours=30), DAY + dt.timedelta(hours=51)
    args = (spark, timed, "ts", ["id"], 5, a, b)
    plain = sliced.read_time_slices(*args).withColumn("part", F.spark_partition_id())
    some = sliced.read_time_slices(*args, number="part").where("part > 3")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, plain.where("part > 3").collect())) and some.count() > 200
    keys = [(i * i, str(i)) for i in range(-30, 200)] + [(None, "none")]
    path = str(tmp_path / "n")
    spark.createDataFrame(keys, "k long, v string").repartition(4).write.parquet(path)
    plain = sliced.read_number_slices(spark, path, "k", target=2).withColumn("part", F.spark_partition_id())
    packed = sliced.read_number_slices(spark, path, "k", target=2, number="part")
    assert plain.rdd.getNumPartitions() == 115 and packed.rdd.getNumPartitions() <= most
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
