"""Reads in slices: one input partition per slice of a table in Parquet files, each of which opens only what it needs.

A slice is a range of a column (time or number) or a bucket of a key's hash. Ranges are planned from the least and largest
value of each file, which one pass over that column finds, so a slice is told the files that overlap it and skips the row
groups that do not. A bucket cannot be told from the outside of a file: such tables are laid out by bucket once, and each
slice then opens the files of its own folder. For databases the same slices are predicates (``tables.TimeSlices`` and
``tables.hash_predicates``).

Many small ranges can be read with their number as a column: a partition then holds a run of neighbouring slices, so that files
are opened, and rows that lie in no order are passed, once per partition instead of once per slice.

Slices together are the table once. Rows without a value (or key) belong to the first slice. The files are read with
pyarrow, so their store must be one that it knows (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tillwork.session import fresh_path
from tillwork.sources.tables import ROWS_PER_SLICE, TimeSlices, hash_slice

NAME = "tillwork_slices"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Slice(InputPartition):
    """Files that may hold rows of the slice, and the range [low, high) of its column (None: no bound there).

    A run of numbered slices has ``cuts``: (base, span, n, first, last); slice i begins at base + span * i // n, times in microseconds.
    """

    files: list[str]
    low: object = None
    high: object = None
    nulls: bool = False
    cuts: Sequence[int] | None = None


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


class SlicedReader(DataSourceReader):
    def __init__(self, schema: StructType, column: str | None, slices: list[Slice], number: str | None = None):
        self.schema, self.column, self.slices, self.number, self.where = schema, column, slices, number, []

    def partitions(self) -> Sequence[InputPartition]:
        # An empty table still has to have a partition.
        return [s for s in self.slices if not self._excluded(s)] or [Slice([])]

    def _excluded(self, s: Slice) -> bool:
        """Whether pushed comparisons with the slicing column leave nothing of a slice."""
        for kind, name, value in self.where:
            if name != self.column or kind in ("is_null", "is_not_null", "in"):
                continue
            low, high = self._bound(s.low), self._bound(s.high)
            over = high is not None and (value >= high if kind in ("eq", "ge", "gt") else False)
            under = low is not None and (value < low if kind in ("eq", "le") else value <= low if kind == "lt" else False)
            if over or under:
                return True
        return False

    def _bound(self, value: object) -> object:
        kind = self.schema[self.column].dataType.typeName() if self.column else ""
        if value is None or not isinstance(value, str) or not kind.startswith(("timestamp", "date")):
            return value
        at = dt.datetime.fromisoformat(value)
        return at.date() if kind == "date" else at

    def condition(self, s: Slice) -> pc.Expression | None:
        kinds = to_arrow_schema(self.schema)
        known = lambda name, value: pa.scalar(value).cast(kinds.field(name).type)
        out = None
        if self.column and (s.low is not None or s.high is not None):
            col = ds.field(self.column)
            parts = [col >= known(self.column, self._bound(s.low))] * (s.low is not None) + [col < known(self.column, self._bound(s.high))] * (s.high is not None)
            out = parts[0] if len(parts) == 1 else parts[0] & parts[1]
            out = out | col.is_null() if s.nulls else out
        for kind, name, value in self.where:
            col = ds.field(name)
            one = {"eq": lambda: col == known(name, value), "lt": lambda: col < known(name, value), "le": lambda: col <= known(name, value),
                   "gt": lambda: col > known(name, value), "ge": lambda: col >= known(name, value), "is_null": lambda: col.is_null(),
                   "is_not_null": lambda: col.is_valid(), "in": lambda: col.isin([known(name, v).as_py() for v in value])}[kind]()
            out = one if out is None else out & one
        return out

    def fragments(self, s: Slice) -> Iterator[ds.Fragment]:
        """The parts of the slice's files whose row groups may hold a row of it."""
        condition = self.condition(s)
        for uri in s.files:
            store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
            fragment = ds.ParquetFileFormat().make_fragment(path, filesystem=store)
            if condition is None:
                yield fragment
            elif (some := fragment.subset(condition)).row_groups:
                yield some

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema, condition = to_arrow_schema(self.schema), self.condition(partition)
        stored = [name for name in schema.names if name != self.number]
        for fragment in self.fragments(partition):
            for batch in fragment.to_batches(columns=stored, filter=condition, batch_readahead=2):
                if batch.num_rows:
                    if self.number:
                        batch = batch.append_column(self.number, slice_numbers(batch.column(self.column), partition.cuts))
                    yield batch.select(schema.names).cast(schema)


def slice_numbers(values: pa.Array, cuts: Sequence[int]) -> pa.Array:
    """The number of each value's slice; 0 without a value."""
    base, span, n, first, last = cuts
    if pa.types.is_temporal(values.type):
        values = values.cast(pa.timestamp("us", getattr(values.type, "tz", None))).cast(pa.int64())
    begins = np.array([base + span * i // n for i in range(first, last)], np.int64)
    found = first - 1 + np.searchsorted(begins, values.fill_null(base).to_numpy(zero_copy_only=False), "right")
    return pc.if_else(values.is_null(), pa.scalar(0, pa.int32()), pa.array(found, pa.int32()))


class PushingReader(SlicedReader):
    """The same with filters of the query taken over: compared columns are checked while reading, and slices are left out."""

    KINDS = {EqualTo: "eq", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge", In: "in", IsNull: "is_null", IsNotNull: "is_not_null"}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = self.KINDS.get(type(f))
            value = getattr(f, "value", None)
            odd = kind is None or f.attribute[0] == self.number or isinstance(f, EqualNullSafe) or len(f.attribute) != 1 or isinstance(value, float)
            if odd or (kind == "in" and any(v is None for v in value)) or (isinstance(value, dt.datetime) and value.tzinfo):
                yield f
            else:
                self.where.append((kind, f.attribute[0], tuple(value) if kind == "in" else value))


class SlicedSource(DataSource):
    """Options: ``column`` (of ranges), ``slices`` (JSON: files, low, high, nulls, cuts of each), ``pushdown`` (true or false),
    ``number`` (the column of slice numbers, if wanted)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else SlicedReader
        return kind(schema, self.options.get("column") or None, [Slice(*x) for x in json.loads(self.options["slices"])],
                    self.options.get("number") or None)


def read_slices(spark: SparkSession, schema: StructType, slices: Sequence[Slice], column: str | None = None, number: str | None = None) -> DataFrame:
    """One partition per slice (or run of numbered slices), in their order. Filters are pushed if the session allows it for Python sources."""
    spark.dataSource.register(SlicedSource)
    told = json.dumps([[s.files, _plain(s.low), _plain(s.high), s.nulls, s.cuts] for s in slices])
    if number:
        schema = StructType([*schema.fields, StructField(number, IntegerType())])
    pushdown = (spark.conf.get(PUSHDOWN, "false") or "false").lower()
    return spark.read.format(NAME).schema(schema).option("slices", told).option("pushdown", pushdown).option("column", column or "").option("number", number or "").load()


# Ranges ------------------------------------------------------------------------------------------------------------

def file_ranges(table: DataFrame, column: str) -> list:
    """Per file its path, rows, rows without a value, least and largest value: one small row a file, as in its footer."""
    rows = table.select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("x"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("file").collect()


def range_slices(files: Sequence, bounds: Sequence[tuple], with_nulls: bool = True) -> list[Slice]:
    """Slices [low, high) in order, each with the files that overlap it; rows without a value are in the first."""
    out = []
    for i, (low, high) in enumerate(bounds):
        nulls = with_nulls and i == 0
        touched = [f["file"] for f in files if (f["low"] is not None and f["low"] < high and f["high"] >= low) or (nulls and f["n_null"])]
        out.append(Slice(touched, low, high, nulls))
    return out


def numbered_runs(files: Sequence, base: int, span: int, n: int, runs: int, value=lambda x: x, with_nulls: bool = True, end: object = None) -> list[Slice]:
    """Slices 0 .. n-1 in at most ``runs`` runs of neighbours; ``value`` makes a value of the column from a cut."""
    edges = [n * i // min(n, runs) for i in range(min(n, runs) + 1)]
    bounds = [(value(base + span * a // n), value(base + span * b // n)) for a, b in zip(edges[:-1], edges[1:])]
    bounds[-1] = (bounds[-1][0], bounds[-1][1] if end is None else end)
    out = range_slices(files, bounds, with_nulls)
    for s, a, b in zip(out, edges[:-1], edges[1:]):
        s.cuts = (base, span, n, a, b)
    return out


def _runs(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def read_time_slices(spark: SparkSession, path: str, column: str, columns: Sequence[str] | None = None, target: int = ROWS_PER_SLICE,
                     start: dt.datetime | None = None, end: dt.datetime | None = None, number: str | None = None) -> DataFrame:
    """A Parquet table, or its rows in [start, end), in equal slices of time of about ``target`` rows.

    A partition per slice; with ``number`` a partition holds a run of slices, and the column of that name has the slice of a row.
    """
    table = spark.read.parquet(path)
    files = file_ranges(table, column)
    spans = [f for f in files if f["low"] is not None]
    if not spans:
        low = high = dt.datetime(1970, 1, 1)
    else:
        low, high = min(f["low"] for f in spans), max(f["high"] for f in spans)
    a = start or dt.datetime.combine(low.date(), dt.time())
    b = end or high + dt.timedelta(microseconds=1)
    plan, every = TimeSlices.plan(a, b, sum(f["n"] for f in files), target), start is None and end is None
    if number:
        zero, micro = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)
        n = max(1, -((a - b) // dt.timedelta(seconds=plan.seconds)))
        slices = numbered_runs(files, (a - zero) // micro, plan.seconds * 1_000_000 * n, n, _runs(spark), lambda x: zero + x * micro, every, max(a, b))
    else:
        slices = range_slices(files, plan.bounds() or [(a, max(a, b))], with_nulls=every)
    return read_slices(spark, _wanted(table, columns, column), slices, column, number)


def read_number_slices(spark: SparkSession, path: str, column: str, columns: Sequence[str] | None = None, target: int = ROWS_PER_SLICE,
                       number: str | None = None) -> DataFrame:
    """A Parquet table in equal ranges of an integer column, of about ``target`` rows if its values are spread evenly.

    A partition per slice; with ``number`` a partition holds a run of slices, and the column of that name has the slice of a row.
    """
    table = spark.read.parquet(path)
    files = file_ranges(table, column)
    spans = [f for f in files if f["low"] is not None]
    low, high = (min(f["low"] for f in spans), max(f["high"] for f in spans)) if spans else (0, 0)
    n = max(1, min(high - low + 1, sum(f["n"] for f in files) // target))
    if number:
        slices = numbered_runs(files, low, high + 1 - low, n, _runs(spark))
    else:
        cuts = [low + (high + 1 - low) * i // n for i in range(n + 1)]
        slices = range_slices(files, list(zip(cuts[:-1], cuts[1:])))
    return read_slices(spark, _wanted(table, columns, column), slices, column, number)


def _wanted(table: DataFrame, columns: Sequence[str] | None, column: str) -> StructType:
    return table.select(*dict.fromkeys([*columns, column])).schema if columns else table.schema


# Buckets -----------------------------------------------------------------------------------------------------------

def lay_out_by_hash(df: DataFrame, key: str, slices: int, path: str | None = None) -> str:
    """Write a table once, a folder per bucket of the key's hash; returns the path.

    Files are rebalanced, so a bucket that holds a third of the rows is written by many tasks.
    """
    path = path or fresh_path(df.sparkSession, "by-hash")
    df.withColumn("slice", hash_slice(F.col(key), slices)).hint("rebalance", "slice").write.partitionBy("slice").parquet(path)
    return path


def read_hash_slices(spark: SparkSession, path: str, slices: int, only: Sequence[int] | None = None) -> DataFrame:
    """Slices of a table that was laid out by hash: one partition each, opening the files of its own folder."""
    table = spark.read.parquet(path)
    wanted = list(range(slices)) if only is None else list(only)
    files = table.where(F.col("slice").isin(wanted)).select("slice", F.col("_metadata.file_path").alias("file")).distinct().collect() if wanted else []
    by = {i: sorted(r["file"] for r in files if r["slice"] == i) for i in wanted}
    return read_slices(spark, table.drop("slice").schema, [Slice(by[i]) for i in wanted])
