"""Load state and sinks: changed files, high-water marks, full and appending loads, reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Tolerance of modification times, and where history starts when nothing else is known.
MTIME_TOLERANCE_SECONDS = 1
HISTORY_START = "2000-01-01T00:00:00"


# Files ---------------------------------------------------------------------------------------------------

def file_changes(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Every listed file with its state against the registry: new, resized, modified or unchanged."""
    known = registry.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"),
                            F.lit(True).alias("_known"))
    drift = F.abs(F.timestamp_diff("MICROSECOND", F.col("_modified"), F.col("modified")))
    state = (
        F.when(F.col("_known").isNull(), "new").when(F.col("size") != F.col("_size"), "resized")
        .when(drift > MTIME_TOLERANCE_SECONDS * 1_000_000, "modified").otherwise("unchanged")
    )
    return listing.join(known, "path", "left").withColumn("state", state).drop("_size", "_modified", "_known")


def changed_files(listing: DataFrame, registry: DataFrame) -> DataFrame:
    return file_changes(listing, registry).where(F.col("state") != "unchanged")


def latest_file(listing: DataFrame) -> DataFrame:
    """The file modified last; the larger path wins a tie."""
    return listing.agg(F.max(F.struct("modified", "path", "size")).alias("f")).select("f.path", "f.size", "f.modified")


def listed_files(listing: DataFrame, paths: Sequence[str]) -> DataFrame:
    return listing.where(F.col("path").isin(list(paths)))


# Marks ---------------------------------------------------------------------------------------------------

def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def start_mark(last_mark: str | None, history_start: str | None, destination: DataFrame | None = None) -> str:
    """Where to read from: the last mark, else the start of history. A mark over an empty destination is
    stale and is dropped."""
    if last_mark and (destination is None or not is_empty(destination)):
        return last_mark
    if last_mark:
        return history_start or HISTORY_START
    if history_start:
        return history_start
    raise ValueError("an incremental load needs a last mark or a history start")


def next_mark(batch: DataFrame, ts: str) -> DataFrame:
    """The new mark is the latest timestamp of the rows that were read."""
    return batch.agg(F.max(ts).alias("mark"), F.count(F.lit(1)).alias("n_rows"))


# Sinks ---------------------------------------------------------------------------------------------------

_SNAPSHOT, _ASIDE = "snapshot=", "_writing-"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and a function for paths below it."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(top, name)


def _entries(spark: SparkSession, path: str) -> list[str]:
    system, at = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at("."))] if system.exists(at(".")) else []


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix(_SNAPSHOT)) for n in _entries(spark, path) if n.startswith(_SNAPSHOT))


def load_full(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: readers (``read_full``) see the old rows or the new ones, never none or half.

    The rows are written aside and published by one rename to the next snapshot. Of the older ones the last stays, for those
    who are reading it. A load that ends before the rename leaves the table as it was; the next load removes what it wrote.
    Two loads at once get the same number, and the rename of the later one fails.
    """
    spark = df.sparkSession
    before, left = _snapshots(spark, path), [n for n in _entries(spark, path) if n.startswith(_ASIDE)]
    aside, new = f"{_ASIDE}{uuid.uuid4().hex}", f"{_SNAPSHOT}{before[-1] + 1 if before else 0}"
    df.write.parquet(f"{path}/{aside}")
    _publish(spark, path, aside, new)
    system, at = _folder(spark, path)
    for name in [*left, *(f"{_SNAPSHOT}{n}" for n in before[:-1])]:
        system.delete(at(name), True)


def _publish(spark: SparkSession, path: str, aside: str, new: str) -> None:
    system, at = _folder(spark, path)
    # A rename onto a folder that is there would move below it.
    if system.exists(at(new)) or not system.rename(at(aside), at(new)):
        raise RuntimeError(f"another load has published {new} of {path}")


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """The latest published snapshot."""
    found = _snapshots(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no published snapshot")
    return spark.read.parquet(f"{path}/{_SNAPSHOT}{found[-1]}")


def load_append(df: DataFrame, path: str, keys: Sequence[str] | None = None, ts: str | None = None, mark=None) -> None:
    """Append a batch. With keys, rows whose key is already there are left out, so that a batch that starts
    at the last mark does not load the boundary twice. Only rows at or after the batch's start can be there
    already: with ``ts`` and ``mark`` the destination is read from the mark on, and older files are passed over."""
    if keys:
        there = df.sparkSession.read.schema(df.schema).parquet(path)
        if ts is not None and mark is not None:
            there = there.where(F.col(ts) >= F.lit(mark).cast(df.schema[ts].dataType))
        df = df.dropDuplicates(list(keys)).join(there.select(*keys), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def write_by_day(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Partitioned by day and sorted by time inside. Rebalancing gathers small days and cuts a heavy day into
    tasks of the advised size, whatever its share of the rows."""
    df.withColumn("dt", F.to_date(ts)).hint("rebalance", "dt").sortWithinPartitions("dt", ts) \
        .write.mode(mode).partitionBy("dt").parquet(path)


def read_days(spark: SparkSession, path: str, schema, first: str, last: str) -> DataFrame:
    """Days by partition pruning."""
    return spark.read.schema(schema).parquet(path).where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


# Reconciliation ------------------------------------------------------------------------------------------

BATCHES = 1000


def load_counted(df: DataFrame, accepted: Column, path: str, batch: str) -> DataFrame:
    """Append the accepted rows and return rows read, rejected and written per batch, counted by the write itself.

    The counts are observed on the rows as they pass, before and after the filter, so neither the source nor the destination is
    read again. They are exact for up to ``BATCHES`` batches; with more, which the observed totals show, the counts are made
    by ``reconcile``.
    """
    spark, seen, kept = df.sparkSession, Observation(), Observation()
    key = F.coalesce(F.col(batch).cast("string"), F.lit(_NO_BATCH))
    counts = f"approx_top_k(_batch, {BATCHES}, {4 * BATCHES})"  # as it never drops a value below its size, it counts exactly
    rows = df.withColumn("_batch", key).observe(seen, F.count(F.lit(1)).alias("n"), F.expr(counts).alias("by"))
    rows = rows.where(accepted).observe(kept, F.count(F.lit(1)).alias("n"), F.expr(counts).alias("by")).drop("_batch")
    rows.write.mode("append").parquet(path)
    read, written = ({r["item"]: r["count"] for r in o.get["by"] or []} for o in (seen, kept))
    if len(read) >= BATCHES or sum(read.values()) != seen.get["n"] or sum(written.values()) != kept.get["n"]:
        there = spark.read.schema(df.schema).parquet(path)
        return reconcile(df, df.where(~F.coalesce(accepted, F.lit(False))), there, batch).withColumnRenamed("n_found", "n_written")
    found = [(None if b == _NO_BATCH else b, n, n - written.get(b, 0), written.get(b, 0)) for b, n in read.items()]
    out = spark.createDataFrame(found, "_b string, n_read long, n_rejected long, n_written long")
    return out.select(F.col("_b").cast(df.schema[batch].dataType).alias(batch), "n_read", "n_rejected", "n_written",
                      (F.col("n_read") == F.col("n_rejected") + F.col("n_written")).alias("agrees"))


_NO_BATCH = "\x00"

def reconcile(source: DataFrame, rejected: DataFrame, destination: DataFrame, batch: str) -> DataFrame:
    """Rows read, rejected and found per batch, and whether they agree."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(batch).agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("bigint")
    return (
        counted(source, "n_read").join(counted(rejected, "n_rejected"), batch, "full")
        .join(counted(destination, "n_found"), batch, "full")
        .select(batch, *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_read", "n_rejected", "n_found")])
        .withColumn("agrees", F.col("n_read") == F.col("n_rejected") + F.col("n_found"))
    )
