"""Full, incremental and sliced reads of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.casts import COMPLEX
from tillwork.functions.hashing import hash_bucket

# Fixed value: rows per slice.
ROWS_PER_SLICE = 50_000


def read_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None, fmt: str = "parquet",
               **options) -> DataFrame:
    """Chosen columns of a parquet folder, a catalogue table (``fmt='table'``) or a JDBC source."""
    if fmt == "table":
        df = spark.table(source)
    elif fmt == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=source, fetchsize=10_000, **options).load()
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    return df.select(*columns) if columns else df


def read_jdbc_slices(spark: SparkSession, url: str, table: str, predicates: Sequence[str], columns: Sequence[str],
                     properties: dict[str, str]) -> DataFrame:
    """One input partition per predicate; columns and further filters are pushed to the database."""
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=properties).select(*columns)


def since(df: DataFrame, ts: str, mark, strict: bool = False) -> DataFrame:
    """Rows from the mark on; ``strict`` leaves the mark itself out, as document stores do."""
    at = F.lit(mark).cast("timestamp_ntz") if not isinstance(mark, Column) else mark
    return df.where(F.col(ts) > at if strict else F.col(ts) >= at)


# Slices --------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TimeSlices:
    """Equal slices [start, end) of a time span."""

    start: dt.datetime
    end: dt.datetime
    seconds: int

    @staticmethod
    def plan(start: dt.datetime, end: dt.datetime, rows: int, target: int = ROWS_PER_SLICE) -> TimeSlices:
        """Equal parts of a day, as many as it takes for about ``target`` rows each (a second at least)."""
        per_day = rows / ((end - start).days + 1)
        parts = min(86_400, max(1, -(-int(per_day) // target)))
        return TimeSlices(start, end, 86_400 // parts)

    def bounds(self) -> list[tuple[dt.datetime, dt.datetime]]:
        out, at = [], self.start
        while at < self.end:
            upper = min(at + dt.timedelta(seconds=self.seconds), self.end)
            out.append((at, upper))
            at = upper
        return out

    def predicates(self, column: str) -> list[str]:
        """WHERE clauses for a JDBC read."""
        return [f"{column} >= '{a.isoformat(' ')}' AND {column} < '{b.isoformat(' ')}'" for a, b in self.bounds()]

    def start_of(self, ts: Column) -> Column:
        """Start of the slice a row belongs to, for file tables."""
        first = F.lit(self.start.isoformat(" ")).cast("timestamp_ntz")
        past = F.timestamp_diff("SECOND", first, ts)
        return F.timestamp_add("SECOND", F.floor(past / self.seconds) * self.seconds, first)


def hash_slices(rows: int, target: int = ROWS_PER_SLICE) -> int:
    """As many slices as it takes for about ``target`` rows each, whatever the number of rows."""
    return max(1, rows // target)


# The slice number of ``hash_slice`` in the SQL of databases: first eight hex digits of the md5 of the key's text.
_HASH_SQL = {
    "spark": "CAST(conv(substr(md5(CAST({k} AS STRING)), 1, 8), 16, 10) AS BIGINT) % {n}",
    "duckdb": "CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8) AS BIGINT) % {n}",
    "postgresql": "MOD(('x' || SUBSTR(MD5(CAST({k} AS TEXT)), 1, 8))::bit(32)::bigint, {n})",
    "mysql": "MOD(CAST(CONV(SUBSTR(MD5(CAST({k} AS CHAR)), 1, 8), 16, 10) AS UNSIGNED), {n})",
    "bigquery": "MOD(CAST(CONCAT('0x', SUBSTR(TO_HEX(MD5(CAST({k} AS STRING))), 1, 8)) AS INT64), {n})",
}


def hash_predicates(column: str, slices: int, dialect: str = "spark") -> list[str]:
    """Stable slices of an integer or text key for a read by predicates; every row is in exactly one, as in ``hash_slice``.

    Keys without a value are in the first.
    """
    number = _HASH_SQL[dialect].format(k=column, n=slices)
    return [f"{number} = {i}" + (f" OR {column} IS NULL" if i == 0 else "") for i in range(slices)]


def hash_slice(key: Column, slices: int) -> Column:
    """Slice number of a row by its key, the same in every process."""
    return F.coalesce(hash_bucket(key, slices), F.lit(0))


# Documents -----------------------------------------------------------------------------------------------

def flatten_documents(df: DataFrame, document_id: str, extracted_at: Column,
                      selected: Sequence[str] | None = None) -> DataFrame:
    """Scalars stay, nested values become JSON text, timestamps text with microseconds; a selected field that
    the documents lack is NULL."""
    types = {f.name: f.dataType for f in df.schema}
    cols = [F.col(document_id).cast("string").alias("document_id"), extracted_at.alias("_extracted_at")]
    for name in selected if selected is not None else [c for c in df.columns if c != document_id]:
        if name not in types:
            c = F.lit(None).cast("string")
        elif isinstance(types[name], COMPLEX):
            c = F.to_json(F.col(name))
        elif isinstance(types[name], (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        else:
            c = F.col(name)
        cols.append(c.alias(name))
    return df.select(*cols)
