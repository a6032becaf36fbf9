"""Guessing column types from whole tables, and fitting batches to a destination schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.casts import for_schema
from tillwork.functions.names import clean_name, clean_names
from tillwork.functions.numbers import ratio
from tillwork.operators.distinct import distinct_counts, read_again

# Name patterns, value patterns, word lists and shares of the type guesses.
DATE_NAMES = (r".*_date$", r".*_dt$", r"date_.*", r"created", r"updated", r"modified", r".*_on$", r".*_at$")
DATE_VALUE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_VALUE = r"^\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n")
DATE_SHARE, BOOLEAN_SHARE = 0.8, 0.9
ID_NAME_PARTS = ("_id", "id_", "_key", "key_", "_code", "code_", "zip", "postal", "sku")
DATE_LIKE_VALUES = (r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{2}-\d{2}-\d{4}", r"^\d{4}/\d{2}/\d{2}", r"^\d{8}$")
DATE_LIKE_SHARE = 0.6
ID_MIN_DISTINCT, ID_MIN_SHARE = 100, 0.1
PERIODS_BY_NAME = (("hour", 24), ("day_of_week", 7), ("weekday", 7), ("month", 12), ("day", 31), ("quarter", 4))
PERIODS_BY_RANGE = ((0, 23, 24), (0, 6, 7), (1, 12, 12), (1, 31, 31), (1, 4, 4))
DEFAULT_PERIOD = 12


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _value_counts(columns: Sequence[str]) -> list[Column]:
    """Per text column: non-empty values, and how many read as each kind."""
    out = []
    for i, name in enumerate(columns):
        c = F.col(name)
        v = F.when(F.length(c) > 0, c)
        out += [
            F.count(v).alias(f"n_{i}"),
            F.count_if(v.rlike(DATE_VALUE)).alias(f"date_{i}"),
            F.count_if(v.rlike(TIMESTAMP_VALUE)).alias(f"ts_{i}"),
            F.count_if(v.rlike(r"^\s*[+-]?\d+\s*$")).alias(f"int_{i}"),
            F.count(F.trim(v).try_cast("double")).alias(f"float_{i}"),
            F.count_if(F.lower(v).isin(*BOOLEAN_WORDS)).alias(f"bool_{i}"),
            F.count_if(F.lower(v).isin("true", "false")).alias(f"tf_{i}"),
        ]
    return out


def infer_string_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Suggested type per text column, from all values in one pass; NULL when text fits best."""
    names = list(columns or _strings(df))
    parts = []
    for i, name in enumerate(names):
        n = F.col(f"n_{i}")
        guess = F.when(n == 0, F.lit(None).cast("string"))
        if any(re.match(p, name.lower()) for p in DATE_NAMES):
            guess = guess.when(F.col(f"date_{i}") > n * DATE_SHARE, "DATE") \
                .when(F.col(f"ts_{i}") > n * DATE_SHARE, "TIMESTAMP")
        guess = guess.when(F.col(f"int_{i}") == n, "INT64").when(F.col(f"float_{i}") == n, "FLOAT64") \
            .when(F.col(f"bool_{i}") > n * BOOLEAN_SHARE, "BOOL")
        parts.append(F.struct(F.lit(name).alias("column_name"), n.alias("n_values"), guess.alias("suggested_type")))
    return df.agg(*_value_counts(names)).select(F.inline(F.array(*parts)))


def infer_file_schema(df: DataFrame, header: bool = True) -> DataFrame:
    """Type, need and clean name of every column of a text file, from all its rows."""
    names = _strings(df)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"), *_value_counts(names))
    labels = names if header else [f"column_{i}" for i in range(len(names))]
    parts = []
    for i, name in enumerate(labels):
        n = F.col(f"n_{i}")
        dated = F.col(f"date_{i}") + F.col(f"ts_{i}")
        kind = (
            F.when(n == 0, "STRING").when(F.col(f"int_{i}") == n, "INT64").when(F.col(f"float_{i}") == n, "FLOAT64")
            .when(F.col(f"tf_{i}") == n, "BOOL").when(dated == n, "TIMESTAMP").otherwise("STRING")
        )
        parts.append(F.struct(
            F.lit(clean_name(name)).alias("column_name"), F.lit(name).alias("original_name"), kind.alias("value_type"),
            F.when(n == F.col("_rows"), "REQUIRED").otherwise("NULLABLE").alias("mode")))
    return rows.select(F.inline(F.array(*parts)))


def _period(name: str, lo: Column, hi: Column) -> Column:
    for part, period in PERIODS_BY_NAME:
        if part in name:
            return F.lit(period)
    out = None
    for low, high, period in PERIODS_BY_RANGE:
        hit = (lo >= low) & (hi <= high)
        out = F.when(hit, period) if out is None else out.when(hit, period)
    return out.otherwise(DEFAULT_PERIOD)


def detect_semantic_types(df: DataFrame) -> DataFrame:
    """Kind of every column (history, date, id, cyclical, number, category) and the period of cyclical ones,
    from one pass over the whole table and the distinct counts of its numbers."""
    counted = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not any(p in f.name.lower() for p in ID_NAME_PARTS)]
    if counted:
        df = read_again(df, df.columns, "typed")
    distinct = distinct_counts(df, counted)
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema):
        name, c = f.name.lower(), F.col(f.name)
        named_id = any(p in name for p in ID_NAME_PARTS)
        period = F.lit(None).cast("int")
        if isinstance(f.dataType, T.ArrayType):
            kind = F.lit("history")
        elif isinstance(f.dataType, T.StringType):
            v = F.when(F.length(F.trim(c)) > 0, F.trim(c))
            dated = F.lit(False)
            for p in DATE_LIKE_VALUES:
                dated = dated | v.rlike(p)
            aggs += [F.count(v).alias(f"n_{i}"), F.count_if(dated).alias(f"d_{i}")]
            kind = F.when((F.col(f"n_{i}") >= 2) & (F.col(f"d_{i}") >= F.col(f"n_{i}") * DATE_LIKE_SHARE), "date") \
                .otherwise("id" if named_id else "category")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = F.lit("date")
        elif isinstance(f.dataType, T.NumericType):
            if named_id:
                kind = F.lit("id")
            else:
                x = c.cast("double")
                aggs += [F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
                lo, hi, k = F.col(f"lo_{i}"), F.col(f"hi_{i}"), F.lit(distinct[f.name])
                many = (k > ID_MIN_DISTINCT) & (ratio(k, F.col("_rows")) > ID_MIN_SHARE)
                cycle = (
                    ((lo >= 0) & (hi <= 23) & (hi - lo >= 10)) | ((lo >= 0) & (hi <= 6))
                    | ((lo >= 1) & (hi <= 12) & (hi - lo >= 6)) | ((lo >= 1) & (hi <= 31) & (hi - lo >= 15))
                )
                kind = F.when(many, "id").when(cycle, "cyclical").otherwise("number")
                period = F.when(~many & cycle, _period(name, lo, hi))
        else:
            kind = F.lit("category")
        parts.append(F.struct(F.lit(f.name).alias("column_name"), kind.alias("semantic_type"),
                              period.cast("int").alias("period")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


# Fitting batches -----------------------------------------------------------------------------------------

def rename_and_project(df: DataFrame, destination: Sequence[str] | None = None,
                       mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Clean names (or the given mapping), then only the destination's columns, in its order."""
    names = dict(mapping) if mapping else clean_names(df.columns)
    renamed = {names.get(c, c): c for c in df.columns}
    wanted = [c for c in destination if c in renamed] if destination is not None else list(renamed)
    return df.select(*[F.col(f"`{renamed[c]}`").alias(c) for c in wanted])


_NAMES = {"bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN",
          "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def append_evolving(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The existing rows plus a drifted batch, and a report of the drift.

    New columns become nullable, missing ones NULL; columns of another type are converted leniently and the
    values lost by that are counted.
    """
    have = {f.name: f.dataType for f in existing.schema}
    cols, aggs, parts = [], [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(batch.schema):
        c, bad, change = F.col(f.name), F.lit(0).cast("bigint"), None
        if f.name not in have:
            change = "added"
        elif have[f.name] != f.dataType:
            change = "converted"
            original = c
            c = for_schema(c, f.dataType, _NAMES.get(have[f.name].simpleString(), "STRING")).try_cast(have[f.name])
            aggs.append(F.count_if(original.isNotNull() & c.isNull()).alias(f"bad_{i}"))
            bad = F.col(f"bad_{i}")
        cols.append(c.alias(f.name))
        if change:
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(change).alias("change"),
                                  bad.alias("bad_values")))
    for name in have:
        if name not in batch.columns:
            parts.append(F.struct(F.lit(name).alias("column_name"), F.lit("missing").alias("change"),
                                  F.col("_rows").alias("bad_values")))
    combined = existing.unionByName(batch.select(*cols), allowMissingColumns=True)
    if not parts:
        report = batch.sparkSession.createDataFrame([], "column_name string, change string, bad_values bigint")
    else:
        report = batch.agg(*aggs).select(F.inline(F.array(*parts)))
    return combined, report
