"""Lenient conversions: what cannot be converted becomes NULL or a default, never an error."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Warehouse type names and the Spark types that hold them.
WAREHOUSE_TYPES = {
    "INTEGER": "bigint", "INT64": "bigint", "FLOAT": "double", "FLOAT64": "double",
    "NUMERIC": "decimal(38,9)", "BIGNUMERIC": "decimal(38,9)", "STRING": "string", "BYTES": "binary",
    "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz", "TIME": "string", "INTERVAL": "string", "JSON": "string",
    "GEOGRAPHY": "string",
}
TRUE_WORDS = ("true", "1", "yes")
NULL_WORDS = ("none", "nan", "")
COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def schema_ddl(columns: Mapping[str, str]) -> str:
    """Schema text for a reader, from column names and warehouse type names."""
    return ", ".join(f"`{name}` {WAREHOUSE_TYPES[kind.upper()]}" for name, kind in columns.items())


def iso_text(ts: Column) -> Column:
    """ISO form; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


# Standard conversion -------------------------------------------------------------------------------------

def standard(c: Column, target: str) -> Column:
    """INTEGER: bad or missing becomes 0; FLOAT and TIMESTAMP: bad becomes NULL; STRING: NULL stays NULL."""
    target = target.upper()
    if target in ("INTEGER", "INT64"):
        number = c.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(c.try_cast("bigint"), whole, F.lit(0).cast("bigint"))
    if target in ("FLOAT", "FLOAT64"):
        return c.try_cast("double")
    if target in ("TIMESTAMP", "DATETIME"):
        return c.try_cast("timestamp_ntz")
    return c.cast("string")


def cast_standard(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: standard(F.col(c), t) for c, t in targets.items()})


# Schema-driven conversion --------------------------------------------------------------------------------

def _utc(text: Column) -> Column:
    """Date-time text as a UTC time without a zone: an offset in the text is applied, none means UTC."""
    has_offset = text.rlike(r"[T ]\d{2}:\d{2}.*(Z|z|UTC|[+-]\d{2}(:?\d{2})?)$")
    spread = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    moment = F.when(has_offset, spread).try_cast("timestamp").cast("timestamp_ntz")
    return F.when(has_offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment)).otherwise(text.try_cast("timestamp_ntz"))


def _timestamp_text(c: Column) -> Column:
    """Date-only text starts at midnight; time-only text belongs to 1970-01-01."""
    text = F.trim(c)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00")))
        .when(text.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(F.lit("1970-01-01T"), text))
        .otherwise(text)
    )


def for_schema(c: Column, source: T.DataType, target: str) -> Column:
    target = target.upper()
    is_text = isinstance(source, T.StringType)
    if target == "STRING":
        return F.to_json(c) if isinstance(source, COMPLEX) else c.cast("string")
    if target in ("INTEGER", "INT64"):
        return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c)).try_cast("bigint") if is_text else c.try_cast("bigint")
    if target in ("FLOAT", "FLOAT64"):
        return (F.trim(c) if is_text else c).try_cast("double")
    if target in ("NUMERIC", "BIGNUMERIC"):
        return (F.trim(c) if is_text else c).try_cast("decimal(38,9)")
    if target in ("BOOLEAN", "BOOL"):
        return F.lower(c).isin(*TRUE_WORDS) if is_text else c.cast("boolean")
    if target in ("TIMESTAMP", "DATETIME"):
        return _utc(_timestamp_text(c)) if is_text else c.try_cast("timestamp_ntz")
    if target == "DATE":
        return c.try_cast("date")
    return c


def cast_for_schema(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Convert each column to its destination type, knowing the type it comes with."""
    return df.withColumns({c: for_schema(F.col(c), df.schema[c].dataType, t) for c, t in targets.items()})


def epoch_integer(c: Column) -> Column:
    """Integer text, or the epoch seconds of ISO date-time text. Plain numbers are read as numbers first."""
    from tillwork.functions.times import epoch_seconds

    text = F.trim(c.cast("string"))
    clean = F.when(~F.lower(text).isin(*NULL_WORDS), text)
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), clean)
    number = clean.try_cast("double")
    return F.coalesce(clean.try_cast("bigint"), F.when(~F.isnan(number), number).try_cast("bigint"),
                      epoch_seconds(_utc(iso)))


# Serializable values -------------------------------------------------------------------------------------

def serialized(c: Column, dtype: T.DataType) -> Column:
    """NaN and infinities become NULL, times ISO text, decimals doubles, bytes base64, inside nested values too."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")).cast(dtype))
        return F.when(~bad, c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, T.BinaryType):
        return F.translate(F.base64(c), "\r\n", "")  # Spark breaks lines after 76 characters
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: serialized(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: serialized(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[serialized(c[f.name], f.dataType).alias(f.name) for f in dtype]))
    return c


def serialize(df: DataFrame) -> DataFrame:
    return df.select(*[serialized(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


# Defaults ------------------------------------------------------------------------------------------------

def default_of(dtype: T.DataType) -> Column:
    """The value that stands for a missing one."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("1970-01-01").cast(dtype)
    return F.lit("").cast(dtype)


def fill_defaults(df: DataFrame, columns) -> DataFrame:
    """Replace NULL by the type's default in the given columns."""
    return df.withColumns({c: F.coalesce(F.col(c), default_of(df.schema[c].dataType)) for c in columns})


def export_times(df: DataFrame, columns) -> DataFrame:
    """Dates and timestamps as epoch seconds, NULL as 0."""
    from tillwork.functions.times import epoch_seconds

    return df.withColumns({c: F.coalesce(epoch_seconds(F.col(c)), F.lit(0).cast("bigint")) for c in columns})


def exported(c: Column, dtype: T.DataType, may_be_null: bool) -> Column:
    """A column as model training takes it: times as epoch seconds, NULL as the type's default where it may occur."""
    from tillwork.functions.times import epoch_seconds

    if isinstance(dtype, COMPLEX):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        seconds = epoch_seconds(c)
        return F.coalesce(seconds, F.lit(0).cast("bigint")) if may_be_null else seconds
    return F.coalesce(c, default_of(dtype)) if may_be_null else c


def positive_amount(c: Column) -> Column:
    """Predicate: text or number that reads as a positive number."""
    return c.try_cast("double") > 0


def composite_key(major: Column, minor: Column, factor: int = 1_000_000) -> Column:
    return major.cast("bigint") * F.lit(factor) + minor.cast("bigint")
