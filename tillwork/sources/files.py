"""File readers: CSV, JSON and parquet, with rejected rows kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REJECTED = "_corrupt_record"


def _csv(spark: SparkSession, sep: str, encoding: str, header: bool, multiline: bool):
    """A quote inside a quoted value is doubled; ``multiline`` lets quoted values hold line breaks."""
    return spark.read.options(sep=sep, encoding=encoding, header=header, nullValue="", emptyValue="", quote='"',
                              escape='"', multiLine=multiline)


def read_csv(spark: SparkSession, path, schema, sep: str = ",", encoding: str = "utf-8", header: bool = True,
             multiline: bool = False) -> DataFrame:
    """Typed rows; a line that does not fit the schema is an error (``read_csv_split`` keeps such lines apart)."""
    return _csv(spark, sep, encoding, header, multiline).option("mode", "FAILFAST").schema(schema).csv(path)


def read_csv_text(spark: SparkSession, path, columns: Sequence[str], sep: str = ",", encoding: str = "utf-8",
                  header: bool = True, multiline: bool = False) -> DataFrame:
    """All columns as text, for type inference over the whole file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema, sep, encoding, header, multiline)


def _as_text(schema: T.StructType) -> T.StructType:
    """The schema with plain values as text, nested ones as they are, and the marker of bad lines."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    fields = [T.StructField(f.name, f.dataType if isinstance(f.dataType, nested) else T.StringType()) for f in schema]
    return T.StructType([*fields, T.StructField(REJECTED, T.StringType())])


def _split(raw: DataFrame, schema: T.StructType, rebuilt: Column) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the lines that are malformed or lose a value by the typing.

    Typing happens here and not in the reader: a reader only looks at the columns that a query asks for, so
    its verdict on a line would depend on the query.
    """
    first = F.col(schema[0].name)
    text = first if isinstance(raw.schema[0].dataType, T.StringType) else F.to_json(F.struct(first))
    # Never true, but it makes every query read a data column; a marker alone cannot be queried.
    typed, lost = {}, F.length(text) < 0
    for f in schema:
        if raw.schema[f.name].dataType != f.dataType:
            typed[f.name] = F.trim(F.col(f.name)).try_cast(f.dataType)
            lost = F.coalesce(lost, F.lit(False)) | (F.col(f.name).isNotNull() & typed[f.name].isNull())
    bad = F.col(REJECTED).isNotNull() | F.coalesce(lost, F.lit(False))
    checked = raw.withColumn("_bad", bad)
    good = checked.where(~F.col("_bad")).select(*[typed.get(f.name, F.col(f.name)).alias(f.name) for f in schema])
    rejected = checked.where(F.col("_bad")).select(
        *[f.name for f in schema], F.coalesce(F.col(REJECTED), rebuilt).alias(REJECTED))
    return good, rejected


def read_csv_split(spark: SparkSession, path, schema: T.StructType, sep: str = ",", encoding: str = "utf-8",
                   header: bool = True, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected lines: those with another number of fields or values that do not parse.

    Column pruning is off, because a pruned parser no longer sees surplus or missing fields.
    """
    raw = (
        _csv(spark, sep, encoding, header, multiline).option("mode", "PERMISSIVE").option("columnPruning", False)
        .option("columnNameOfCorruptRecord", REJECTED).schema(_as_text(schema)).csv(path)
    )
    # A line that the typing rejects is written again from its fields, quoted where it has to be.
    line = F.to_csv(F.struct(*[f.name for f in schema]), {"sep": sep, "escape": '"', "nullValue": "", "emptyValue": ""})
    return _split(raw, schema, line)


def read_json(spark: SparkSession, path, schema, multiline: bool = False) -> DataFrame:
    """JSON lines, or with ``multiline`` files that hold one JSON array each."""
    return spark.read.schema(schema).json(path, multiLine=multiline)


def read_json_split(spark: SparkSession, path, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected lines: no JSON, or values that do not parse."""
    raw = spark.read.schema(_as_text(schema)).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    return _split(raw, schema, F.to_json(F.struct(*[f.name for f in schema])))


def read_parquet(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """Path, size and modification time of files, without their content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    )
