"""Incremental file loads as a stream: new files are picked up exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_new_files(
    spark: SparkSession,
    source: str,
    destination: str,
    checkpoint: str,
    schema,
    fmt: str = "parquet",
    glob: str = "*",
    files_per_batch: int = 1000,
    **options,
) -> None:
    """Append everything that arrived since the last call, then stop.

    The checkpoint is the registry of files. Every micro-batch owns one folder of the destination and
    overwrites it, so a batch that is repeated after a failure does not load rows twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{destination}/batch={batch_id}")

    stream = (
        spark.readStream.format(fmt).schema(schema).options(**options)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(source)
    )
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def loaded(spark: SparkSession, destination: str, schema) -> DataFrame:
    """The rows loaded so far, with the batch that brought them."""
    return spark.read.schema(schema).option("basePath", destination).parquet(f"{destination}/batch=*") \
        .withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int"))
