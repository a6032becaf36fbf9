"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept, and its decisions take effect: the classifier's rejects go, one
document of each group of near duplicates stays (five words, similarity 0.8), documents with a passage of the benchmark go,
secrets are replaced in the texts, and the rest is mixed to the sources' targets (rows that the mix takes nothing of go).
All stages but the last return the columns of documents. Nulls, empty texts and repeated rows are treated as the
operators say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm.decontaminate import without_leaks
from tillwork.llm.mixing import mix_sources
from tillwork.llm.neardup import one_of_each_group
from tillwork.llm.ngrams import fit_quality, fold_of, score_quality
from tillwork.llm.secrets import fit_scanner, redact_secrets
from tillwork.session import fresh_path, trim_driver

LEAST_QUALITY = 0.3
_SCORE = "__quality_score"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _trimmed(stage: Stage) -> Stage:
    """``stage``, which leaves to the next jobs of the driver no memory that it or its predecessor has freed."""

    @wraps(stage)
    def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_driver(spark)
        out = stage(spark, docs, sf_dir)
        trim_driver(spark)
        return out

    return trimmed


@_trimmed
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.coalesce(fold_of(F.col("doc_id"), 5) != 0, F.lit(True)))
    score = _SCORE
    while score in map(str.lower, docs.columns):
        score += "_"
    scored = score_quality(docs, fit_quality(docs, labels), keep=docs.columns, name=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).drop(score)


@_trimmed
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, shingle=5, percent=80, bands=31, rows=4)


@_trimmed
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_trimmed
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, fit_scanner(docs))


@_trimmed
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).where("taken > 0")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
