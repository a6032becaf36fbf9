"""Experiment reports. ``log`` has experiment_id, model_type, completed_at, metrics and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.numbers import ratio, rounded
from tillwork.operators.reports.histories import LOSS_NAMES
from tillwork.operators.rolling import running_best
from tillwork.plans.global_order import with_running
from tillwork.session import pin

# Share of experiments that count as good, smoothing, confidence limits, sampling steps.
GOOD_PERCENT = 30
SMOOTH_GOOD, SMOOTH_BAD, LEAST_BAD = 1, 1, 0.001
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 5, 3
EPOCH_STEP, HEATMAP_STEP, HEATMAP_RUNS = 5, 10, 10


def _mean(c: str) -> Column:
    return ratio(F.sum(F.col(c).cast("decimal(28,10)")), F.count(c))


def best_per_group(log: DataFrame, group: str, best: Mapping[str, str]) -> DataFrame:
    """Experiments and best value of each metric (``max`` or ``min``) per group."""
    return log.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[rounded((F.max if how == "max" else F.min)(m), 4).alias(f"best_{m}") for m, how in best.items()])


def top_configurations(log: DataFrame, main: Column, keep: Sequence[str], limit: int = 10) -> DataFrame:
    """Best experiments per model type. ``main`` is the value to be large (negate what must be small)."""
    order = Window.partitionBy("model_type").orderBy(F.col("_main").desc(), F.col("experiment_id").asc())
    return log.withColumn("_main", main).where(F.col("_main").isNotNull()).withColumn(
        "rank_no", F.row_number().over(order)).where(F.col("rank_no") <= limit).select("model_type", "rank_no", *keep)


def metrics_trend(log: DataFrame, best: dict[str, str]) -> DataFrame:
    """Running bests and counts per model type in completion order."""
    rows = log.select("experiment_id", "model_type", "completed_at", *best)
    return running_best(rows, ["completed_at", "experiment_id"], best, group=["model_type"])


def dataset_comparison(log: DataFrame, dataset: str, metrics: Mapping[str, str]) -> DataFrame:
    """Experiments, best and mean metrics per dataset and model type."""
    return log.groupBy(dataset, "model_type").agg(F.count(F.lit(1)).alias("n"), *[
        c for m, how in metrics.items() for c in (
            rounded((F.max if how == "max" else F.min)(m), 4).alias(f"best_{m}"), rounded(_mean(m), 4).alias(f"avg_{m}"))])


# Histories -----------------------------------------------------------------------------------------------

HISTORY_SCHEMA = (
    "epochs array<int>, loss struct<" + ",".join(f"{k}:array<double>" for k in LOSS_NAMES) + ">,"
    "weight_stats struct<query:struct<mean:array<double>,std:array<double>,min:array<double>,max:array<double>>,"
    "candidate:struct<mean:array<double>,std:array<double>,min:array<double>,max:array<double>>>"
)


def flatten_history(log: DataFrame, key: str, history: str) -> DataFrame:
    """One wide row per epoch of a JSON training history: the known losses under their short names, weight statistics
    without histograms. ``histories.history_curves`` gives every curve by its own name."""
    parsed = log.select(key, F.from_json(history, HISTORY_SCHEMA).alias("h"))
    weights = [f"h.weight_stats.{tower}.{s}" for tower in ("query", "candidate") for s in ("mean", "std", "min", "max")]
    sources = {short: f"h.loss.{long}" for long, short in LOSS_NAMES.items()}
    sources |= {w.removeprefix("h.weight_stats.").replace(".", "_"): w for w in weights}
    # A missing curve must be an empty array: zipping with NULL would lose the whole history.
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(F.col("h.epochs").alias("epoch"),
                          *[F.coalesce(F.col(c), none).alias(name) for name, c in sources.items()])
    names = ["epoch", *sources]
    rows = parsed.select(key, F.size("h.epochs").alias("n_epochs"), F.posexplode(zipped).alias("at", "e"))
    return rows.select(key, "n_epochs", "at", *[F.col("e")[n].alias(n) for n in names])


def downsample_epochs(epochs: DataFrame, step: int = EPOCH_STEP) -> DataFrame:
    """Every ``step``-th epoch, the first and the last; short histories stay whole."""
    at, n = F.col("at"), F.col("n_epochs")
    return epochs.where((n <= step) | (F.pmod(at, F.lit(step)) == 0) | (at == n - 1))


def training_heatmap(log: DataFrame, key: str, history: str, main: Column, runs: int = HEATMAP_RUNS,
                     step: int = HEATMAP_STEP) -> DataFrame:
    """Validation loss at every ``step``-th epoch of the best runs, with the range of the colour scale."""
    best = log.withColumn("_main", main).where(F.col("_main").isNotNull()).orderBy(
        F.col("_main").desc(), F.col(key).asc()).limit(runs)
    # The limit bounds what this window sees.
    ranked = best.withColumn("rank_no", F.row_number().over(Window.orderBy(F.col("_main").desc(), F.col(key).asc())))
    epochs = flatten_history(best, key, history)
    cells = epochs.where(F.pmod("epoch", F.lit(step)) == 0).join(ranked.select(key, "rank_no"), key).select(
        key, "rank_no", "epoch", rounded(F.col("val"), 2).alias("loss"))
    scale = Window.partitionBy()  # a few cells of a few runs
    return cells.select("*", F.min("loss").over(scale).alias("scale_min"), F.max("loss").over(scale).alias("scale_max"))


# Parameter scores ----------------------------------------------------------------------------------------

def good_threshold(log: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    """The metric of the last good experiment as one row: the best 30 percent are good, at least one."""
    counted = log.where(F.col(metric).isNotNull()).groupBy(metric).agg(F.count(F.lit(1)).alias("_c"))
    order = F.col(metric).asc() if lower_is_better else F.col(metric).desc()
    run = with_running(counted, [order], {"_upto": ("sum", "_c")}, totals={"_all": "_upto"})
    good = F.greatest(F.lit(1), F.floor(F.col("_all") * GOOD_PERCENT / 100))
    reached = F.when(F.col("_upto") >= good, F.col(metric))
    return run.agg((F.min if lower_is_better else F.max)(reached).alias("threshold"))


def _confidence(n: Column) -> Column:
    return F.when(n >= HIGH_CONFIDENCE, "high").when(n >= MEDIUM_CONFIDENCE, "medium").otherwise("low")


def score_values(rows: DataFrame, metric: str, threshold: Column, lower_is_better: bool = False) -> DataFrame:
    """Score of every (param, value): how much likelier it is among good experiments than among the others."""
    is_good = F.col(metric) <= threshold if lower_is_better else F.col(metric) >= threshold
    found = rows.where(F.col("value").isNotNull() & F.col(metric).isNotNull()).groupBy("param", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_good).alias("n_good"), _mean(metric).alias("_mean"),
        (F.min if lower_is_better else F.max)(metric).alias("_best"))
    whole = (F.col("n") + SMOOTH_GOOD + SMOOTH_BAD).cast("double")
    p_good = (F.col("n_good") + SMOOTH_GOOD) / whole
    p_bad = (F.col("n") - F.col("n_good") + SMOOTH_BAD) / whole
    return found.select(
        "param", "value", "n", "n_good", rounded(p_good / F.greatest(p_bad, F.lit(LEAST_BAD)), 2).alias("score"),
        rounded(F.col("_mean"), 4).alias("avg_metric"), rounded(F.col("_best"), 4).alias("best_metric"),
        _confidence(F.col("n")).alias("confidence"))


def score_parameters(log: DataFrame, params: Sequence[str], metric: str, lower_is_better: bool = False) -> DataFrame:
    rows = log.select(metric, *[F.col(p).cast("string").alias(p) for p in params]).unpivot(
        [metric], list(params), "param", "value")
    return score_values(rows, metric, good_threshold(log, metric, lower_is_better).scalar(), lower_is_better)


def score_lists(log: DataFrame, lists: Sequence[str], metric: str, empty_as: str | None = None,
                lower_is_better: bool = False, top: int | None = None) -> DataFrame:
    """The same over the entries of list columns; an empty list may count as an entry of its own."""
    rows = None
    for name in lists:
        entries = F.col(name)
        if empty_as is not None:
            entries = F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, entries).otherwise(F.array(F.lit(empty_as)))
        one = log.select(metric, F.lit(name).alias("param"), F.explode(entries).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    scored = score_values(rows, metric, good_threshold(log, metric, lower_is_better).scalar(), lower_is_better)
    if top is None:
        return scored
    order = Window.partitionBy("param").orderBy(F.col("score").desc(), F.col("value").asc())
    return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top).drop("_place")


# Coverage ------------------------------------------------------------------------------------------------

def coverage(log: DataFrame, features: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """Every feature and model configuration pair: experiments, best metric, and whether the two fit.

    ``features`` (feature_config, config_type) and ``models`` (model_config, model_type) are the lists that
    users keep by hand; each feature row is unfolded along the list of models.
    """
    listed = models.agg(F.sort_array(F.collect_set(F.struct("model_config", "model_type")))).scalar()
    cells = features.select("feature_config", "config_type", F.explode(listed).alias("m")).select(
        "feature_config", "config_type", "m.model_config", "m.model_type")
    runs = log.groupBy("feature_config", "model_config").agg(
        F.count(F.lit(1)).alias("_n"), F.max(metric).alias("best_metric"))
    fits = F.when(F.col("config_type") == "retrieval", F.col("model_type").isin("retrieval", "multitask")) \
        .when(F.col("config_type") == "ranking", F.col("model_type").isin("ranking", "multitask")).otherwise(True)
    return cells.join(runs, ["feature_config", "model_config"], "left").select(
        "feature_config", "model_config", F.coalesce("_n", F.lit(0)).alias("n"), "best_metric", fits.alias("is_compatible"))


def tested_pairs(log: DataFrame, features: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """The pairs that have experiments, with their number and best metric: as many rows as there were pairs tried."""
    runs = log.groupBy("feature_config", "model_config").agg(F.count(F.lit(1)).alias("n"), F.max(metric).alias("best_metric"))
    known = runs.join(features.select("feature_config").distinct(), "feature_config", "left_semi")
    return known.join(models.select("model_config").distinct(), "model_config", "left_semi").select("feature_config", "model_config", "n", "best_metric")


def untested_pairs(log: DataFrame, features: DataFrame, models: DataFrame, limit: int = 5, compatible_only: bool = True) -> DataFrame:
    """The first ``limit`` pairs without an experiment, in order of feature and model, without forming all pairs.

    Models are numbered in their order (among those that fit the kind of the feature config). What a feature was tried with
    leaves gaps in these numbers; only the first ``limit`` features that have gaps are looked at, and of each gap only
    its first ``limit`` numbers.
    """
    tried = log.select("feature_config", "model_config").distinct()
    if compatible_only:
        kind = F.when(F.col("config_type").isin("retrieval", "ranking"), F.col("config_type")).otherwise("any")
        fitting = F.when(F.col("model_type") == "multitask", F.array(F.lit("any"), F.lit("retrieval"), F.lit("ranking"))) \
            .when(F.col("model_type").isin("retrieval", "ranking"), F.array(F.lit("any"), F.col("model_type"))).otherwise(F.array(F.lit("any")))
    else:
        kind, fitting = F.lit("any"), F.array(F.lit("any"))
    listed = features.select("feature_config", kind.alias("kind")).distinct()
    fits = models.select("model_config", F.explode(fitting).alias("kind")).distinct()
    placed = pin(with_running(fits, [F.col("model_config").asc()], position="place", group=["kind"], group_size="size"), "models")
    sizes = F.broadcast(placed.groupBy("kind").agg(F.max("size").alias("size")))  # three rows at most
    hit = tried.join(listed, "feature_config").join(placed.drop("size"), ["kind", "model_config"]).select("feature_config", "kind", "place")
    open_ = listed.join(sizes, "kind").join(hit.groupBy("feature_config", "kind").agg(F.count(F.lit(1)).alias("_n")), ["feature_config", "kind"], "left")
    first = open_.where(F.coalesce("_n", F.lit(0)) < F.col("size")).select("feature_config", "kind", "size").orderBy("feature_config", "kind").limit(limit)
    first = F.broadcast(pin(first, "first"))  # ``limit`` rows
    at = Window.partitionBy("feature_config", "kind").orderBy("place")
    ends = first.select("feature_config", "kind", (F.col("size") + 1).alias("place"))
    marks = hit.join(first, ["feature_config", "kind"], "left_semi").select("feature_config", "kind", "place").unionByName(ends)
    gaps = marks.withColumn("_from", F.coalesce(F.lag("place").over(at), F.lit(0)) + 1).where(F.col("_from") < F.col("place"))
    numbers = gaps.select("feature_config", "kind", F.explode(F.sequence("_from", F.least(F.col("place") - 1, F.col("_from") + limit - 1))).alias("place"))
    few = numbers.orderBy("feature_config", "place").limit(limit)
    return few.join(placed, ["kind", "place"]).select("feature_config", "model_config").orderBy("feature_config", "model_config")
