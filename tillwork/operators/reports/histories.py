"""Training histories in JSON, opened by the keys that they hold.

A history is one JSON object per run: ``epochs``, curves by name (``loss``, ``gradient``, ``metrics``), curves by tower and
statistic (``weight_stats``, ``gradient_stats``), and single values (``final_metrics``, ``params``). Only these sections are
known beforehand; the names of curves and values are found in the data. Histories are parsed once into a variant and
unfolded by generators, so nothing is shuffled and no list of keys is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short names of losses, towers, and the statistics that are curves (a histogram is not).
LOSS_NAMES = {
    "loss": "train", "val_loss": "val", "total_loss": "total", "val_total_loss": "val_total",
    "regularization_loss": "regularization", "val_regularization_loss": "val_regularization",
}
TOWERS = ("query", "candidate", "rating_head")
STATISTICS = {"weight_stats": ("mean", "std", "min", "max"), "gradient_stats": ("mean", "std", "min", "max", "norm")}
CURVES = ("loss", "gradient", "metrics")
VALUES = ("final_metrics", "params")

_NO_NUMBER = r"(?<=[\[,:\s])-?(?:NaN|Infinity)(?=[\s,\]}])"


def parsed(history: Column) -> Column:
    """The history as a variant; what is no JSON is null.

    Numbers that JSON does not know (NaN, Infinity) become null; a text that looks like such an element does too, if the
    history has them.
    """
    return F.coalesce(F.try_parse_json(history), F.try_parse_json(F.regexp_replace(history, _NO_NUMBER, "null")))


def _entries(rows: DataFrame, of: Column, name: str, value: str) -> DataFrame:
    """One row per entry of an object; anything else has no entries."""
    return rows.select("*", F.explode(F.try_variant_get(of, "$", "map<string,variant>")).alias(name, value))


def _opened(log: DataFrame, key: str, history: str, sections: Sequence[str]) -> DataFrame:
    """``_key``, ``_epochs``, and one row per entry of the wanted sections."""
    rows = log.select(F.col(key).alias("_key"), parsed(F.col(history)).alias("_h"))
    rows = rows.withColumn("_epochs", F.try_variant_get("_h", "$.epochs", "array<bigint>"))
    wanted = _entries(rows, F.col("_h"), "section", "_section").where(F.col("section").isin(*sections)).drop("_h")
    return _entries(wanted, F.col("_section"), "name", "_value").drop("_section")


def history_curves(log: DataFrame, key: str, history: str) -> DataFrame:
    """One row per run, curve and epoch: ``key``, ``section``, ``tower``, ``name``, ``n_epochs``, ``at``, ``epoch``, ``value``.

    Losses carry their short names where they have one, other names stay as they are. ``tower`` is null but for statistics.
    A curve is a list; it may be shorter than the epochs, and what is longer is left out. Entries that are no lists, towers
    and statistics other than the known ones, and histories without epochs, have no rows; an element that is no finite
    number has a null value.
    """
    entries = _opened(log, key, history, [*CURVES, *STATISTICS])
    short = F.col("name")
    for long_, s in LOSS_NAMES.items():
        short = F.when((F.col("section") == "loss") & (F.col("name") == long_), s).otherwise(short)
    known = F.lit(False)
    for section, names in STATISTICS.items():
        known = known | ((F.col("section") == section) & F.col("name").isin(*names))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("tower"), short.alias("name"), F.col("_value").alias("value")))
    inside = F.transform(F.map_entries(F.try_variant_get("_value", "$", "map<string,variant>")),
                         lambda e: F.struct(F.col("name").alias("tower"), e["key"].alias("name"), e["value"].alias("value")))
    is_plain = F.col("section").isin(*CURVES)
    curves = entries.where(is_plain | F.col("name").isin(*TOWERS)).select(
        "_key", "_epochs", "section", F.explode(F.when(is_plain, plain).otherwise(inside)).alias("_c"))
    curves = curves.select("_key", "_epochs", "section", "_c.tower", "_c.name", F.col("_c.value").alias("_value")).where(is_plain | known)
    points = curves.select("*", F.posexplode(F.try_variant_get("_value", "$", "array<variant>")).alias("at", "_x"))
    number = F.try_variant_get("_x", "$", "double")
    finite = F.abs(number) < F.lit(float("inf"))
    return points.where(F.col("at") < F.size("_epochs")).select(
        F.col("_key").alias(key), "section", "tower", "name", F.size("_epochs").alias("n_epochs"), "at",
        F.get("_epochs", F.col("at")).alias("epoch"), F.when(finite, number).alias("value"))


def history_values(log: DataFrame, key: str, history: str, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per run and single value: ``key``, ``section`` (final_metrics or params), ``name``, ``value`` (text).

    ``columns`` are parameters that the log itself knows; they take the place of the history's own of that name, with a null
    value too, and are there for runs without a history. Lists and objects are given as JSON.
    """
    entries = _opened(log, key, history, VALUES)
    columns = dict(columns or {})
    own = entries.where(~((F.col("section") == "params") & F.col("name").isin(*columns))) if columns else entries
    text = F.coalesce(F.try_variant_get("_value", "$", "string"), F.to_json("_value"))
    found = own.select(F.col("_key").alias(key), "section", "name", F.when(~F.is_variant_null("_value"), text).alias("value"))
    if not columns:
        return found
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in columns.items()])
    known = log.select(key, F.lit("params").alias("section"), F.explode(pairs).alias("p"))
    return found.unionByName(known.select(key, "section", "p.name", "p.value"))


def history_summary(log: DataFrame, key: str, history: str) -> DataFrame:
    """One row per run: ``available`` (the history could be read), ``n_epochs`` and ``histogram_available``."""
    rows = log.select(F.col(key), parsed(F.col(history)).alias("_h"))
    some = F.lit(False)
    for section in STATISTICS:
        for tower in TOWERS:
            # Of a list or an object: whether there is anything in it.
            held = F.to_json(F.try_variant_get("_h", f"$.{section}.{tower}.histogram", "variant"))
            some = some | F.coalesce(~held.isin("null", "[]", "{}", "false", "0", '""'), F.lit(False))
    return rows.select(
        key, F.col("_h").isNotNull().alias("available"),
        F.coalesce(F.size(F.try_variant_get("_h", "$.epochs", "array<bigint>")), F.lit(0)).alias("n_epochs"), some.alias("histogram_available"))
