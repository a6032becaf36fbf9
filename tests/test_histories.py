"""Histories of open keys: what is kept, what is not, odd histories."""

from pyspark.sql import functions as F

from tillwork.operators.reports import experiments, histories

FULL = """{"epochs": [10, 20, 30], "loss": {"loss": [3.5, NaN, 1], "val_loss": [1], "my own": [1, "x", -Infinity, 9], "n": 4, "\\u00e9\\"q": [1]},
"gradient": {"total": [1, 2], "loss": [5]}, "metrics": {"r@5": [0.1, 0.2, 0.3]}, "final_metrics": {"a": 1.5, "b": null, "c": [1, 2], "d": "x"},
"weight_stats": {"query": {"mean": [1, 2, 3], "histogram": [[1], [2]]}, "rating_head": {"std": [1], "norm": [1]}, "other": {"mean": [1]}},
"gradient_stats": {"candidate": {"norm": [7], "median": [1]}, "query": [1]}, "params": {"epochs": 9, "label": "k"}, "else": {"loss": [1]}}"""
ODD = [(2, None), (3, "no json"), (4, "[]"), (5, '{"epochs": [], "loss": {"loss": [1]}}'), (6, '{"loss": {"loss": [1]}}'), (7, '{"epochs": [0], "weight_stats": [1], "loss": 3, "metrics": null}'), (8, "{}")]


def log_of(spark, rows):
    return spark.createDataFrame(rows, "id long, h string")


def test_every_curve_comes_out_under_its_own_name(spark):
    got = {}
    for r in histories.history_curves(log_of(spark, [(1, FULL), *ODD]), "id", "h").collect():
        assert r["id"] == 1 and r["n_epochs"] == 3 and r["epoch"] == 10 * (r["at"] + 1)
        got.setdefault((r["section"], r["tower"], r["name"]), {})[r["at"]] = r["value"]
    curve = lambda *x: dict(enumerate(x))
    assert got == {
        ("loss", None, "train"): curve(3.5, None, 1.0), ("loss", None, "val"): curve(1.0), ("loss", None, "my own"): curve(1.0, None, None),
        ("loss", None, 'é"q'): curve(1.0), ("gradient", None, "total"): curve(1.0, 2.0), ("gradient", None, "loss"): curve(5.0),
        ("metrics", None, "r@5"): curve(0.1, 0.2, 0.3), ("weight_stats", "query", "mean"): curve(1.0, 2.0, 3.0),
        ("weight_stats", "rating_head", "std"): curve(1.0), ("gradient_stats", "candidate", "norm"): curve(7.0)}


def test_values_and_columns_of_the_log(spark):
    log = log_of(spark, [(1, FULL), *ODD]).withColumn("rate", F.when(F.col("id") == 1, 0.5))
    rows = histories.history_values(log, "id", "h", {"epochs": F.lit(5), "learning_rate": F.col("rate")}).collect()
    assert {(r["section"], r["name"]): r["value"] for r in rows if r["id"] == 1} == {
        ("final_metrics", "a"): "1.5", ("final_metrics", "b"): None, ("final_metrics", "c"): "[1,2]", ("final_metrics", "d"): "x",
        ("params", "label"): "k", ("params", "epochs"): "5", ("params", "learning_rate"): "0.5"}
    assert all({(r["name"], r["value"]) for r in rows if r["id"] == i} == {("epochs", "5"), ("learning_rate", None)} for i, _ in ODD)
    bare = histories.history_values(log, "id", "h").collect()
    assert {r["name"]: r["value"] for r in bare if r["section"] == "params"} == {"epochs": "9", "label": "k"}


def test_summary(spark):
    got = {r["id"]: (r["available"], r["n_epochs"], r["histogram_available"]) for r in histories.history_summary(log_of(spark, [(1, FULL), *ODD]), "id", "h").collect()}
    assert got == {1: (True, 3, True), 2: (False, 0, False), 3: (False, 0, False), **{i: (True, 0, False) for i in (4, 5, 6, 8)}, 7: (True, 1, False)}


def test_sampled_curves_and_the_wide_form_agree(spark):
    import json

    rows = [(i, json.dumps({"epochs": list(range(n)), "loss": {"loss": [i + e / 8 for e in range(n)]}})) for i, n in enumerate([1, 5, 6, 23])]
    log = log_of(spark, rows)
    long_ = experiments.downsample_epochs(histories.history_curves(log, "id", "h")).select("id", "at", "value").collect()
    wide = experiments.downsample_epochs(experiments.flatten_history(log, "id", "h")).select("id", "at", "train").collect()
    assert sorted(map(tuple, long_)) == sorted(map(tuple, wide))
    assert [r["at"] for r in sorted(long_, key=lambda r: r["at"]) if r["id"] == 3] == [0, 5, 10, 15, 20, 22]


def test_histories_are_read_in_one_pass(spark):
    plan = histories.history_curves(log_of(spark, [(1, FULL)]), "id", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("Scan") == 1
