"""Snapshot loads, counts of a load, coverage gaps, and generated code that stays small."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tillwork.operators import negatives
from tillwork.operators.reports import experiments
from tillwork.sources import loads


def numbers(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def test_readers_see_the_old_rows_or_the_new_ones(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        loads.read_full(spark, path)
    loads.load_full(numbers(spark, 5, "a"), path)
    held = loads.read_full(spark, path)
    seen = []
    real = loads._publish

    def watched(*args):
        seen.append(loads.read_full(spark, path).select("tag").distinct().collect())  # after the write, before the rename
        real(*args)

    monkeypatch.setattr(loads, "_publish", watched)
    loads.load_full(numbers(spark, 7, "b"), path)
    assert [[r["tag"] for r in x] for x in seen] == [["a"]]
    assert loads.read_full(spark, path).count() == 7 and held.count() == 5  # the one before stays for its readers


def test_a_load_that_ends_in_between_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    loads.load_full(numbers(spark, 5, "a"), path)

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(loads, "_publish", dies)
        loads.load_full(numbers(spark, 7, "b"), path)
    assert loads.read_full(spark, path).count() == 5 and any(n.startswith("_writing-") for n in os.listdir(path))
    for n in (8, 9, 10):
        loads.load_full(numbers(spark, n, "c"), path)
    assert loads.read_full(spark, path).count() == 10
    assert sorted(os.listdir(path)) == ["snapshot=2", "snapshot=3"]
    with pytest.raises(RuntimeError):
        loads._publish(spark, path, "snapshot=2", "snapshot=3")
    assert sorted(os.listdir(path)) == ["snapshot=2", "snapshot=3"]


def test_a_table_may_be_replaced_by_rows_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    loads.load_full(numbers(spark, 5, "a"), path)
    loads.load_full(loads.read_full(spark, path).where("id < 2"), path)
    assert loads.read_full(spark, path).count() == 2
    loads.load_full(loads.read_full(spark, path).limit(0), path)
    assert loads.read_full(spark, path).count() == 0


@pytest.mark.parametrize("limit", [1000, 3])
def test_counts_of_the_write_itself(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(loads, "BATCHES", limit)
    rows = [(b, None if i % 7 == 0 else i) for i, b in enumerate([None, "", "x", "y", "zü"] * 40)]
    df = spark.createDataFrame(rows, "b string, v long").repartition(4)
    path = str(tmp_path / "t")
    got = loads.load_counted(df, F.col("v") % 2 == 0, path, "b").collect()
    want = {}
    for b, v in rows:
        n = want.setdefault(b, [0, 0, 0])
        n[0] += 1
        n[2 if v is not None and v % 2 == 0 else 1] += 1
    if limit == 1000:
        assert {r["b"]: [r["n_read"], r["n_rejected"], r["n_written"]] for r in got} == want
    assert spark.read.parquet(path).count() == sum(n[2] for n in want.values())
    assert {r["b"]: r["n_written"] for r in got if r["b"] is not None} == {b: n[2] for b, n in want.items() if b is not None}
    assert loads.load_counted(df.limit(0), F.col("v") > 0, path, "b").count() == 0


def test_the_source_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = numbers(spark, 100, "a").mapInArrow(passing, "id long, tag string")
    loads.load_counted(df, F.col("id") < 50, str(tmp_path / "t"), "tag")
    assert reads.value == 100


def test_untested_pairs_are_the_first_gaps(spark):
    rng = random.Random(3)
    features = [(f, rng.choice(["retrieval", "ranking", "other", None])) for f in range(30)]
    models = [(m * 3, rng.choice(["retrieval", "ranking", "multitask"])) for m in range(25)]
    log = [(rng.choice(features)[0], rng.choice(models)[0], rng.random()) for _ in range(900)] + [(0, m, 0.5) for m, _ in models] + [(999, 3, 0.1), (1, 1000, 0.2)]
    frame = spark.createDataFrame(log, "feature_config long, model_config long, recall double")
    fc, mc = spark.createDataFrame(features, "feature_config long, config_type string"), spark.createDataFrame(models, "model_config long, model_type string")
    tried = {(f, m) for f, m, _ in log}
    fits = lambda c, m: m in (c, "multitask") if c in ("retrieval", "ranking") else True
    for only in (True, False):
        want = sorted((f, m) for f, c in features for m, k in models if (f, m) not in tried and (fits(c, k) or not only))
        for limit in (1, 5, 60, 5000):
            got = [tuple(r) for r in experiments.untested_pairs(frame, fc, mc, limit, only).collect()]
            assert got == want[:limit], (only, limit)
    tested = {(r["feature_config"], r["model_config"]): r["n"] for r in experiments.tested_pairs(frame, fc, mc, "recall").collect()}
    assert set(tested) == {(f, m) for f, m in tried if f < 30 and m < 75} and sum(tested.values()) == 900 + 25
    assert experiments.untested_pairs(frame, fc.limit(0), mc).count() == 0 and experiments.untested_pairs(frame, fc, mc.limit(0)).count() == 0


def test_negatives_compile_to_small_code(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        pairs = spark.createDataFrame([(c, (c * 7 + i * 13) % 200) for c in range(40) for i in range(6)], "customer_id long, product_id long")
        products = spark.range(200).withColumnRenamed("id", "product_id")
        out = negatives.sample_negatives(pairs, products)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert max(line.count("pmod(") for line in plan.splitlines()) <= 8
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    bought = {(r["customer_id"], r["product_id"]) for r in pairs.collect()}
    assert len(rows) == 4 * len(bought) and not {(r["customer_id"], r["product_id"]) for r in rows} & bought


def test_the_walk_visits_every_place_once(spark):
    a, b = negatives.grid(997)
    df = spark.range(a * b).select(F.col("id").alias("step"), *[F.lit(k * 77777).cast("long").alias(f"k{k}") for k in range(6)])
    places = [r["p"] for r in negatives.with_shuffled_place(df, "step", [f"k{k}" for k in range(6)], a, b, "p").collect()]
    assert sorted(places) == list(range(a * b)) and places != sorted(places)
