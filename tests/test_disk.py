"""What queries leave on disk and move: shuffle files behind written intermediates, and how often lines are shuffled."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.operators import features, joins, retrieval
from tillwork.plans import training_view
from tillwork.session import pin

EXCHANGE = r"\bExchange (?:hash|range)partitioning"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def shuffled_above(df, operator):
    """How many shuffles lie above the first ``operator`` of a plan."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip()]
    depth = lambda x: re.search(r"[A-Za-z*]", x).start()
    at = next(i for i, x in enumerate(lines) if operator in x)
    found, level = 0, depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level, found = depth(x), found + bool(re.search(EXCHANGE, x))
    return found


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_pin_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    pinned = pin(spark.range(5000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and pinned.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.fixture
def view(spark):
    rows = [(c, "g", f"2020-01-{1 + (c + i) % 9:02} 10:00:00", c % 2, (c * 7 + i * 13) % 40, 1.0 + i) for c in range(30) for i in range(6)]
    facts = spark.createDataFrame(rows, "customer_id long, target_group string, ts string, store_id long, product_id long, sales double")
    facts = facts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    items = spark.range(40).select(F.col("id").alias("product_id"), F.lit("n").alias("name"), F.lit("b").alias("brand"), (F.col("id") % 3).cast("string").alias("category"))
    segments = facts.select("customer_id", F.lit("s").alias("segment"), F.col("ts").alias("updated_at"))
    shops = spark.createDataFrame([(0, "x"), (1, "y")], "store_id long, city string")
    return training_view.LabelledView.of(training_view.training_examples(facts, items, shops, segments))


@pytest.mark.parametrize("point_in_time", [True, False])
def test_negatives_are_shuffled_twice(no_broadcasts, view, point_in_time):
    found = view.negatives(point_in_time=point_in_time)
    assert shuffled_above(found, "posexplode") == 2
    n, positives = found.count(), view.positives().count()
    assert n and n <= 4 * positives and found.where("label <> 0 OR category IS NULL OR ts IS NULL").count() == 0


def test_lines_of_positives_are_not_shuffled_for_their_products_first(no_broadcasts, view):
    assert shuffled_above(view.positives(), "FileScan") == 3


def test_contexts_go_round(spark):
    items = spark.createDataFrame([(1, k, f"i{k}") for k in range(1, 8)] + [(2, 1, "a"), (3, 1, "b"), (1, None, "c")], "who long, k long, item string")
    contexts = spark.createDataFrame([(1, 30, "z", None), (1, 10, "x", 1.0), (1, 20, "y", 2.0), (2, None, None, None), (4, 1, "q", 0.0)], "who long, day int, name string, v double")
    got = joins.round_robin(items, contexts, "who", "k", ["day"])
    assert got.columns == ["who", "k", "item", "day", "name", "v"]
    days = [(10, "x", 1.0), (20, "y", 2.0), (30, "z", None)]
    assert sorted(map(tuple, got.collect())) == [(1, k, f"i{k}", *days[(k - 1) % 3]) for k in range(1, 8)] + [(2, 1, "a", None, None, None)]


def test_exact_lists_in_rounds(spark):
    rng = np.random.default_rng(2)
    m, q = rng.normal(size=(90, 5)).round(2), rng.normal(size=(70, 5)).round(2)
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {}
    for moved in (1, 200, 1 << 24):  # one block of queries a round, two, all
        found = retrieval.topk(frame(q), frame(m), 4, "id", "v", "id", "v", item_block=40, query_block=10, moved=moved)
        got[moved] = sorted(map(tuple, found.select("query_id", "rank_no", "item_id").collect()))
    want = sorted((i, n + 1, j) for i, s in enumerate(q @ m.T) for n, j in enumerate(sorted(range(90), key=lambda j: (-s[j], j))[:4]))
    assert got[1] == got[200] == got[1 << 24] == want


def test_means_of_histories_move_the_vectors_only(no_broadcasts, spark):
    hist = spark.createDataFrame([(1, [1, 2, 2]), (2, [3]), (3, []), (4, None), (None, [1])], "who long, h array<long>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (5, [9.0, 9.0])], "id long, v array<double>")
    out = features.history_mean(hist, "who", "h", vectors, "id", "v", 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = next(x for x in plan[plan.index("Exchange"):].splitlines()[1:] if "Project" in x)
    assert "partial_avg" not in plan[plan.index("Exchange"):] and moved.count("#") == 2
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 3, [1 / 3, 2.0]), (None, 1, [1.0, 0.0])], key=str)
