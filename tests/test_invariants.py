"""Properties that must hold whatever the data: splits, negatives, histories, leaks, retrieval."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.operators import evaluate, features, negatives, retrieval, rolling, splits
from tillwork.plans import training_view
from tillwork.plans.feature_model import FeatureSpec
from tillwork.plans.transactions import products, stores, transactions
from tillwork.session import Tables, pin

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, ROOT)


@pytest.fixture(scope="module")
def tx(t):
    return pin(transactions(t), "tx")


def test_splits_are_disjoint_and_complete(tx):
    key = ["order_id", "line_no", "product_id", "store_id"]
    n = tx.count()
    for df in (splits.time_holdout(tx, "ts", 30), splits.random_hash(tx, key), splits.last_days(tx, "ts", 10)):
        assert df.count() == n and df.where(F.col("split").isNull()).count() == 0
    shares = {r["split"]: r["count"] / n for r in splits.random_hash(tx, key).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.05 and abs(shares["test"] - 0.05) < 0.02


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def order_by_hand(size, keys):
    """Places of the catalogue in one customer's order."""
    a, b = negatives.grid(size)
    mixed = lambda x, key: pow(x * 40503 + key, 2, 2147483647) * 48271 % 2147483647 // 16
    out = []
    for step in range(a * b):
        left, right = divmod(step, b)
        for i, key in enumerate(keys):
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        out.append(left * b + right)
    return out


def keys_of(salt, customer):
    return [number(f"{salt}_key{i}_{customer}") for i in range(negatives.ROUNDS)]


def walk_by_hand(bought, catalog, ratio, salt):
    listed, out = sorted(catalog), {}
    for c, have in bought.items():
        free = [listed[place] for place in order_by_hand(len(listed), keys_of(salt, c)) if place < len(listed)]
        out[c] = [p for p in free if p not in have][:ratio * len(have)]
    return out


@pytest.mark.parametrize("chunk", [4096, 16])
def test_negatives_as_by_hand(spark, chunk):
    # One customer owns most pairs; one owns nearly the whole catalogue; the last one a single product.
    catalog = list(range(100, 197))
    bought = {1: set(catalog[:60]), 2: set(catalog[:95]), 3: {catalog[5]}, 4: set(catalog[::7])}
    pos = spark.createDataFrame([(c, p) for c, ps in bought.items() for p in ps] * 2, "customer_id long, product_id long")
    cat = spark.createDataFrame([(p,) for p in catalog], "product_id long")
    rows = negatives.sample_negatives(pos, cat, salt="train", chunk=chunk).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["neg_rank"]):
        got.setdefault(r["customer_id"], []).append(r["product_id"])
    assert got == walk_by_hand(bought, catalog, 4, "train")
    for c, ps in got.items():
        assert not set(ps) & bought[c] and len(set(ps)) == len(ps) == min(4 * len(bought[c]), 97 - len(bought[c]))


def test_every_order_reaches_every_product_and_looks_random():
    for size in (1, 2, 3, 12, 97, 1000, 1009):
        a, b = negatives.grid(size)
        assert a * b >= size and a * b - size <= max(1, size // 20)
        for c in range(3):
            assert sorted(order_by_hand(size, keys_of("train", c))) == list(range(a * b))
    first, size, draws = Counter(), 1000, 40
    for c in range(500):
        places = [p for p in order_by_hand(size, keys_of("train", c)) if p < size][:draws]
        gaps = Counter((y - x) % size for x, y in zip(places, places[1:]))
        assert max(gaps.values()) <= 8  # no stride
        first.update(places)
    counts = np.array([first[p] for p in range(size)])
    assert counts.min() > 2 and counts.max() < 50 and abs(counts.std() / np.sqrt(counts.mean()) - 1) < 0.35


def test_history_is_newest_first_and_bounded(tx):
    pairs = rolling.pair_last_dates(tx)
    last = {(r["customer_id"], r["product_id"]): r["last_ts"] for r in pairs.collect()}
    for r in rolling.purchase_history(pairs, 7).collect():
        h = r["purchase_history"]
        days = [last[r["customer_id"], p] for p in h]
        assert len(h) <= 7 and days == sorted(days, reverse=True)
        mine = [d for (c, _), d in last.items() if c == r["customer_id"]]
        assert days == sorted(mine, reverse=True)[:len(h)]


def test_test_rows_do_not_reach_the_fit(tx):
    labelled = pin(splits.time_holdout(tx, "ts", 60), "labelled")
    in_test = F.col("split") == "test"
    other = labelled.withColumns({
        "sales": F.when(in_test, F.col("sales") * 1000).otherwise(F.col("sales")),
        "quantity": F.when(in_test, -F.col("quantity")).otherwise(F.col("quantity")),
        "priority": F.when(in_test, "unseen").otherwise(F.col("priority")),
    }).drop("split")
    assert other.join(tx, tx.columns, "left_anti").count() > 0
    spec = FeatureSpec(
        ids=("customer_id",), vocabulary={"priority": 1}, scaled=("sales",), bucketed={"quantity": 5},
        crosses=((("quantity", "store_id"), 50),), cyclical={"ts": ("weekly",)},
        target={"column": "sales", "clip_high": 95, "log": True, "norm": "zscore"})
    a = spec.fit(labelled.where(~in_test))
    b = spec.fit(splits.time_holdout(other, "ts", 60).where(~in_test))
    assert np.allclose(a.moments["sales"], b.moments["sales"], rtol=1e-12) and a.boundaries == b.boundaries
    assert np.isclose(a.target.a, b.target.a) and a.target.upper == b.target.upper
    for c in a.vocabularies:
        assert sorted(map(tuple, a.vocabularies[c].collect())) == sorted(map(tuple, b.vocabularies[c].collect()))
    out = a.transform(labelled, keep=["split"])
    assert out.count() == labelled.count() and "ts_weekly_sin" in out.columns and "quantity_x_store_id" in out.columns


def test_labelled_pairs(t):
    facts = transactions(t).withColumnRenamed("priority", "target_group")
    segments = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("segment"),
                               F.col("o_orderdate").alias("updated_at"))
    items = products(t).select("product_id", "name", "brand", "category")
    ex = training_view.training_examples(facts, items, stores(t), segments, ("PROMO",))
    view = training_view.LabelledView.of(ex)
    both = pin(view.pairs(), "both")
    last = ex.select(F.max(F.to_date("ts"))).first()[0]
    assert both.where(F.to_date("ts") >= F.lit(last)).count() == 0
    assert both.join(view.catalog, "product_id", "left_anti").count() == 0
    assert both.where("revenue_pctile < 0 OR revenue_pctile > 1").count() == 0
    assert both.groupBy("customer_id", "product_id").count().where("count > 1").count() == 0
    counts = both.groupBy("customer_id").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    assert counts.where("n - p > 4 * p").count() == 0
    assert both.where("label = 1 AND array_contains(purchase_history, product_id)").count() == 0
    # Every negative borrows a day on which the customer really bought.
    days = facts.select("customer_id", F.to_date("ts").alias("d")).distinct()
    assert both.where("label = 0").withColumn("d", F.to_date("ts")).join(days, ["customer_id", "d"], "left_anti").count() == 0


def test_target_can_be_inverted(tx):
    for norm in (None, "minmax", "zscore"):
        fitted = features.fit_target(tx, "sales", clip_low=1, clip_high=99, log=True, norm=norm)
        y = tx.select(F.col("sales"), fitted.inverse(fitted.transform(F.col("sales"))).alias("back"))
        clipped = F.least(F.greatest("sales", F.lit(fitted.lower)), F.lit(fitted.upper))
        assert y.where(F.abs(clipped - F.col("back")) > 1e-6 * clipped).count() == 0


def vectors(spark, n, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims)).round(2)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, v array<double>").repartition(3)
    return m, df


def test_blocked_top_k_as_numpy(spark):
    m, items = vectors(spark, 150)
    q, queries = vectors(spark, 40, seed=6)
    rows = retrieval.topk(queries, items, 9, "id", "v", "id", "v", item_block=20, query_block=7).collect()
    scores = q @ m.T
    for i in range(len(q)):
        want = sorted(range(len(m)), key=lambda j: (-scores[i, j], j))[:9]
        got = [r["item_id"] for r in sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank_no"])]
        assert got == want


def test_cells_find_most_and_all_cells_find_all(spark):
    _, items = vectors(spark, 200)
    _, queries = vectors(spark, 30, seed=6)
    exact = retrieval.topk(queries, items, 10, "id", "v", "id", "v")
    share = {}
    for searched in (3, 8):
        near = retrieval.topk_in_cells(queries, items, 10, "id", "v", "id", "v", leaves=8, leaves_to_search=searched,
                                       item_block=30, query_block=11)
        share[searched] = evaluate.recall_at_k(near, exact, (10,)).first()["recall"]
    assert share[3] > 0.6 and share[8] == 1.0


def test_recall_grows_with_k(t):
    ranked = retrieval.topk(t.embeddings, t.embeddings, 100, "vec_id", "embedding", "vec_id", "embedding")
    actual = t.embeddings.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("item_id"))
    shares = [r["recall"] for r in evaluate.recall_at_k(ranked, actual).orderBy("k").collect()]
    assert shares == sorted(shares)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (0, None)], "label int, score double")
    assert evaluate.auc(df, "label", "score").first()["auc"] == 0.875


def test_missing_metric_does_not_pass(spark):
    metrics = spark.createDataFrame([("rmse", 0.3)], "metric string, value double")
    limits = spark.createDataFrame([("rmse", 0.4), ("recall_at_5", 0.1)], "metric string, limit_value double")
    got = {r["metric"]: r["passes"] for r in evaluate.metric_gate(metrics, limits).collect()}
    assert got == {"rmse": True, "recall_at_5": None}


def test_top_k_of_text_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = retrieval.topk(df, df, 5, "id", "v", "id", "v", item_block=16, query_block=16).collect()
    want = []
    for q, a in rows:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows)[:5]
        want += [(q, i, -s, rank) for rank, (s, i) in enumerate(found, 1)]
    assert sorted((r["query_id"], r["item_id"], r["score"], r["rank_no"]) for r in got) == sorted(want)


def test_steps_are_found_backwards_and_not_joined_with_what_was_bought(spark):
    a, b, keys = 7, 9, [f"k{i}" for i in range(negatives.ROUNDS)]
    rows = spark.range(a * b).withColumnRenamed("id", "step").withColumns({k: F.lit(1_000_003 * i + 17) for i, k in enumerate(keys)})
    there = negatives.with_shuffled_place(rows, "step", keys, a, b, "place")
    back = negatives.with_step_of(there, "place", keys, a, b, "again").collect()
    assert sorted(r["place"] for r in back) == list(range(a * b)) and all(r["again"] == r["step"] for r in back)
    bought = spark.createDataFrame([(c, p) for c in range(5) for p in range(c, 40, 7)], "customer_id long, product_id long")
    items = spark.range(37).withColumnRenamed("id", "product_id")
    found = negatives.sample_negatives(bought, items, chunk=8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "row_number" not in plan
    pairs = {(r["customer_id"], r["product_id"]) for r in bought.collect()}
    got = [tuple(r) for r in found.collect()]
    for c in range(5):
        mine = [g for g in got if g[0] == c]
        own = len([p for x, p in pairs if x == c and p < 37])
        assert sorted(g[2] for g in mine) == list(range(1, min(4 * own, 37 - own) + 1)) and not pairs & {g[:2] for g in mine}
