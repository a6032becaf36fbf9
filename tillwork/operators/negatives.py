"""Sampled negatives without forming customers x products."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.hashing import hash_number
from tillwork.plans.global_order import with_running
from tillwork.session import pin

CHUNK = 4096
ROUNDS = 6


def grid(size: int) -> tuple[int, int]:
    """Sides (a, b) of a grid with at least ``size`` cells and as few more as possible; b is near the square root."""
    root = max(1, math.isqrt(size))
    b = min(range(max(1, root // 2), 2 * root + 1), key=lambda x: (-size % x, x))
    return -(-size // b), b


def with_shuffled_place(df: DataFrame, step: str, keys: list[str], a: int, b: int, name: str) -> DataFrame:
    """Add a keyed permutation of 0 .. a*b-1: rounds that add a mixed function of one grid side to the other.

    A round is two projections. What one of them makes is used twice in the next, so the optimizer keeps them apart and the
    generated code grows with the rounds; as one expression it would double with every round. The result can't be null, else
    a join on it would have the optimizer push a null check of that one expression down to the steps.
    """
    sides = [f"{name}_left", f"{name}_right"]
    out = df.withColumns({sides[0]: F.floor(F.col(step) / b), sides[1]: F.pmod(step, F.lit(b))})
    for i, key in enumerate(keys):
        mine, other, size = sides[i % 2], sides[1 - i % 2], (a, b)[i % 2]
        v = F.col(f"{name}_v")
        out = out.withColumn(f"{name}_v", F.pmod(F.col(other) * 40503 + F.col(key), F.lit(2147483647)))
        mixed = F.floor(F.pmod(F.pmod(v * v, F.lit(2147483647)) * 48271, F.lit(2147483647)) / 16)
        out = out.withColumn(mine, F.pmod(F.col(mine) + mixed, F.lit(size)))
    return out.withColumn(name, F.coalesce(F.col(sides[0]) * b + F.col(sides[1]), F.lit(-1))).drop(*sides, f"{name}_v")


def with_step_of(df: DataFrame, place: str, keys: list[str], a: int, b: int, name: str) -> DataFrame:
    """The inverse of ``with_shuffled_place``: the step that leads to a place."""
    sides = [f"{name}_left", f"{name}_right"]
    out = df.withColumns({sides[0]: F.floor(F.col(place) / b), sides[1]: F.pmod(place, F.lit(b))})
    for i, key in reversed(list(enumerate(keys))):
        mine, other, size = sides[i % 2], sides[1 - i % 2], (a, b)[i % 2]
        v = F.col(f"{name}_v")
        out = out.withColumn(f"{name}_v", F.pmod(F.col(other) * 40503 + F.col(key), F.lit(2147483647)))
        mixed = F.floor(F.pmod(F.pmod(v * v, F.lit(2147483647)) * 48271, F.lit(2147483647)) / 16)
        out = out.withColumn(mine, F.pmod(F.col(mine) - mixed, F.lit(size)))
    return out.withColumn(name, F.coalesce(F.col(sides[0]) * b + F.col(sides[1]), F.lit(-1))).drop(*sides, f"{name}_v")


def _number(salt: str, what: str, customer: str) -> Column:
    return hash_number(F.concat(F.lit(f"{salt}_{what}_"), F.col(customer).cast("string")))


def sample_negatives(
    positives: DataFrame,
    catalog: DataFrame,
    ratio: int = 4,
    salt: str = "train",
    customer: str = "customer_id",
    product: str = "product_id",
    chunk: int = CHUNK,
    attributes: DataFrame | None = None,
) -> DataFrame:
    """``ratio`` products per positive that the customer never bought, numbered by ``neg_rank``.

    ``attributes`` are joined to the products by ``product``; they come with the join of the places, so that no negative is
    shuffled once more for them.

    Every customer walks through the catalogue in an own pseudo-random order: a permutation of the places of a
    grid, keyed by a salted hash of the customer; the few places past the catalogue's end are passed over. The
    first (ratio + 1) * p steps inside the catalogue meet at most p products of a customer with p positives, so they
    hold enough negatives (or the whole catalogue). The work is proportional to the positives.

    Walks are cut into chunks of bounded length, which are spread over tasks. The permutation is read backwards to find the
    steps that meet a bought product; they are taken out of a chunk before it is unfolded, so that neither steps nor
    negatives are joined with what was bought. Negatives are numbered inside a chunk, and only the counts of the chunks of
    long walks are added up per customer.
    """
    listed = pin(with_running(catalog.select(product).distinct(), [F.col(product).asc()], position="_place"),
                 "catalog")
    size = listed.count()
    # Read by the walk lengths and the anti joins: written once instead of scanning the facts each time.
    bought = pin(positives.select(customer, product).distinct().join(listed.select(product), product, "left_semi"),
                 "bought")
    if size == 0:
        none = bought.withColumn("neg_rank", F.lit(None).cast("bigint")).limit(0)
        return none if attributes is None else none.join(attributes, product).select(*none.columns, *[c for c in attributes.columns if c != product])
    rows, columns = grid(size)
    spare = rows * columns - size
    # Written: read for the chunks, the steps to pass over and long walks, and its hashes stay out of the code of the rounds.
    walks = pin(bought.groupBy(customer).agg(F.count(F.lit(1)).alias("_p")).select(
        customer, "_p", F.least(F.col("_p") * (ratio + 1) + spare, F.lit(size + spare).cast("bigint")).alias("_length"),
        *[_number(salt, f"key{i}", customer).alias(f"_key{i}") for i in range(ROUNDS)]), "walks")
    keys = [f"_key{i}" for i in range(ROUNDS)]
    # Steps to pass over: those of bought products, and of the few places past the end.
    places = bought.join(listed, product).select(customer, (F.col("_place") - 1).alias("_at"))
    if spare:
        past = F.explode(F.sequence(F.lit(size).cast("bigint"), F.lit(size + spare - 1).cast("bigint")))
        places = places.unionByName(walks.select(customer, past.alias("_at")))
    met, inside = with_step_of(places.join(walks, customer), "_at", keys, rows, columns, "_step"), F.col("_step") < F.col("_length")
    # No filter: it would be pushed below the rounds and doubled by each. Steps past a walk's end are one empty row per customer.
    # Never null, else the join on it would push a null check down there.
    chunk_of = F.coalesce(F.when(inside, F.floor(F.col("_step") / chunk)).cast("bigint"), F.lit(-1).cast("bigint"))
    passed = met.groupBy(customer, chunk_of.alias("_chunk")).agg(F.collect_list(F.when(inside, F.col("_step"))).alias("_passed"))

    def survivors(of: DataFrame) -> DataFrame:
        """Per chunk the steps of the walk that meet a product the customer never bought."""
        last_chunk = F.floor((F.col("_length") - 1) / chunk).cast("bigint")
        chunks = of.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
        first = F.col("_chunk") * chunk
        until = F.least(first + chunk, F.col("_length")) - 1
        left = F.array_except(F.sequence(first, until), F.coalesce("_passed", F.array().cast("array<bigint>")))
        return chunks.join(passed, [customer, "_chunk"], "left").withColumn("_steps", left).drop("_passed")

    before = Window.partitionBy(customer).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        survivors(walks.where(F.col("_length") > chunk)).select(customer, "_chunk", F.size("_steps").alias("_n"))
        .select(customer, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    left = survivors(walks).join(offsets, [customer, "_chunk"], "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    wanted = F.greatest(F.lit(0), F.least(F.lit(chunk), F.col("_p") * ratio - F.col("_before"))).cast("int")
    steps = left.select(customer, *keys, "_before", F.posexplode(F.slice("_steps", F.lit(1), wanted)).alias("_at", "_step"))
    known = listed if attributes is None else listed.join(attributes, product)
    return (
        with_shuffled_place(steps, "_step", keys, rows, columns, "_cell")
        .select(customer, (F.col("_before") + F.col("_at") + 1).alias("neg_rank"), (F.col("_cell") + 1).alias("_place"))
        .join(known, "_place").select(customer, product, "neg_rank", *[c for c in known.columns if c not in (product, "_place")])
    )
