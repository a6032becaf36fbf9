"""Connected components of links between rows of a DataFrame, without gathering links or components anywhere.

Alternating large-star and small-star steps: every step is one grouping by a node, in which the smallest neighbour is an
aggregate. A node with a third of all links is never collected: its links are only joined with that aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.session import pin


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets linked with the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # links has a > b, so only the larger end of a link moves
    return links.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, gets linked with the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = links.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node with a link in (a, b); the component is its smallest node."""
    now = pin(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    while True:
        now = pin(_small_star(_large_star(now)), label)
        # Done when every node has one link, and its other end is nobody's larger end.
        if now.groupBy("a").count().where("count > 1").isEmpty() and now.join(now.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
