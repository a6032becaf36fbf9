"""Audit of five text filters in every order, by forward and backward path counts on the lattice of filter subsets.

A state is the set of filters applied so far; an edge applies one more. What an edge removes depends on its state alone, so
the 120 orders of five filters are paths over 80 edges, and each edge is computed once per part of the corpus:

* One scan over the texts says which of the filters A to D a document fails, and a digest of its text.
* E (an identical text under a smaller doc_id) needs the smallest doc_id of each text. Rows are summed by text and doc_id
  first, then by text, so copies of one text meet as a few counted rows.
* What is left are counts by part and set of failed filters: 32 rows a part. Their sums over the edges are joined with the
  orders, which are a constant of the method.

Forward counts say how many orders reach a state, backward counts how many leave it; an edge's removals times both are its
share of the filter's Shapley sum. All of it is DataFrame work but for the scan of the texts (``mapInArrow``).

Cases: a null text is an empty one, and equal to it. A null part counts with the empty string. A null doc_id is never a
duplicate and makes none; two rows with the same doc_id are no duplicates of each other. ``labels`` may repeat an id (a
document counts once if any of its rows says 1), hold nulls, or ids without a document; documents without a label count as
neither good nor toxic. No documents give no rows. Texts are read whole, in pieces cut at white space, so a very long one
costs the set of its distinct words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.text import string_bytes
from tillwork.session import pin

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
MARKUP = b"#$%&*|"

_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that do not begin a code point


def failed_filters(data: bytes) -> int:
    """Bits of the filters A to D (A is 1) that a text fails, given in UTF-8."""
    words, distinct, at = 0, set(), 0
    while at < len(data):
        stop = at + _PIECE
        if stop < len(data):
            cut = _SPACE.search(data, stop)
            stop = cut.start() if cut else len(data)
        piece = data[at:stop].split()  # bytes are split at the six separators, and at nothing else
        words += len(piece)
        distinct.update(piece)
        at = stop
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUES))
    failed = (
        words < LEAST_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points,
        len(data.translate(None, MARKUP)) < len(data))
    return sum(1 << i for i, x in enumerate(failed) if x)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_bytes(batch.column(2))
        digests, masks = [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:z].tobytes()
            digests.append(hashlib.sha256(text).digest())
            masks.append(failed_filters(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["_id", "part", "_text", "_failed"])


def states_and_edges() -> list[tuple[int, int, int, int]]:
    """(state, filter, orders that reach the state, orders from the state after on) for every edge, by path counting."""
    n = len(FILTERS)
    by_size = sorted(range(1 << n), key=int.bit_count)
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    steps = lambda state: [f for f in range(n) if not state >> f & 1]
    for state in by_size:
        for f in steps(state):
            reach[state | 1 << f] += reach[state]
    for state in reversed(by_size):
        for f in steps(state):
            leave[state] += leave[state | 1 << f]
    return [(state, f, reach[state], leave[state | 1 << f]) for state in by_size for f in steps(state)]


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, state before the step, bit of the step's filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, state, 1 << f))
            state |= 1 << f
    return out


def failures(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by ``part`` and ``failed`` (bits of the filters): ``n``, ``good`` (quality 1) and ``toxic``."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("_text"))
    scanned = rows.mapInArrow(_scan, f"_id {rows.schema['_id'].dataType.simpleString()}, part string, _text binary, _failed int")
    # Copies under one id become one row here; the written rows are small, and the texts are read once.
    scanned = pin(scanned.groupBy("_id", "part", "_text", "_failed").agg(F.count(F.lit(1)).alias("_n")), "audit")
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("_good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("_toxic"))
    marked = scanned.where(F.col("_id").isNotNull()).join(flags, F.col("_id") == F.col("_label"), "left").drop("_label")
    marked = marked.unionByName(scanned.where(F.col("_id").isNull()), allowMissingColumns=True).fillna(0, ["_good", "_toxic"])
    # Every row of a text in a part with the same labels, and how many of them have the smallest id there.
    kind = ["_text", "part", "_failed", "_good", "_toxic"]
    by_text = marked.groupBy(*kind).agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_without"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))).alias("_least"))
    first = by_text.groupBy(F.col("_text").alias("_same")).agg(F.min("_least._id").alias("_first"))
    both = by_text.join(first, F.col("_text") == F.col("_same"))
    alone = F.col("_without") + F.when(F.col("_least._id") == F.col("_first"), F.col("_least._n")).otherwise(0)
    each = both.select("part", "_good", "_toxic", F.explode(F.array(
        F.struct(F.col("_failed").alias("failed"), alone.alias("_n")),
        F.struct((F.col("_failed") + F.lit(1 << FILTERS.index("E"))).alias("failed"), (F.col("_n") - alone).alias("_n")))).alias("_x"))
    n = F.col("_x._n")
    return each.groupBy("part", F.col("_x.failed").alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("_good")).alias("good"), F.sum(n * F.col("_toxic")).alias("toxic"))


def audit_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of ``failures``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier), ``unique_fails`` (fail its
    filter only), ``good_lost`` and ``toxic_lost`` (of the removed), and ``shapley`` (the filter's removed over all orders).
    """
    spark = counts.sparkSession
    edges = [F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("filter"), F.lit(reach * leave).alias("paths")) for s, f, reach, leave in states_and_edges()]
    on_edge = counts.withColumn("_e", F.explode(F.array(*edges))).select("*", "_e.*").drop("_e")
    fails = F.col("failed").bitwiseAND(F.col("filter")) != 0
    before = F.col("failed").bitwiseAND(F.col("state")) == 0
    total = lambda here, what="n": F.sum(F.when(here, F.col(what)).otherwise(0))
    sums = on_edge.groupBy("part", "filter", "state", "paths").agg(
        total(before & ~fails).alias("kept"), total(before & fails).alias("removed"), total(~before & fails).alias("redundant"),
        total(F.col("failed") == F.col("filter")).alias("unique_fails"),
        total(before & fails, "good").alias("good_lost"), total(before & fails, "toxic").alias("toxic_lost"))
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    # 16 edges of one filter in a part: the Shapley sum, and the edges again.
    per_filter = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"), F.collect_list(F.struct("state", *measures)).alias("_e"))
    by_edge = per_filter.select("part", "filter", "shapley", F.explode("_e").alias("_e")).select("part", "filter", "shapley", "_e.*")
    steps = spark.createDataFrame(orders(), "filter_order string, step int, _state int, _filter int")
    out = by_edge.join(F.broadcast(steps), (F.col("state") == F.col("_state")) & (F.col("filter") == F.col("_filter")))
    return out.select("part", "filter_order", "step", *measures, "shapley")
