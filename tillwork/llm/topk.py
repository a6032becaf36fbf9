"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: component j of a vector is the weight of term j, zeros are absent. Candidates are
packed into blocks that hold one posting list (places, weights) per term. A task holds one block of candidates and one
block of queries; every query adds its weight times each posting to a dense array with one score per candidate. A
partial selection leaves k rows for each query and block, and a window merges the blocks.

The queries are a stated set, met with all rows block by block. Numbers of blocks follow from rows, so no task grows
with the table. Cases: vectors that are null, hold a null or a component that is not finite take no part, on either
side; empty vectors have score 0 with everything; of vectors of different lengths the common terms count. A query's own
rows are all rows with its id, so rows that repeat an id never find each other. Rows with a null id take no part. Equal
candidates (ties) are ordered by id. Rows that repeat id and vector are counted before they are packed, and each of them
takes a rank: a candidate there twice is listed twice, and so is every candidate of a query there twice. Components and
scores are 64-bit integers: those beyond that range become its end. An empty side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.session import pin

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
_AT_ONCE = 64  # queries whose score arrays are filled together
_RANGE = (1 << 63) - 1


def _packed(rows: DataFrame, block: Column, label: str) -> DataFrame:
    """(block, ids, copies, weights of all rows, length of each row), one row per block."""
    grouped = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "vector", "copies")).alias("rows"))
    return pin(grouped.select(
        "block", F.col("rows.id").alias("ids"), F.col("rows.copies").alias("copies"), F.flatten(F.col("rows.vector")).alias("weights"),
        F.transform("rows", lambda r: F.size(r["vector"])).alias("lengths"),
    ), label)


def _arrays(table: pa.Table, row: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies, and a dense matrix of weights (rows x terms) of one block."""
    take = lambda name: table[side + name][row].values.to_numpy(zero_copy_only=False)
    ids, copies, weights, lengths = take("ids"), take("copies"), take("weights"), take("lengths")
    width = int(lengths.max(initial=0))
    matrix = np.zeros((len(ids), width), np.int64)
    matrix[np.arange(width)[None, :] < lengths[:, None]] = weights
    return ids, copies, matrix


def _accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    scores = np.zeros((len(queries), n), postings[0][1].dtype if postings else np.int64)
    for term, (places, weights) in enumerate(postings[:queries.shape[1]]):
        who = np.flatnonzero(queries[:, term])
        factors = queries[who, term].astype(weights.dtype)
        if places is None:  # a posting list with nearly every candidate is stored without places
            for q, factor in zip(who, factors):
                scores[q] += factor * weights
        else:
            for q, factor in zip(who, factors):
                scores[q, places] += factor * weights
    return scores


def _block_top(k: int):
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(table.num_rows):
                ids, copies, matrix = _arrays(table, row, "c_")
                query_ids, query_copies, queries = _arrays(table, row, "q_")
                largest = max(1, int(np.abs(matrix).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, matrix.shape[1])
                kind = np.int32 if largest < 1 << 31 else np.int64 if largest <= _RANGE else object
                by_id = np.argsort(ids, kind="stable")
                ids, copies, matrix = ids[by_id], copies[by_id], matrix[by_id].astype(kind)
                postings = []
                for column in np.ascontiguousarray(matrix.T):
                    places = np.flatnonzero(column)
                    postings.append((None, column) if 2 * len(places) > len(column) else (places, column[places]))
                for at in range(0, len(query_ids), _AT_ONCE):
                    own = query_ids[at:at + _AT_ONCE]
                    scores = _accumulate(queries[at:at + _AT_ONCE], postings, len(ids))
                    found_q, found_c, found_s = [], [], []
                    for q, times, line in zip(own, query_copies[at:at + _AT_ONCE], scores):
                        first, last = np.searchsorted(ids, q), np.searchsorted(ids, q, "right")
                        spare = k + (last - first)
                        if len(line) > spare:
                            cut = np.partition(line, len(line) - spare)[len(line) - spare]
                            found = np.flatnonzero(line >= cut)
                        else:
                            found = np.arange(len(line))
                        found = found[(found < first) | (found >= last)]
                        best = found[np.argsort(-line[found].astype(np.int64 if kind is not object else object), kind="stable")[:k]]
                        best = np.repeat(best, copies[best] * times)[:k]
                        score = line[best] if kind is not object else np.clip(line[best], -_RANGE - 1, _RANGE)
                        found_q.append(np.full(len(best), q)), found_c.append(ids[best]), found_s.append(score.astype(np.int64))
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.concatenate(found_q).astype(np.int64), "vec_id": np.concatenate(found_c).astype(np.int64),
                        "score": np.concatenate(found_s).astype(np.int64),
                    })

    return top


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
    candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row that ``is_query`` marks."""
    component = lambda x: F.greatest(F.lit(-_RANGE), F.floor(x.cast("double") * scale).cast("long"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(vector, component).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    # More than k copies of a row say no more than k do.
    rows = pin(rows.groupBy("id", "vector").agg(
        F.least(F.lit(k), F.count(F.lit(1))).alias("copies"), F.least(F.lit(k), F.count_if("query")).alias("query_copies")), "topk-rows")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("query_copies") > 0)).first()
    blocks, query_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    candidates = _packed(rows, F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)), "topk-candidates")
    asked = rows.where("query_copies > 0").select("id", "vector", F.col("query_copies").alias("copies"))
    queries = _packed(asked, F.pmod(F.xxhash64("id", "vector", F.lit(2)), F.lit(query_blocks)), "topk-queries")
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in candidates.columns])
    q = queries.select(*[F.col(x).alias(f"q_{x}") for x in queries.columns], F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("_for"))
    pairs = c.join(q.repartition(blocks * query_blocks, "_for", "q_block").hint("shuffle_merge"), F.col("c_block") == F.col("_for"))
    partial = pairs.select(*[f"{side}_{x}" for side in "cq" for x in ("ids", "copies", "weights", "lengths")]).mapInArrow(_block_top(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
