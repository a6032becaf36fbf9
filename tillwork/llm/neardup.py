"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set of word shingles gets a 128-bit digest of the whole set, a signature of one byte per hash function,
   and one key per band. Documents with the same set form a class with one representative, so copies are never paired.
2. Representatives that share a band key are candidates. Their signatures are compared in batches; after each batch a
   pair goes on only while the posterior probability (uniform prior) that its similarity reaches the threshold
   is at least ``miss``. Large buckets are split, and every pair of parts is compared in a task of its own.
   A bucket reports a spanning forest of surviving pairs, not the pairs.
3. The components of survivors hold every possible link. Inside them, in parts again, survivors are verified exactly on
   full sets made anew from the texts, and a spanning forest of true links is reported. Pairs whose ends are linked
   already are skipped.
4. Components of true links give every class its group; the smallest document id of a group stays.

A link of similarity s is missed when no band matches, (1 - s**rows)**bands, or when the posterior falls below ``miss``.

Cases: null and empty texts have no set: n_shingles 0, linked with nothing, kept. Texts with fewer words than a shingle
have the whole sequence as one shingle. Copies of a set, and rows that repeat a document id, are one group. A null id
takes no part in choosing the smallest; a row with a null id is given its group's id and is not kept, unless it has
no set or its group no other id (component null, kept). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.llm.columns import Aside
from tillwork.llm.components import components
from tillwork.llm.text import U, Words, as_long, blocks, mix, window_hashes
from tillwork.session import pin

BANDS, ROWS = 25, 5
HASHES = 128
BATCH = 32  # signature places compared before the next decision
MISS = 1e-6
PART = 256  # rows of one side of a comparison


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; of a text with 1 to ``size``-1 words that sequence alone."""
    hashes = words.hashes(0, fold=True)
    runs = window_hashes(hashes, size, 7)
    for base, n in zip(words.first[:-1], words.counts):
        if n >= size:
            yield np.unique(runs[base:base + n - size + 1])
        elif n:
            yield window_hashes(hashes[base:base + n], int(n), 7 + size - int(n))
        else:
            yield np.empty(0, U)


@lru_cache(None)
def _factors(hashes: int) -> np.ndarray:
    return mix(np.arange(1, hashes + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The smallest value of each hash function over each set (sets must not be empty), as 32-bit numbers."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), hashes), np.uint32)
    for k, factor in enumerate(_factors(hashes)):
        out[:, k] = np.minimum.reduceat((flat * factor >> U(32)).astype(np.uint32), at)
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return tuple(int(as_long(np.array([mix(shingles ^ U(seed)).sum(dtype=U)], U))[0]) for seed in (0x51ED270B, 0xA0761D6478BD642F))


def _sign(size: int, bands: int, rows: int, hashes: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = batch.column("doc_id"), batch.column("text_hash")
            for first, stop, words in blocks(batch.column("text"), 1 << 19):
                sets = list(shingle_sets(words, size))
                sums = [digest(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full], hashes)
                    key = np.zeros((len(full), bands), U)
                    for r in range(rows):
                        key = mix(key + values[:, r:bands * rows:rows].astype(U))
                    key = as_long(mix(key + np.arange(bands, dtype=U)))
                    for i, k, v in zip(full, key, (values & 0xFF).astype(np.uint8)):
                        keys[i], sig[i] = k, v.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(first, stop - first), "text_hash": text_hash.slice(first, stop - first), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array([s[0] for s in sums], pa.int64()), "d2": pa.array([s[1] for s in sums], pa.int64()),
                    "signature": pa.array(sig, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                })

    return sign


@lru_cache(None)
def least_matches(places: int, threshold: float, miss: float) -> int:
    """The fewest equal places with which the posterior P(similarity >= threshold) still is ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, places - m + 1), whose tail is a binomial sum.
    """
    n = places + 1
    tail = 0.0
    for m in range(places + 1):  # P(Beta(m + 1, n - m) >= t) = P(Binomial(n, t) <= m)
        tail += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return places + 1


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Of the pairs (a[left], b[right]) those that no batch of signature places rules out."""
    alive = np.arange(len(left))
    same = np.zeros(len(left), np.int32)
    for at in range(0, a.shape[1], BATCH):
        stop = min(at + BATCH, a.shape[1])
        same[alive] += (a[left[alive], at:stop] == b[right[alive], at:stop]).sum(axis=1, dtype=np.int32)
        alive = alive[same[alive] >= least_matches(stop, threshold, miss)]
        if not len(alive):
            break
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low), np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def in_parts(rows: DataFrame, key: list[str], part: int, member: str, label: str) -> DataFrame:
    """Rows of every key that has two or more, once for each pair of its parts: adds part_a, part_b and side.

    A key of n rows has ceil(n / part) parts by the member's hash; (p, q) with p <= q holds the rows of p and q.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("_n") / part).cast("int").alias("_parts"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    match = on[0]
    for o in on[1:]:
        match = match & o
    own = F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")
    found = rows.join(sizes, match).withColumn("_own", own).drop(*[f"_{k}" for k in key])
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("p"), F.greatest(o, F.col("_own")).alias("q")))
    return found.withColumn("_pq", F.explode(pairs)).withColumns({"part_a": F.col("_pq.p"), "part_b": F.col("_pq.q")}).drop("_pq", "_parts")


def _group_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in by:
        column = table.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a partition sorted by ``by``, and the row where each group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _group_starts(table, by)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
            held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _group_starts(table, by)


def pairs_in_groups(starts: np.ndarray, n: int, side: np.ndarray, part_a: np.ndarray, part_b: np.ndarray, limit: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of one group; in a group of two parts one of each part. Some at a time, never all of a table."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    left, right, held = [], [], 0
    for d in range(1, n):
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        i = i[(part_a[i] == part_b[i]) | (side[i] != side[i + d])]
        left.append(i), right.append(i + d)
        held += len(i)
        if held >= limit:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _candidates(threshold: float, miss: float):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "part_a", "part_b"]):
            ids = table.column("doc_class").to_numpy()
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            side, a, b = (table.column(c).to_numpy() for c in ("_own", "part_a", "part_b"))
            labels = np.arange(len(ids))
            for left, right in pairs_in_groups(starts, len(ids), side, a, b):
                open_ = labels[left] != labels[right]
                left, right = left[open_], right[open_]
                alive = surviving(sig, sig, left, right, threshold, miss)
                labels = forest_on(labels, left[alive], right[alive])
            linked = np.flatnonzero(labels != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[linked]), "b": pa.array(ids[labels[linked]])})

    return candidates


def forest_on(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest connected place) after more pairs."""
    if not len(a):
        return labels
    nodes = np.flatnonzero(labels != np.arange(len(labels)))
    return forest(len(labels), np.concatenate([nodes, a]), np.concatenate([labels[nodes], b]))


def _verify(size: int, hashes: int, percent: int, miss: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["component", "part_a", "part_b"], least=1000):
            ids = table.column("doc_class").to_numpy()
            side, a, b = (table.column(c).to_numpy() for c in ("_own", "part_a", "part_b"))
            sets = [s for _, _, words in blocks(table.column("text"), 1 << 19) for s in shingle_sets(words, size)]
            lengths = np.array([len(s) for s in sets])
            sig = (np.concatenate([signatures(sets[i:i + 256], hashes) for i in range(0, len(sets), 256)]) & 0xFF).astype(np.uint8)
            labels = np.arange(len(ids))
            for left, right in pairs_in_groups(starts, len(ids), side, a, b):
                low, high = np.minimum(lengths[left], lengths[right]), np.maximum(lengths[left], lengths[right])
                open_ = (labels[left] != labels[right]) & (100 * low >= percent * high)
                left, right = left[open_], right[open_]
                alive = surviving(sig, sig, left, right, percent / 100, miss)
                for i, j in zip(left[alive].tolist(), right[alive].tolist()):
                    x, y = i, j
                    while labels[x] != x:
                        x = labels[x]
                    while labels[y] != y:
                        y = labels[y]
                    if x == y:
                        continue
                    both = len(sets[i]) + len(sets[j])
                    common = both - len(_union(sets[i], sets[j]))
                    if 100 * common >= percent * (both - common):
                        labels[max(x, y)] = min(x, y)
                labels = forest(len(labels), np.arange(len(labels)), labels)
            linked = np.flatnonzero(labels != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[linked]), "b": pa.array(ids[labels[linked]])})

    return verify


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([a, b]))
    keep = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=keep[1:])
    return both[keep]


def near_duplicate_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS,
    hashes: int = HASHES, miss: float = MISS, part: int = PART,
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per row of ``docs``.

    Links: 100 * |intersection| >= percent * |union| of the sets of ``shingle`` words.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = pin(docs.mapInArrow(_sign(shingle, bands, rows, hashes), "doc_id long, text_hash long, n long, d1 long, d2 long, signature binary, keys array<long>"), "neardup-signed")
    # One row per distinct set. Its number is a hash of the digest; the digest itself tells classes apart.
    classes = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = pin(classes.withColumn("doc_class", F.xxhash64("n", "d1", "d2")), "neardup-classes")
    banded = classes.select("doc_class", F.explode("keys").alias("key"))
    members = in_parts(banded, ["key"], 2 * part, "doc_class", "neardup-buckets")
    compared = members.join(classes.select(F.col("doc_class").alias("_class"), "signature"), F.col("doc_class") == F.col("_class"))
    compared = compared.select("key", "part_a", "part_b", "_own", "doc_class", "signature")
    links = (compared.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b", "_own", "doc_class")
             .mapInArrow(_candidates(percent / 100, miss), "a long, b long"))
    coarse = components(links, "neardup-coarse")
    picked = coarse.join(classes.select("doc_class", "row"), F.col("node") == F.col("doc_class")).select("component", "doc_class", "row")
    # One text of each class: that of its first row, which other rows may repeat.
    of_row = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_hash") == F.col("row.text_hash"))
    texts = docs.join(picked, of_row).select("doc_class", "component", "text").dropDuplicates(["doc_class"])
    verified = in_parts(picked.select("component", "doc_class"), ["component"], part, "doc_class", "neardup-parts").join(
        texts.select(F.col("doc_class").alias("_class"), "text"), F.col("doc_class") == F.col("_class"))
    true_links = (verified.select("component", "part_a", "part_b", "_own", "doc_class", "text")
                  .repartition("component", "part_a", "part_b").sortWithinPartitions("component", "part_a", "part_b", "_own", "doc_class")
                  .mapInArrow(_verify(shingle, hashes, percent, miss), "a long, b long"))
    groups = components(true_links, "neardup-links")
    in_group = classes.select("doc_class", "n", "d1", "d2", "first_id").join(groups, F.col("doc_class") == F.col("node"), "left")
    in_group = in_group.withColumn("group", F.coalesce("component", "doc_class"))
    least = in_group.groupBy(F.col("group").alias("_group")).agg(F.min("first_id").alias("component_id"))
    of_class = in_group.join(least, F.col("group") == F.col("_group")).select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "component_id")
    out = signed.join(of_class, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: one of every group, and everything without a group.

    Rows equal in id and text stay once. Columns may have any names.
    """
    aside = Aside(docs)
    gone = near_duplicate_groups(docs, doc_id=doc_id, text=text, **options).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    key, text_hash = F.col(aside.name(doc_id)).cast("long"), F.xxhash64(aside.name(text))
    same = key.eqNullSafe(F.col("_gone_id")) & (text_hash == F.col("_gone_text"))
    # The join has brought rows of one id and text together.
    copy = W.partitionBy(key, text_hash).orderBy(F.lit(1))
    return aside.rows.join(gone, same, "left_anti").withColumn("_copy", F.row_number().over(copy)).where("_copy = 1").select(*aside.back())
