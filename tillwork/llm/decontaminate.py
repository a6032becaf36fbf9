"""Benchmark decontamination with spaced-seed hashes.

A leak is a run of 13 words of a text that agrees with 13 consecutive words of a benchmark item in 11 places or more
(similarity above 0.8), word by word, whatever was put in place of the others. Words are compared without case (A-Z)
and without ASCII punctuation around them. Fixed masks of span 10 look at 6 words and ignore 4; any two of 13 places are
ignored by some mask at some offset, so every such run shares at least one seed hash with its item.

Test windows that are equal are one class. Their seed hashes fill a bitmap of fixed size, which is broadcast; training
positions that pass it are joined with the test hashes, and each hit is verified on the 13 words around it. All
hits of one document with one class at one place count once, so a passage in many items and many texts gives no pairs
of items and texts.

Cases: null and empty texts and items have no words and match nothing. Items of 5 to 12 words are one window as long as the
item and must agree in every word; shorter items can't be told from chance and are not searched. Items that are equal
or share a window are reported under the smallest item id; null item ids come last. Rows that repeat a
document id are judged by their own text, and equal rows are reported once. A null doc_id is kept as null.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.columns import Aside
from tillwork.llm import sketch
from tillwork.llm.text import U, Words, as_long, blocks, mix, window_hashes
from tillwork.session import pin

WINDOW = 13
AGREE = 11
MASKS = ("1101010011", "1100110101", "1011110001")
SHORTEST = 5
_SPAN = len(MASKS[0])
_SEED_BITS = 24

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))] = True


def core_words(words: Words) -> Words:
    """Drop ASCII punctuation from both ends of every word, and words without anything else."""
    solid = np.flatnonzero(~_PUNCTUATION[words.data])
    first, last = np.searchsorted(solid, words.start), np.searchsorted(solid, words.end)
    keep = last > first
    text = words.text[keep]
    words.start, words.end = solid[first[keep]], solid[last[keep] - 1] + 1
    words.first = np.searchsorted(text, np.arange(len(words.counts) + 1))
    words.counts = np.diff(words.first)
    words._hashes.clear()
    return words


def seed_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words that a mask looks at, for each place where it fits."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), number + 1, U)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out *= U(0xD1342543DE82EF95)
            out += hashes[k:k + n]
    return mix(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of test items: (item_id, size, w: word hashes)."""
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        rows = {"item_id": [], "size": [], "w": []}
        for first, stop, words in blocks(batch.column("text")):
            words = core_words(words)
            hashes = as_long(words.hashes(0, True))
            for i in range(first, stop):
                base, n = words.first[i - first], words.counts[i - first]
                size = min(int(n), WINDOW)
                if size < SHORTEST:
                    continue
                for at in range(base, base + n - size + 1):
                    rows["item_id"].append(ids[i]), rows["size"].append(size), rows["w"].append(hashes[at:at + size])
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(rows["item_id"], pa.int64()), "size": pa.array(rows["size"], pa.int32()), "w": pa.array(rows["w"], pa.list_(pa.int64()))})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, shift, class, size, w): a training seed at p belongs to the window that starts at p - shift."""
    for batch in batches:
        out: dict[str, list] = {"hash": [], "shift": [], "row": []}
        lists = batch.column("w")
        for row in range(batch.num_rows):
            w = lists[row].values.to_numpy().view(U)
            if len(w) == WINDOW:
                for number, mask in enumerate(MASKS):
                    seeds = seed_hashes(w, mask, number)
                    out["hash"].append(seeds), out["shift"].append(np.arange(len(seeds))), out["row"].append(np.full(len(seeds), row))
            else:
                out["hash"].append(window_hashes(w, len(w), 50 + len(w))), out["shift"].append(np.zeros(1, np.int64)), out["row"].append(np.array([row]))
        if out["hash"]:
            row = pa.array(np.concatenate(out["row"]))
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(as_long(np.concatenate(out["hash"]))), "shift": pa.array(np.concatenate(out["shift"]).astype(np.int32)),
                "class": batch.column("class").take(row), "size": batch.column("size").take(row),
            })


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = sketch.Sketch(_SEED_BITS)
    for batch in batches:
        keys = batch.column("hash").to_numpy().view(U)
        own.add(np.concatenate([keys, keys]))
    yield from own.parts()


def _hits(shared, sizes: tuple[int, ...]):
    """Training places whose seed hash may be a test seed, with the word hashes that a window there can cover."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = np.frombuffer(shared.value, np.uint8).reshape(sketch.ROWS, -1)
        for batch in batches:
            for first, stop, words in blocks(batch.column("text")):
                words = core_words(words)
                hashes = words.hashes(0, True)
                if not len(hashes):
                    continue
                found = [(window_hashes(hashes, s, 50 + s), words.windows(s)) for s in sizes]
                places = words.windows(_SPAN)
                found += [(seed_hashes(hashes, mask, number), places) for number, mask in enumerate(MASKS)]
                all_hash, all_at = [], []
                for keys, at in found:
                    keys = keys[at]
                    passed = sketch.maybe_repeated(bitmaps, keys, _SEED_BITS)
                    all_hash.append(keys[passed]), all_at.append(at[passed])
                h, at = np.concatenate(all_hash), np.concatenate(all_at)
                if not len(h):
                    continue
                by = np.argsort(at, kind="stable")
                h, at = h[by], at[by]
                # Hits near each other share one stretch of words: what any of their windows can cover.
                row = np.searchsorted(words.first, at, "right") - 1
                new = np.append(True, (np.diff(at) > WINDOW) | (np.diff(row) > 0))
                start = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                ends = np.append(start[1:], len(at)) - 1
                low = np.maximum(at[start] - WINDOW, words.first[row[start]])
                high = np.minimum(at[ends] + 2 * WINDOW, words.first[row[start] + 1])
                offsets = pa.array(np.append(start, len(at)).astype(np.int32))
                stretch = [as_long(hashes[a:z]) for a, z in zip(low, high)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(first + row[start])), "text_hash": batch.column("text_hash").take(pa.array(first + row[start])),
                    "low": pa.array((low - words.first[row[start]]).astype(np.int32)),
                    "hashes": pa.ListArray.from_arrays(offsets, pa.array(as_long(h))),
                    "places": pa.ListArray.from_arrays(offsets, pa.array((at - low[group]).astype(np.int32))),
                    "words": pa.array(stretch, pa.list_(pa.int64())),
                })

    return hits


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document: doc_id, text_hash, item_id (smallest), n_windows, n_words (words of the text in
    leaking runs), similarity (best run) and spans (first word and words of each run)."""
    spark = docs.sparkSession
    windows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_windows, "item_id long, size int, w array<long>")
    classes = pin(windows.groupBy("size", "w").agg(F.min("item_id").alias("item_id")).withColumn("class", F.monotonically_increasing_id()), "leak-windows")
    index = pin(classes.select("class", "size", "w").mapInArrow(_index, "hash long, shift int, class long, size int"), "leak-seeds")
    bitmap = sketch.merged(index.select("hash").mapInArrow(_fill, sketch.SCHEMA), _SEED_BITS)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    sizes = tuple(r[0] for r in classes.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most 8 numbers
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    stretches = pin(
        rows.mapInArrow(_hits(shared, sizes), "doc_id long, text_hash long, low int, hashes array<long>, places array<int>, words array<long>")
        .withColumn("uid", F.monotonically_increasing_id()), "leak-stretches")
    places = stretches.select("uid", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("uid", F.col("x.hashes").alias("h"), F.col("x.places").alias("p"))
    found = places.join(index, F.col("h") == F.col("hash")).select("uid", (F.col("p") - F.col("shift")).alias("at"), "class").where("at >= 0").distinct()
    words = stretches.select(F.col("uid").alias("_uid"), "doc_id", "text_hash", "low", "words")
    tests = classes.select(F.col("class").alias("_class"), "size", "w", "item_id")
    compared = found.join(words, F.col("uid") == F.col("_uid")).where("at + 5 <= size(words)")
    compared = compared.select("doc_id", "text_hash", "low", "at", "class", F.slice("words", F.col("at") + 1, F.lit(WINDOW)).alias("here"))
    compared = compared.join(tests, F.col("class") == F.col("_class")).where("size(here) >= size")
    equal = F.aggregate(F.zip_with(F.slice("here", F.lit(1), F.col("size")), "w", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    leaks = compared.withColumn("equal", equal).where((F.col("equal") >= AGREE) | ((F.col("equal") == F.col("size")) & (F.col("size") < WINDOW)))
    per_place = leaks.select("doc_id", "text_hash", (F.col("low") + F.col("at")).alias("first"), "size", (F.col("equal") / F.col("size")).alias("similarity"), "item_id")
    per_place = per_place.groupBy("doc_id", "text_hash", "first").agg(F.max("size").alias("size"), F.max("similarity").alias("similarity"), F.min("item_id").alias("item_id"))
    runs = F.array_sort(F.collect_list(F.struct("first", "size")))
    out = per_place.groupBy("doc_id", "text_hash").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_windows"), F.max("similarity").alias("similarity"), runs.alias("spans"))
    step = lambda s, x: F.struct(  # noqa: E731  words covered by runs in order of their start
        (s["n"] + F.greatest(F.lit(0), x["first"] + x["size"] - F.greatest(s["end"], x["first"]))).alias("n"), F.greatest(s["end"], x["first"] + x["size"]).alias("end"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return out.withColumn("n_words", covered.cast("long")).select("doc_id", "text_hash", "item_id", "n_windows", "n_words", "similarity", "spans")


def without_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` without a leak, unchanged; columns may have any names."""
    aside = Aside(docs)
    leaks = find_leaks(docs, items, doc_id=doc_id, text=text, **names).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_text"))
    same = F.col(aside.name(doc_id)).cast("long").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(aside.name(text)) == F.col("_leak_text"))
    return aside.rows.join(leaks, same, "left_anti").select(*aside.back())
