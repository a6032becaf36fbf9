"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

Pass 1 sketches windows (count-min, one sketch per partition, merged). What is counted for a window is its minimizer,
the smallest hash of its 7-word parts, once per run of windows that share it: equal windows have equal minimizers, so
the estimate is never below the number of documents that hold the window, and four times fewer keys fill the
sketch. Pass 2 keeps only windows estimated to occur twice and groups them exactly by 95 bits of two independent
hashes. Inside a batch of documents only the smallest id of a window has to ask; the others are decided at once, so
a passage that a third of all documents share comes to one row per batch. Windows are judged on the input alone.

Cases: null and empty texts have no words; the hash of no kept words is that of the empty text. Texts shorter than a
window lose nothing. Rows that repeat a document id are not earlier than each other; each row keeps its own decisions.
Rows with a null id lose nothing and cost no other row anything. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.llm import sketch
from tillwork.llm.text import Words, as_long, blocks, mix, window_hashes

WINDOW = 13
PART = 7


def window_keys(words: Words, size: int = WINDOW, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words that start a window, minimizer of each window)."""
    starts = words.windows(size)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    parts = window_hashes(words.hashes(0), part)
    least = parts[:len(parts) - (size - part)].copy()
    for k in range(1, size - part + 1):
        np.minimum(least, parts[k:len(parts) - (size - part) + k], out=least)
    return starts, least[starts]


def _count(cell_bits: int, size: int, part: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sketch.Sketch(cell_bits)
        for batch in batches:
            for _, _, words in blocks(batch.column("text")):
                starts, keys = window_keys(words, size, part)
                if len(keys):
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
                    own.add(keys[new])
        yield from own.parts()

    return count


_ASK = "h1 long, h2 int, doc_id long, text_hash long, at int, decided binary"


def _ask(again, cell_bits: int, size: int, part: int):
    """Per window estimated repeated and held by the batch's smallest id: a question. Other holders are decided."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = np.frombuffer(again.value, np.uint8).reshape(sketch.ROWS, -1)
        for batch in batches:
            ids, text_hash = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text_hash").to_numpy(zero_copy_only=False)
            h1s, h2s, rows, ats, counts = [], [], [], [], np.zeros(len(ids), np.int64)
            for first, stop, words in blocks(batch.column("text")):
                starts, keys = window_keys(words, size, part)
                counts[first:stop] = words.counts
                starts = starts[sketch.maybe_repeated(bitmaps, keys, cell_bits)]
                if len(starts):
                    row = np.searchsorted(words.first, starts, "right") - 1
                    h1s.append(window_hashes(words.hashes(0), size)[starts])
                    h2s.append((window_hashes(words.hashes(1), size, 1)[starts] >> np.uint64(33)).astype(np.int32))
                    rows.append((row + first).astype(np.int32)), ats.append((starts - words.first[row]).astype(np.int32))
            if not h1s:
                continue
            h1, h2, row, at = map(np.concatenate, (h1s, h2s, rows, ats))
            del h1s, h2s, rows, ats
            by = np.lexsort((h2, h1))
            h1, h2, row, at = h1[by], h2[by], row[by], at[by]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new) - 1
            smallest = np.minimum.reduceat(ids[row], np.flatnonzero(new))
            later = ids[row] > smallest[group]
            open_ = np.flatnonzero(~later)
            open_ = open_[np.argsort(row[open_], kind="stable")]
            for i in range(0, len(open_), 200_000):
                some = open_[i:i + 200_000]
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(as_long(h1[some])), "h2": pa.array(h2[some]), "doc_id": pa.array(ids[row[some]]),
                    "text_hash": pa.array(text_hash[row[some]]), "at": pa.array(at[some]), "decided": pa.nulls(len(some), pa.binary()),
                })
            late_row, late_at = row[later], at[later]
            by = np.argsort(late_row, kind="stable")
            late_row, late_at = late_row[by], late_at[by]
            bounds = np.flatnonzero(np.concatenate([[True], late_row[1:] != late_row[:-1], [True]])) if len(late_row) else np.empty(0, np.int64)
            if len(bounds):
                who = late_row[bounds[:-1]]
                maps = []
                for r, a, z in zip(who, bounds[:-1], bounds[1:]):
                    flags = np.zeros(counts[r], bool)
                    flags[late_at[a:z]] = True
                    maps.append(np.packbits(flags).tobytes())
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(as_long(mix(ids[who].astype(np.uint64)))), "h2": pa.array(np.full(len(who), -1, np.int32)), "doc_id": pa.array(ids[who]),
                    "text_hash": pa.array(text_hash[who]), "at": pa.nulls(len(who), pa.int32()), "decided": pa.array(maps, pa.binary()),
                })

    return ask


def covered(words: Words, starts: np.ndarray, size: int) -> np.ndarray:
    """True for words in a window that begins at one of ``starts`` (word numbers; windows stay in their text)."""
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, np.minimum(starts + size, len(words)), 1)
    return np.cumsum(steps[:-1]) > 0


def joined_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by one space, and where each text's words begin in them."""
    which = np.flatnonzero(keep)
    lengths = (words.end - words.start)[which] + 1
    ends = np.cumsum(lengths)
    source = np.repeat(words.start[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    data = words.data[np.minimum(source, len(words.data) - 1)] if len(source) else np.empty(0, np.uint8)
    data[ends - 1] = 0x20
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
    return data, np.concatenate([[0], ends])[kept_before]


def _remove(size: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked, decided = batch.column("doc_id"), batch.column("asked"), batch.column("decided")
            for first, stop, words in blocks(batch.column("text")):
                flags = np.zeros(len(words), bool)
                for i in range(first, stop):
                    base, n = words.first[i - first], words.counts[i - first]
                    if asked[i].is_valid and len(asked[i].values):
                        flags[base + asked[i].values.to_numpy()] = True
                    if decided[i].is_valid:
                        for bits in decided[i].values:
                            flags[base:base + n] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).astype(bool)
                gone = covered(words, np.flatnonzero(flags), size)
                data, at = joined_words(words, ~gone)
                data = data.tobytes()
                texts = [data[a:max(a, z - 1)] for a, z in zip(at[:-1], at[1:])]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                out = {
                    "doc_id": ids.slice(first, stop - first), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                }
                if with_text:
                    out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return remove


def remove_repeated_substrings(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, cell_bits: int = sketch.CELL_BITS, with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per row of ``docs``."""
    spark = docs.sparkSession
    part = min(PART, window)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    judged = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    again = sketch.merged(judged.select("text").mapInArrow(_count(cell_bits, window, part), sketch.SCHEMA), cell_bits)
    shared = spark.sparkContext.broadcast(again.tobytes())
    asked = judged.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_ask(shared, cell_bits, window, part), _ASK)
    first = F.min("doc_id").over(W.partitionBy("h1", "h2"))
    late = asked.withColumn("first", first).where(F.col("decided").isNotNull() | (F.col("first") < F.col("doc_id")))
    decisions = late.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("asked"), F.collect_list("decided").alias("decided"))
    decisions = decisions.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "asked", "decided")
    joined = rows.join(decisions, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.select("doc_id", "text", "asked", "decided").mapInArrow(_remove(window, with_text), schema)
