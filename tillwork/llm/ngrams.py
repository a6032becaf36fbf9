"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are hashed indicators of what a whole text holds: words, pairs of words, and n-grams (1 to 3) of word shapes; a
shape is a word's letters reduced to a class (lower, Capital, CAPITALS, mixed, digits, none) with its leading and
trailing punctuation. An indicator is scaled by its class log-count ratio, rows are brought to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve fitted out of fold turns margins into scores.

The fit uses a bounded sample of labelled rows (``sample``, the smallest hashes of doc_id), which are turned into slots where
they are read; the task that fits holds slots only, and takes rows in that order until ``SAMPLE_SLOTS`` slots are held, so
that long texts do not make it larger. Weights have a fixed number of slots, so the model that is broadcast has a fixed
size. All texts are scored whole, on Spark.

Cases: null and empty texts have no features and get the score of the intercept. Labels that are null, and labelled ids
that are missing from the texts, are left out; an id labelled twice counts with each label. A null id is never labelled
(its hash is null, so it counts as not held out). With labels of one class only, or none, every score is that class's
(or 0.5). Equal texts get equal scores. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwork.llm.samples import smallest_hashes
from tillwork.llm.text import U, Words, blocks, by_bytes, mix, window_hashes

SLOT_BITS = 20
SAMPLE = 16_000
SAMPLE_SLOTS = 32_000_000
FOLDS = 4
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0

_LOWER, _UPPER, _DIGIT, _OTHER = 1, 2, 4, 8
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _LOWER
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[128:] = 16  # letters beyond ASCII, either case
_LETTERS = _LOWER | _UPPER | _DIGIT | 16


def word_shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: class of the core, and the punctuation around it byte by byte (three at most a side)."""
    if not len(words):
        return np.empty(0, U)
    kind = _CLASS[words.data]
    present = np.bitwise_or.reduceat(np.append(kind, 0), np.stack([words.start, words.end], 1).ravel())[::2]
    core = np.append((kind & _LETTERS) > 0, False)
    counts = np.cumsum(np.append(0, (kind & _UPPER) > 0))
    uppers = counts[words.end] - counts[words.start]
    first_upper = (kind[words.start] & _UPPER) > 0
    case = np.select([present & _LETTERS == 0, (uppers > 1) & (present & _LOWER == 0), first_upper & (uppers == 1), uppers > 0], [0, 1, 2, 3], 4)
    shape = case.astype(U) * U(2) + ((present & _DIGIT) > 0)
    length = words.end - words.start
    shape = shape * U(4) + np.digitize(length, [4, 12, 30]).astype(U)
    for side in (words.start, words.end - 1):
        step = 1 if side is words.start else -1
        open_ = np.ones(len(words), bool)
        for k in range(3):
            at = np.clip(side + step * k, 0, len(words.data) - 1)
            open_ &= (length > k) & ~core[at]
            shape = shape * U(257) + np.where(open_, words.data[at], 256).astype(U)
    return mix(shape + U(1))


def features(words: Words, slot_bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every indicator, each once, ordered by both."""
    hashes, shapes, text = words.hashes(0), word_shapes(words), words.text
    found = []
    for kind, base in ((0, hashes), (1, shapes)):
        for n in (1, 2) if kind == 0 else (1, 2, 3):
            runs = window_hashes(base, n, 10 * kind + n)
            starts = words.windows(n)
            slots = (runs[starts] >> U(64 - slot_bits)).astype(np.int64)
            found.append(text[starts] << slot_bits | slots)
    pairs = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    if len(pairs):
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    return pairs >> slot_bits, pairs & ((1 << slot_bits) - 1)


def _counts(rows: list[np.ndarray], slot_bits: int) -> np.ndarray:
    out = np.zeros(1 << slot_bits)
    for at in range(0, len(rows), 512):
        out += np.bincount(np.concatenate(rows[at:at + 512]), minlength=1 << slot_bits)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, slot_bits: int, *, epochs: int = EPOCHS, cost: float = COST, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-count ratios, weights of scaled unit rows, intercept) by dual coordinate descent on the hinge loss."""
    good, bad = (_counts([r for r, label in zip(rows, labels) if label == y], slot_bits) + SMOOTHING for y in (1, 0))
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    weights, intercept = np.zeros(1 << slot_bits), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other one.
    share = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    limit = cost * np.where(labels == 1, len(labels) / (2 * share[1]), len(labels) / (2 * share[0]))
    alpha = np.zeros(len(rows))
    values = [_unit(ratio[r]) for r in rows]
    square = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (weights[r] @ v + intercept) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[r] += step * v
                intercept += step
                alpha[i] = new
    return ratio, weights, intercept


def _unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt(values @ values)
    return (values / norm if norm else values).astype(np.float32)


def margins(text: np.ndarray, slots: np.ndarray, n_texts: int, ratio: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    scaled = ratio[slots]
    norm = np.sqrt(np.bincount(text, scaled * scaled, n_texts))
    return np.bincount(text, scaled * weights[slots], n_texts) / np.where(norm > 0, norm, 1) + intercept


def logistic_curve(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton steps (targets pulled in as Platt does)."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _rows_of(text_column) -> list[np.ndarray]:
    rows = []
    for first, stop, words in blocks(text_column):
        text, slots = features(words)
        cut = np.searchsorted(text, np.arange(stop - first + 1))
        slots = slots.astype(np.int32)
        rows += [slots[a:z] for a, z in zip(cut[:-1], cut[1:])]
    return rows


def fit_scores(rows: list[np.ndarray], labels: np.ndarray, slot_bits: int = SLOT_BITS, folds: int = FOLDS) -> dict[str, np.ndarray]:
    """The fitted model: slot weights (ratio and weight) and the curve, fitted on margins of rows left out of a fold."""
    if len(set(labels.tolist())) < 2:
        level = 0.5 if not len(labels) else float(labels[0])
        return {"ratio": np.zeros(1 << slot_bits), "weights": np.zeros(1 << slot_bits), "rest": np.array([0.0, 0.0, np.log(max(level, 1e-6) / max(1 - level, 1e-6))])}
    out = np.zeros(len(rows))
    place = np.random.default_rng(1).permutation(len(rows)) % folds
    for fold in range(folds):
        inside = np.flatnonzero(place != fold)
        if len(set(labels[inside].tolist())) < 2:
            continue
        model = fit([rows[i] for i in inside], labels[inside], slot_bits, epochs=EPOCHS // 2)
        for i in np.flatnonzero(place == fold):
            out[i] = margins(np.zeros(len(rows[i]), np.int64), rows[i], 1, *model)[0]
    slope, offset = logistic_curve(out, labels)
    ratio, weights, intercept = fit(rows, labels, slot_bits)
    return {"ratio": ratio, "weights": weights, "rest": np.array([intercept, slope, offset])}


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, doc_id, label, text) with the slots of the text in its place."""
    for batch in by_bytes(batches, 3):
        found = [r.tobytes() for r in _rows_of(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())], ["order", "doc_id", "label", "slots"])


def _train(limit: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, held = [], [], 0
        for batch in batches:
            for label, slots in zip(batch.column(1).to_pylist(), batch.column(0)):
                if held >= limit:
                    break
                rows.append(np.frombuffer(slots.as_py(), np.int32))
                labels.append(label)
                held += len(rows[-1])
        if rows:
            yield pa.RecordBatch.from_pydict({"model": pa.array([_pack(fit_scores(rows, np.array(labels, np.int64)))], pa.binary())})

    return train


def _pack(model: dict[str, np.ndarray]) -> bytes:
    return model["rest"].astype(np.float64).tobytes() + model["ratio"].astype(np.float32).tobytes() + model["weights"].astype(np.float32).tobytes()


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, slots: int = SAMPLE_SLOTS) -> bytes:
    """A model of fixed size from at most ``sample`` labelled rows (and some ``slots`` indicators), fitted in one task."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = smallest_hashes(chosen, F.col("_id"), sample, "_id", "label")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.xxhash64("doc_id", F.lit(11)).alias("order"), "doc_id", "label", "text").mapInArrow(_slots, "order long, doc_id long, label int, slots binary")
    rows = rows.repartition(1).sortWithinPartitions("order", "doc_id", "label", "slots").select("slots", "label")
    found = rows.mapInArrow(_train(slots), "model binary").collect()
    return bytes(found[0]["model"]) if found else _pack(fit_scores([], np.empty(0, np.int64)))


def _unpack(model: bytes, slot_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = np.frombuffer(model, np.float64, 3)
    both = np.frombuffer(model, np.float32, 2 << slot_bits, 24)
    return rest, both[:1 << slot_bits].astype(np.float64), both[1 << slot_bits:].astype(np.float64)


def _score(shared, slot_bits: int, text: str, with_text: bool, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (intercept, slope, offset), ratio, weights = _unpack(shared.value, slot_bits)
        for batch in by_bytes(batches, text):
            place = batch.schema.get_field_index(text)
            scores = np.zeros(batch.num_rows)
            for first, stop, words in blocks(batch.column(place)):
                found, slots = features(words, slot_bits)
                margin = margins(found, slots, stop - first, ratio, weights, intercept)
                scores[first:stop] = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
            out = [i for i in range(batch.num_columns) if with_text or i != place]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in out], pa.array(scores)], [*[batch.schema.names[i] for i in out], name])

    return score


def score_quality(docs: DataFrame, model: bytes, *, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score", slot_bits: int = SLOT_BITS) -> DataFrame:
    """The columns ``keep`` and the score (0 to 1) as ``name``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    with_text = text in keep
    rows = docs.select(*keep) if with_text else docs.select(*keep, text)
    out = StructType([f for f in rows.schema if with_text or f.name != text]).add(name, "double")
    return rows.mapInArrow(_score(shared, slot_bits, text, with_text, name), out)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))

