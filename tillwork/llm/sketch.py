"""A count-min sketch that tells keys seen once from keys seen again, built in partitions and merged block by block.

Each of its rows has ``cells`` counters that stop at two, kept as two bitmaps: seen, and seen again. The size is fixed by
the parameters whatever the input. A crowded sketch overestimates more keys and never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillwork.llm.text import U, mix

ROWS = 2
CELL_BITS = 27
_PART = 1 << 16  # bytes of bitmap that are sent and merged together
SCHEMA = "part int, seen binary, again binary"


def _cells(keys: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (mix(keys + U(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - cell_bits)).astype(np.uint32)


class Sketch:
    def __init__(self, cell_bits: int = CELL_BITS):
        self.cell_bits = cell_bits
        self.seen = np.zeros((ROWS, 1 << (cell_bits - 3)), np.uint8)
        self.again = np.zeros_like(self.seen)

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        for row in range(ROWS):
            cells = np.sort(_cells(keys, row, self.cell_bits))
            fresh = np.ones(len(cells), bool)
            fresh[1:] = cells[1:] != cells[:-1]
            repeated = cells[1:][~fresh[1:]]
            seen, again = self.seen[row], self.again[row]
            for some, twice in ((cells[fresh], False), (repeated, True)):
                byte, bit = some >> 3, np.left_shift(1, some & 7).astype(np.uint8)
                first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.empty(0, np.int64)
                if not len(first):
                    continue
                at, bits = byte[first], np.bitwise_or.reduceat(bit, first)
                again[at] |= bits if twice else seen[at] & bits
                seen[at] |= bits

    def parts(self) -> Iterator[pa.RecordBatch]:
        size = min(_PART, self.seen.shape[1])
        seen, again = self.seen.reshape(-1, size), self.again.reshape(-1, size)
        found = np.flatnonzero(seen.any(axis=1))
        for at in range(0, len(found), 64):
            some = found[at:at + 64]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(some, pa.int32()),
                "seen": pa.array([pa.compress(seen[i].tobytes(), "zstd", asbytes=True) for i in some], pa.binary()),
                "again": pa.array([pa.compress(again[i].tobytes(), "zstd", asbytes=True) for i in some], pa.binary()),
            })


def merged(parts: DataFrame, cell_bits: int = CELL_BITS) -> np.ndarray:
    """The merged bitmaps of cells seen again: ROWS arrays of 2**cell_bits bits, of fixed size, on the driver."""
    size = min(_PART, 1 << (cell_bits - 3))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "again": pa.array([pa.compress(again.tobytes(), "zstd", asbytes=True)], pa.binary())})

        for batch in batches:
            for part, s, a in zip(batch["part"].to_pylist(), batch["seen"], batch["again"]):
                s, a = (np.frombuffer(pa.decompress(x.as_buffer(), size, "zstd"), np.uint8) for x in (s, a))
                if part == now:
                    again |= a | (seen & s)
                    seen |= s
                else:
                    if now is not None:
                        yield out()
                    now, seen, again = part, s.copy(), a.copy()
        if now is not None:
            yield out()

    again = np.zeros((ROWS * (1 << (cell_bits - 3)) // size, size), np.uint8)
    rows = parts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, again binary")
    for row in rows.toLocalIterator():
        again[row["part"]] = np.frombuffer(pa.decompress(bytes(row["again"]), size, "zstd"), np.uint8)
    return again.reshape(ROWS, -1)


def maybe_repeated(again: np.ndarray, keys: np.ndarray, cell_bits: int = CELL_BITS) -> np.ndarray:
    """False only for keys that were certainly added once at most."""
    found = np.ones(len(keys), bool)
    for row in range(ROWS):
        cells = _cells(keys[found], row, cell_bits)
        found[found] = (again[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
    return found
