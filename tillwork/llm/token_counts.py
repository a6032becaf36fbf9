"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

A text is cut at the special strings (one token each) and then into pre-tokens. The distinct pre-tokens of a batch are
laid behind one another as one array of symbols, a sequence each. In a round every sequence looks up the ranks of its
neighbouring pairs and merges all occurrences of its own lowest pair, from the left where they overlap; a sequence whose
pairs have no rank left is done, and the symbols that survive are its tokens. Merging all occurrences at once is what one
merge after the other gives, since a symbol's own pairs rank after the merge that made it (``Merges`` checks that).

Merged symbols are unlinked, and the array is packed when less than half of it is in use, so a text of a megabyte without
a space costs rounds over arrays and no loop over its symbols.

Nothing is shuffled. The merge table is broadcast; its size is that of the vocabulary file, whatever the corpus.

Cases: null and empty texts have 0 bytes and 0 tokens. Equal texts get equal counts, and every row comes back once, so
repeated rows and null ids stay. Texts of any length are taken whole: pre-tokens pass in runs of ``_RUN``. An empty
table gives an empty one. Only ``keep`` and the text are read; a kept column with a name of a result gives way to it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Fixed: the split before the merges that byte-level vocabularies of this family are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int32).max
_RUN = 1 << 16  # pre-tokens held at once
_KEPT = 1 << 17  # counts of distinct pre-tokens that a task remembers between runs
_KEPT_LENGTH = 48
_LONG = 1 << 20  # texts beyond are cut by an iterator


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in plain)
    return [chr(b) for b, _ in sorted([*zip(plain, plain), *((256 + k, b) for k, b in enumerate(rest))], key=lambda x: x[1])]


@dataclass
class Merges:
    """A vocabulary as arrays: symbol of each byte, ranked pairs, and the symbol that each rank makes."""

    of_byte: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    makes: np.ndarray
    size: int
    special: list[str]

    @classmethod
    def of_file(cls, path: str) -> Merges:
        """From a vocabulary file in JSON: byte-level BPE without a normalizer or a prefix space.

        Refuses what would count otherwise: other kinds of models, added strings that swallow white space or match whole
        words only, and merges of which a pair ranks before the symbol that it needs.
        """
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, split = held["model"], held.get("pre_tokenizer") or {}
        odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
        if model["type"] != "BPE" or model.get("ignore_merges") or held.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or odd:
            raise ValueError("only byte-level BPE without normalizer, prefixes or suffixes is counted")
        added = held.get("added_tokens") or []
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added strings with conditions around them are not counted")
        ids, size = model["vocab"], max(model["vocab"].values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        if len(made) != len(merges) or any(made.get(x, -1) >= rank for rank, m in enumerate(merges) for x in m):
            raise ValueError("a pair ranks before the symbol that it is made of")
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(
            np.array([ids[c] for c in byte_alphabet()], np.int64), keys[order], order.astype(np.int32),
            np.array([ids[a + b] for a, b in merges], np.int64), size, sorted((x["content"] for x in added), key=len, reverse=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), _NONE, np.int32)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)


def surviving_symbols(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols are left of each sequence; ``symbols`` holds them behind one another, none is empty."""
    left = lengths.astype(np.int64)
    if not len(symbols):
        return left
    name = np.arange(len(lengths))  # the sequences still in the arrays
    symbol = symbols.astype(np.int64)
    slots, starts, owner, after, before, alive = _linked(left)
    rank = np.full(slots, _NONE, np.int32)
    pair = np.flatnonzero(after >= 0)
    rank[pair] = merges.rank(symbol[pair], symbol[after[pair]])
    while True:
        least = np.minimum.reduceat(rank, starts)
        open_ = least < _NONE
        if not open_.any():
            return left
        if 2 * left[name[open_]].sum() < slots:
            stay = alive & open_[owner]
            symbol, rank, name, least = symbol[stay], rank[stay], name[open_], least[open_]
            slots, starts, owner, after, before, alive = _linked(left[name])
        else:
            least[~open_] = -1
        hit = np.flatnonzero(rank == (least[owner] if len(name) > 1 else least))
        if len(hit) > 1:  # of pairs that share a symbol, every other one from the left
            place = np.arange(len(hit))
            shares = np.append(False, after[hit[:-1]] == hit[1:])
            hit = hit[(place - np.maximum.accumulate(np.where(shares, 0, place))) % 2 == 0]
        gone = after[hit]
        symbol[hit] = merges.makes[rank[hit]]
        beyond = after[gone]
        after[hit] = beyond
        before[beyond[beyond >= 0]] = hit[beyond >= 0]
        alive[gone], rank[gone] = False, _NONE
        left[name] -= np.bincount(owner[hit], minlength=len(name))
        behind = before[hit]
        touched = np.concatenate([hit, behind[behind >= 0]])
        ends = after[touched] < 0
        rank[touched[ends]] = _NONE
        touched = touched[~ends]
        rank[touched] = merges.rank(symbol[touched], symbol[after[touched]])


def _linked(sizes: np.ndarray):
    """Slots of sequences of these sizes: their number, first slots, owners, slot after and before (-1: none), in use."""
    slots = int(sizes.sum())
    stops = np.cumsum(sizes)
    after, before = np.arange(1, slots + 1), np.arange(-1, slots - 1)
    after[stops - 1] = -1
    before[stops - sizes] = -1
    return slots, stops - sizes, np.repeat(np.arange(len(sizes)), sizes), after, before, np.ones(slots, bool)


@lru_cache(None)
def _newer() -> tuple[re.Pattern, regex.Pattern]:
    """Characters that the pattern's engine calls letters or numbers, but that no assigned character stands for here.

    Engines know different versions of Unicode; the library's takes these for neither. The first pattern is a quick
    look for a character that is not before all of them.
    """
    kind, out = regex.compile(r"[\p{L}\p{N}]"), []
    for point in range(0x80, 0x110000):
        if not 0xD800 <= point < 0xE000 and unicodedata.category(chr(point)) == "Cn" and kind.match(chr(point)):
            if out and out[-1][1] == point - 1:
                out[-1][1] = point
            else:
                out.append([point, point])
    if not out:
        return re.compile("(?!)"), regex.compile("(?!)")
    return re.compile(f"[{chr(out[0][0])}-\U0010ffff]"), regex.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out) + "]")


class Counter:
    """Counts tokens in runs of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, merges.special)))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a stretch without special strings, in runs."""
        marked = text
        if not text.isascii() and _newer()[0].search(text) and _newer()[1].search(text):
            marked = _newer()[1].sub("�", text)  # as long, and neither letter, number nor space
        if marked is text and len(text) < _LONG:
            yield self.pattern.findall(text)
            return
        spans = (m.span() for m in self.pattern.finditer(marked))
        while run := [text[a:z] for a, z in islice(spans, _RUN)]:
            yield run

    def runs(self, text: str) -> Iterator[list[str] | int]:
        """Runs of pre-tokens, and numbers of special strings."""
        if not any(s in text for s in self.merges.special):
            yield from self.pieces(text)
            return
        at = n = 0
        for found in self.special.finditer(text):
            yield from self.pieces(text[at:found.start()])
            at, n = found.end(), n + 1
        yield from self.pieces(text[at:])
        yield n

    def count(self, texts: Sequence[str | None]) -> list[int]:
        totals, held, size = [0] * len(texts), [], 0
        for place, text in enumerate(texts):
            for run in self.runs(text or ""):
                if isinstance(run, int):
                    totals[place] += run
                    continue
                held.append((place, run))
                size += len(run)
                if size >= _RUN:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        return totals

    def _add(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        new = [*set(chain.from_iterable(run for _, run in held)).difference(self.known)]
        counts = dict(zip(new, self._tokens(new)))
        both = self.known | counts if new else self.known
        for place, run in held:
            totals[place] += sum(map(both.__getitem__, run))
        short = {k: v for k, v in counts.items() if len(k) <= _KEPT_LENGTH}
        self.known = short if len(self.known) + len(short) > _KEPT else self.known | short if short else self.known

    def _tokens(self, words: list[str]) -> list[int]:
        if not words:
            return []
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        symbols = self.merges.of_byte[np.frombuffer(b"".join(coded), np.uint8)]
        return surviving_symbols(symbols, lengths, self.merges).tolist()


def _count(shared, text: str, out: StructType, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = pa.array(counter.count(_Lazy(column)), pa.int64())
            own = {
                "n_bytes": pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0), "n_tokens": found,
                "over_limit": pc.greater(found, limit)}
            yield pa.RecordBatch.from_arrays([own[f] if f in own else batch.column(batch.schema.get_field_index(f)) for f in out.names], out.names)

    return count


class _Lazy(Sequence):
    """The texts of an Arrow column, each made when asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> str | None:
        if i >= len(self.column):
            raise IndexError(i)
        return self.column[i].as_py()


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 512) -> DataFrame:
    """The columns ``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``vocabulary`` is the path of a vocabulary file that the driver can read; no begin, end or other special tokens are
    added, special strings inside texts count as one token each, and nothing is cut or padded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges.of_file(vocabulary))
    own = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in keep if c not in own]
    rows = docs.select(*kept, *([] if text in kept else [text]))
    out = StructType([f for f in rows.schema if f.name in kept]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(_count(shared, text, out, limit), out)
