"""Language-model scores by online logistic context mixing over hashed-context bit predictors.

A text is its words with A-Z lower-cased, then one end mark. A frequent word is a path of bits through a Huffman tree of
words; any other takes the path of an escape and is then spelled, byte by byte and closed by a space, through a Huffman
tree of bytes. Every bit is predicted by hashed contexts: the place in the tree with the word's beginning, the last two
and the last four bytes of a spelled word, and, for the first bits in the tree of words, the word before. A predictor's slot holds the
stretched share of ones seen there. A gate (depth or place in the word, and whether the long contexts are known)
selects the weights that mix the predictions; an adaptive map from (tree node, mixed prediction) to the share of
ones seen there refines the result, and both are averaged. A text's score is the sum of its bits' log-probabilities.

Learning, all of it over every training text: (1) exact counts of all words; (2) counts of bits per slot, one table per
partition, merged part by part; (3) on a fold of training texts kept out of (2), each partition learns weights online,
bit by bit in small groups, and counts for the map; weights are averaged by the bits they saw, counts are summed; (4) the bits of
that fold are added to the slots. The tables have a fixed size, so contexts share slots, the more the larger the input. Base scores need exact counts of every word, however many there are: the words with the
highest counts (``heavy``, a fixed bound) are broadcast, the remaining ones are joined.

Cases: null and empty texts are one end token. Words unknown to training have count 0 and are spelled by the model
like any other. A null id is in no fold and trains the tables. Rows are scored one by one, so repeated rows
and ids get a row each. With no training text at all N is 0, V is 0 and every bit has probability 1/2.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.text import U, Words, as_long, blocks, give_back, mix
from tillwork.session import pin

TABLE_BITS = (22, 18, 20, 22)
HEAVY = 1 << 20
DICTIONARY = 1 << 18  # words with a path of their own, at most
LEAST = 5  # times that such a word occurs; rarer ones teach how unknown words are spelled
PAIR_DEPTH = 20  # bits of a word's path that the word before predicts too
MIX_FOLD = 3
GROUP_BYTES = 1 << 20
SMALL_GROUP = 1 << 19  # where nothing depends on the groups, and smaller ones take less memory
_SPACE, _END = 0x20, 0x0A
_GATES, _INPUTS = 32, len(TABLE_BITS) + 1
_ROWS, _LEVELS = 256, 64  # of the refining map
_FINE = 512  # steps of a mixed prediction in the table of log-probabilities
_PART = 1 << 16
_BLOCK = 2048  # words or tokens whose bits are worked on at a time
_WALK = 1 << 14  # paths that are walked at a time
_ROOM = (1 << 32) - 1  # bits that a task counts before it hands its table on, so that no count can pass 32 bits
_LIMIT = 8.0
_SCALE = 127 / _LIMIT  # stretched shares are kept as bytes
_END_HASH = (int(mix(np.array([0xE11D], U))[0]), int(mix(np.array([0xE22D], U))[0]))


class Tree:
    """A canonical Huffman code; the node at depth d on a symbol's path is named by d and the first d bits of its code."""

    def __init__(self, counts: np.ndarray, salt: int):
        n = len(counts)
        order = np.argsort(counts, kind="stable").tolist()
        leaves = [(int(counts[s]) + 1, s) for s in order]  # every symbol can be coded
        joined: deque[tuple[int, int]] = deque()
        up, at, node = [0] * (2 * n), 0, n
        while (n - at) + len(joined) > 1:  # the two smallest of two sorted queues, again and again
            pair = []
            for _ in range(2):
                if at < n and (not joined or leaves[at] <= joined[0]):
                    pair.append(leaves[at])
                    at += 1
                else:
                    pair.append(joined.popleft())
            up[pair[0][1]] = up[pair[1][1]] = node
            joined.append((pair[0][0] + pair[1][0], node))
            node += 1
        depth = [0] * (2 * n)
        for x in range(node - 2, -1, -1):
            depth[x] = depth[up[x]] + 1
        self.length = np.array(depth[:n], np.int64)
        by = np.argsort(self.length, kind="stable")
        steps = np.zeros(n, U)
        code, last = 0, int(self.length[by[0]]) if n else 0
        for place, length in enumerate(self.length[by].tolist()):
            code <<= length - last
            steps[place], last = code, length
            code += 1
        self.code = np.empty(n, U)
        self.code[by] = steps
        self.salt = U(salt)
        self.order, self.rank = by, np.argsort(by)  # symbols from left to right, and the place of each
        self.left = self.code << (64 - np.maximum(self.length, 1)).astype(U)  # paths that begin at the highest bit
        # At each depth leaves lie to the left of forks. Forks are numbered by depth, then from left to right.
        self.first_fork, self.n_forks = [], []
        for d, leaves in enumerate(np.bincount(self.length).tolist()):
            self.first_fork.append((2 * self.first_fork[-1] if d else 0) + leaves)
            self.n_forks.append((1 << d) - self.first_fork[-1])
        self.step_from = [2 * (sum(self.n_forks[:d]) - first) for d, first in enumerate(self.first_fork)]

    @cached_property
    def forks(self) -> tuple[np.ndarray, ...]:
        """Hash, row of the map (from 0) and depth of every fork."""
        depth = np.repeat(np.arange(len(self.n_forks)), self.n_forks)
        so_far = np.concatenate([np.arange(a, a + n, dtype=U) for a, n in zip(self.first_fork, self.n_forks)])
        row = np.where(depth < 7, (1 << np.minimum(depth, 7)) - 1 + so_far.astype(np.int64), _ROWS // 2 - 1)
        return mix(so_far * U(64) + depth.astype(U) + self.salt), row.astype(np.int32), depth.astype(np.uint8)

    def steps(self, left: np.ndarray, d: int) -> np.ndarray:
        """Twice the number of the fork at depth d on each path, plus the bit that follows it."""
        return (left >> U(63 - d)).view(np.int64) + self.step_from[d]

    def walk(self, symbols: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, stop, steps) at each depth below ``depth`` of the paths of symbols that go from left to right, block by block."""
        for at in range(0, len(symbols), _WALK):
            block = symbols[at:at + _WALK]
            left, length = self.left[block], self.length[block]
            for d in range(min(depth, int(length[-1]))):
                first = int(np.searchsorted(length, d, "right"))  # shorter paths lie to the left
                yield at + first, at + len(block), self.steps(left[first:], d)

    def bits(self, symbols: np.ndarray, first_row: int) -> tuple[np.ndarray, ...]:
        """Of the symbols' paths, one after another: length of each path, then bit, hash of the node, row of the map and depth of each step."""
        length = self.length[symbols]
        total = int(length.sum())
        bit, node, row, depth = np.empty(total, np.uint8), np.empty(total, U), np.empty(total, np.int32), np.empty(total, np.uint8)
        hashes, rows, _ = self.forks
        step_from = np.array(self.step_from)
        done = 0
        for at in range(0, len(symbols), _BLOCK):  # blocks that stay in the processor's cache
            n = length[at:at + _BLOCK]
            ends = np.cumsum(n)
            stop = done + int(ends[-1])
            left = np.repeat(ends - 1, n) - np.arange(stop - done)
            deep = np.repeat(n - 1, n) - left
            step = (np.repeat(self.code[symbols[at:at + _BLOCK]], n) >> left.astype(U)).view(np.int64) + step_from[deep]
            bit[done:stop] = step & 1
            fork = step >> 1
            node[done:stop], row[done:stop], depth[done:stop] = hashes.take(fork), rows.take(fork) + np.int32(first_row), deep
            done = stop
        return length, bit, node, row, depth


class Code:
    """Words with a path of their own, the escape behind them, and the bytes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, others: int, symbols: np.ndarray):
        by = np.argsort(h1, kind="stable")
        self.h1, self.h2 = h1[by], h2[by]
        self.words, self.bytes = Tree(np.append(counts[by], others), 1 << 62), Tree(symbols, 1 << 61)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The symbol of each word; that of the escape is the number of words."""
        if not len(self.h1):
            return np.zeros(len(h1), np.int64)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, len(self.h1))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_PLACES = np.array([2, 3, 4, 5, 5, 6, 6, 6, 7], np.uint8)  # gates of the places in a spelled word, the last one for all from there on
_NODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class Tokens:
    """The tokens of a group of texts: word hashes, the text of each, and spelling bits of each distinct word."""

    def __init__(self, words: Words, n_texts: int):
        h1, h2 = words.hashes(0, True), words.hashes(1, True)
        # One end token after the words of each text.
        at = words.first[1:]
        self.h1, self.h2 = np.insert(h1, at, U(_END_HASH[0])), np.insert(h2, at, U(_END_HASH[1]))
        self.text = np.repeat(np.arange(n_texts), words.counts + 1)
        self.n_texts = n_texts
        self.words = words
        self.start = np.insert(words.start, at, -1)
        self.stop = np.insert(words.end, at, -1)
        before = np.empty_like(self.h1)
        before[1:] = self.h1[:-1]
        self.begin = np.append(0, np.cumsum(words.counts + 1)[:-1])
        before[self.begin] = U(0)
        self.before = before

    def distinct(self) -> None:
        by = np.argsort(self.h1)
        h1 = self.h1[by]
        new = np.append(True, h1[1:] != h1[:-1])
        self.first_at = by[new]  # any token of the word: all have the same bytes, lower-cased
        self.word = np.empty(len(by), np.int64)
        self.word[by] = np.cumsum(new) - 1

    def find(self, code: Code) -> None:
        """The symbol of each distinct word, and the bits of those that are spelled."""
        self.distinct()
        self.number = code.number(self.h1[self.first_at], self.h2[self.first_at])
        self.spell_bytes(code)

    def spell_bytes(self, code: Code) -> None:
        """Bit arrays of all distinct words that are spelled, one word after another: node, bit, gate and contexts."""
        other = np.flatnonzero(self.number == len(code.h1))
        start, stop = self.start[self.first_at[other]], self.stop[self.first_at[other]]
        length = np.where(start < 0, 1, stop - start + 1)
        last = np.cumsum(length) - 1
        data = self.words.data
        symbol = _LOWER[data[np.minimum(ranges(np.maximum(start, 0), length), len(data) - 1)]] if len(data) else np.zeros(int(length.sum()), np.uint8)
        symbol[last] = np.where(start < 0, _END, _SPACE)
        begin = np.repeat(last + 1 - length, length)
        place = np.arange(len(symbol)) - begin
        # Contexts of a byte inside its word: the last two and four bytes, and the beginning of the word.
        wide = symbol.astype(U)
        recent = np.zeros(len(symbol), U)
        orders = []
        for back in range(1, 5):
            prior = np.zeros(len(symbol), U)
            prior[back:] = wide[:-back] + U(1)
            prior[place < back] = U(0)
            recent |= prior << U(9 * (back - 1))
            if back in (2, 4):
                orders.append(mix(recent * U(0x9E3779B97F4A7C15) + U(back)))
        powers = np.cumprod(np.append(U(1), np.full(int(length.max(initial=1)), U(0x9FB21C651E98DF25), U)), dtype=U)
        sums = np.append(U(0), np.cumsum((wide + U(1)) * _NODE[symbol] * powers[place], dtype=U))
        prefix = mix(sums[:-1] - sums[begin] + place.astype(U) + U(1 << 40))
        steps, byte_bit, byte_node, byte_row, _ = code.bytes.bits(np.arange(256), _ROWS // 2)
        n = steps[symbol]
        at = ranges((np.cumsum(steps) - steps)[symbol], n)
        node = byte_node[at]
        self.bit, self.node, self.main = byte_bit[at], byte_row[at], node + np.repeat(prefix, n)
        self.gate = np.repeat(_PLACES[np.minimum(place, 8)], n)
        self.orders = [np.repeat(c, n) + node for c in orders]
        self.n_byte = np.zeros(len(self.number), np.int64)
        self.n_byte[other] = np.add.reduceat(n, last + 1 - length) if len(other) else 0
        self.byte_at = np.cumsum(self.n_byte) - self.n_byte

    def spell(self, code: Code) -> None:
        """Bit arrays of all distinct words: first the bits of all paths in the tree of words, then those of all spelled bytes."""
        self.find(code)
        self.n_word, word_bit, word_main, word_row, depth = code.words.bits(self.number, 0)
        self.split = len(word_bit)
        self.bit = np.concatenate([word_bit, self.bit])
        self.node = np.concatenate([word_row, self.node])
        self.main = np.concatenate([word_main, self.main])
        self.gate = np.concatenate([(depth >= 6).view(np.uint8), self.gate])
        self.n_pairs = np.minimum(self.n_word, PAIR_DEPTH)
        self.word_at = np.cumsum(self.n_word) - self.n_word
        self.byte_at += self.split
        self.n_bits = self.n_word + self.n_byte

    def follow(self, tree: Tree) -> tuple[np.ndarray, ...]:
        """The distinct pairs of a word and the symbol after it, by the symbol's path from left to right.

        Tokens in that order, where the tokens of each pair begin there, and symbol and hash of the word before of each pair.
        """
        last = np.empty(len(self.word), np.int64)
        last[1:] = self.word[:-1] + 1
        last[self.begin] = 0
        key = (tree.rank[self.number] << 40)[self.word] + last  # a group has fewer words than 1 << 40
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        token = order[first]
        return order, first, self.number[self.word[token]], self.before[token]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bits of each distinct word."""
        upto = np.append(0.0, np.cumsum(values, dtype=np.float64))
        return upto[self.word_at + self.n_word] - upto[self.word_at] + upto[self.byte_at + self.n_byte] - upto[self.byte_at]

    def pairs(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some tokens the first bits in the tree of words, and their slots with the word before."""
        word = self.word[at:stop]
        n = self.n_pairs[word]
        flat = ranges(self.word_at[word], n)
        return flat, _slots(_pair(self.main[flat], np.repeat(self.before[at:stop], n)), 3)


def _slots(context: np.ndarray, table: int) -> np.ndarray:
    return (context * U(0xD1342543DE82EF95) >> U(64 - TABLE_BITS[table])).astype(np.int64) + _OFFSETS[table]


_OFFSETS = [sum(1 << b for b in TABLE_BITS[:k]) for k in range(len(TABLE_BITS))]
_SLOTS = sum(1 << b for b in TABLE_BITS)


def _pair(prefix: np.ndarray, before: np.ndarray) -> np.ndarray:
    h = prefix ^ before
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, Tokens]]:
    for first, stop, words in blocks(texts, size):
        yield first, stop, Tokens(words, stop - first)


def kept_small(work: Callable) -> Callable:
    """``work`` on batches; when it ends, its memory goes back to the system, as the process is kept for later tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


# (1) word and byte counts ------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols = np.zeros(256, np.int64)
    for batch in batches:
        found = []
        for _, _, tokens in groups(batch.column("text")):
            tokens.distinct()
            found.append((tokens.h1[tokens.first_at], tokens.h2[tokens.first_at], np.bincount(tokens.word)))
            symbols += np.bincount(_LOWER[tokens.words.data], minlength=256)
            symbols[_SPACE] += len(tokens.words)
            symbols[_END] += tokens.n_texts
        if not found:
            continue
        h1, h2, n = (np.concatenate(x) for x in zip(*found))
        del found
        by = np.argsort(h1)
        h1 = h1[by]
        first = np.flatnonzero(np.append(True, h1[1:] != h1[:-1]))
        h1, n, h2 = h1[first], np.add.reduceat(n[by], first), h2[by[first]]
        del by
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(first), np.int8)), "h1": pa.array(as_long(h1)), "h2": pa.array(as_long(h2)), "n": pa.array(n)})
    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(256, np.int8)), "h1": pa.array(np.arange(256)), "h2": pa.array(np.zeros(256, np.int64)), "n": pa.array(symbols)})


def word_counts(texts: DataFrame) -> DataFrame:
    """(kind, h1, h2, n): exact counts of all tokens (kind 0) and of the spelled bytes (kind 1)."""
    return pin(texts.mapInArrow(kept_small(_count_words), "kind byte, h1 long, h2 long, n long").groupBy("kind", "h1", "h2").agg(F.sum("n").alias("n")), "lm-words")


# (2) bit counts per slot --------------------------------------------------------------------------------------

def _count_bits(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        words = code.words
        table, seen, room = np.zeros(2 * _SLOTS, np.uint32), np.zeros(len(words.code), np.int64), _ROOM
        fork = words.forks[0]

        def parts() -> Iterator[pa.RecordBatch]:
            # The place in the tree of words alone: all that the task saw of a symbol goes down its path once.
            there = words.order[seen[words.order] > 0]
            for first, stop, step in words.walk(there, len(words.n_forks)):
                np.add.at(table, 2 * _slots(fork.take(step >> 1), 0) + (step & 1), seen[there[first:stop]].astype(np.uint32))
            for i in range(len(table) // _PART):
                part = table[i * _PART:(i + 1) * _PART]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "counts": pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())})

        for batch in batches:
            for _, _, tokens in groups(batch.column("text"), SMALL_GROUP):
                tokens.find(code)
                times = np.bincount(tokens.word)
                bits = int((times * (words.length[tokens.number] + tokens.n_byte)).sum())
                if bits > room:
                    yield from parts()
                    table[:], seen[:], room = 0, 0, _ROOM
                room -= bits
                np.add.at(seen, tokens.number, times)
                spelled = np.repeat(times.astype(np.uint32), tokens.n_byte)
                for k, context in enumerate([tokens.main, *tokens.orders]):
                    np.add.at(table, 2 * _slots(context, k) + tokens.bit, spelled)
                order, start, symbol, before = tokens.follow(words)
                times = np.diff(start, append=len(order)).astype(np.uint32)
                for first, stop, step in words.walk(symbol, PAIR_DEPTH):
                    np.add.at(table, 2 * _slots(_pair(fork.take(step >> 1), before[first:stop]), 3) + (step & 1), times[first:stop])
        yield from parts()

    return count


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, None

    def out() -> pa.RecordBatch:
        pairs = total.reshape(-1, 2).astype(np.float64)
        odds = np.log((pairs[:, 1] + 0.4) / (pairs[:, 0] + 0.4))
        body = np.rint(np.clip(odds, -_LIMIT, _LIMIT) * _SCALE).astype(np.int8)
        body[(body == 0) & (pairs.sum(axis=1) > 0)] = 1  # 0 is kept for slots without any bit
        body = body.tobytes()
        return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "odds": pa.array([body], pa.binary())})

    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"]):
            counts = np.frombuffer(pa.decompress(counts.as_buffer(), 4 * _PART, "zstd"), np.uint32).astype(np.uint64)
            if part == now:
                total += counts
            else:
                if now is not None:
                    yield out()
                now, total = part, counts.copy()
    if now is not None:
        yield out()


def bit_counts(texts: DataFrame, code: Code) -> DataFrame:
    """(part, counts): the bits of each slot, counted task by task."""
    shared = texts.sparkSession.sparkContext.broadcast(code)
    return pin(texts.mapInArrow(kept_small(_count_bits(shared)), "part int, counts binary"), "lm-bits")


def stretched(counts: DataFrame) -> np.ndarray:
    """Stretched share of ones per slot as a byte, 0 where nothing was seen."""
    odds = np.zeros((2 * _SLOTS // _PART, _PART // 2), np.int8)
    parts = counts.repartition("part").sortWithinPartitions("part")
    for row in parts.mapInArrow(_merge_bits, "part int, odds binary").toLocalIterator():
        odds[row["part"]] = np.frombuffer(bytes(row["odds"]), np.int8)
    return odds.ravel()


def bit_tables(texts: DataFrame, code: Code) -> np.ndarray:
    return stretched(bit_counts(texts, code))


# (3) mixing ---------------------------------------------------------------------------------------------------


class Model:
    def __init__(self, code: Code, odds: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.code, self.odds = code, odds
        self.weights = weights if weights is not None else np.concatenate([np.full((_GATES, _INPUTS - 1), 0.4), np.zeros((_GATES, 1))], 1).astype(np.float32)
        self.refined = refined
        # Log-probability of a bit by row of the map, mixed prediction (in fine steps) and bit.
        steps = np.arange(_FINE, dtype=np.float64) * (2 * _LIMIT / (_FINE - 1)) - _LIMIT
        p = np.tile(1 / (1 + np.exp(-steps)), (_ROWS, 1))
        if refined is not None:
            level = np.rint(np.arange(_FINE) * ((_LEVELS - 1) / (_FINE - 1))).astype(np.int64)
            p = (p + refined.reshape(_ROWS, _LEVELS)[:, level]) / 2
        p = np.clip(p, 1e-6, 1 - 1e-6)
        self.logs = np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()

    def inside(self, tokens: Tokens) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gates (without the word before) and the stretched inputs of the bits of all distinct words."""
        tokens.spell(self.code)
        inputs = [self.odds[_slots(tokens.main, 0)], np.zeros(len(tokens.main), np.int8), np.zeros(len(tokens.main), np.int8)]
        for k, context in enumerate(tokens.orders, 1):
            inputs[k][tokens.split:] = self.odds[_slots(context, k)]
        return tokens.gate + np.int64(8) * (inputs[0] != 0), [x * np.float32(1 / _SCALE) for x in inputs]

    def slices(self, tokens: Tokens, size: int) -> Iterator[tuple]:
        """(rows of the map, bits, gates, stretched inputs) for some tokens at a time."""
        gates, inside = self.inside(tokens)
        for at in range(0, len(tokens.word), size):
            word = tokens.word[at:at + size]
            n = tokens.n_word[word]
            flat = np.concatenate([ranges(tokens.word_at[word], n), ranges(tokens.byte_at[word], tokens.n_byte[word])])
            pair = np.zeros(len(flat), np.int8)
            pair[ranges(np.cumsum(n) - n, tokens.n_pairs[word])] = self.odds[tokens.pairs(at, at + size)[1]]
            yield tokens.node[flat], tokens.bit[flat], gates[flat] + 16 * (pair != 0), [*(x[flat] for x in inside), pair * np.float32(1 / _SCALE)]

    def mixed(self, gate: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        out = columns[-1].take(gate)
        for w, x in zip(columns, inputs):
            out += w.take(gate) * x
        return out

    @staticmethod
    def cells(node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        level = ((mixed + np.float32(_LIMIT)) * np.float32((_LEVELS - 1) / (2 * _LIMIT)) + np.float32(0.5)).astype(np.int64)
        return node.astype(np.int64) * _LEVELS + level

    @staticmethod
    def cell(node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where the log-probabilities of each bit begin."""
        return node * np.int32(2 * _FINE) + bit

    @staticmethod
    def steps(mixed: np.ndarray) -> np.ndarray:
        step = np.clip(mixed, -_LIMIT, _LIMIT)
        step += np.float32(_LIMIT)
        step *= np.float32((_FINE - 1) / (2 * _LIMIT))
        step += np.float32(0.5)
        return step.astype(np.int32) * np.int32(2)

    def cell_logs(self, mixed: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Log-probability of each bit."""
        return self.logs.take(self.cell(node, bit) + self.steps(mixed))

    def log10(self, tokens: Tokens) -> np.ndarray:
        """Log-probability of each text.

        Without the word before, a bit's prediction is that of its distinct word; only bits whose pair of words is
        known are predicted again, once for each distinct pair.
        """
        tokens.find(self.code)
        tree, at, scale = self.code.words, self.in_tree, np.float32(1 / _SCALE)
        inputs = [self.odds.take(_slots(c, k)) for k, c in enumerate([tokens.main, *tokens.orders])]
        gates = tokens.gate + np.int64(8) * (inputs[0] != 0)
        spelled = self.cell_logs(self.mixed(gates, [x * scale for x in inputs]), tokens.node, tokens.bit)
        upto = np.append(0.0, np.cumsum(spelled, dtype=np.float64))
        by_word = at.path.take(tokens.number) + (upto[tokens.byte_at + tokens.n_byte] - upto[tokens.byte_at])
        order, start, symbol, before = tokens.follow(tree)
        gains = np.zeros(len(symbol))
        for first, stop, step in tree.walk(symbol, PAIR_DEPTH):
            node = step >> 1
            pair = self.odds.take(_slots(_pair(at.fork.take(node), before[first:stop]), 3))
            mixed = at.pair_weight.take(node)
            mixed *= pair
            mixed += at.with_pair.take(node)
            gain = self.logs.take(at.cell.take(step) + self.steps(mixed))
            gain -= at.alone.take(step)
            if not pair.all():
                gain[pair == 0] = 0
            gains[first:stop] += gain
        with_before = np.repeat(gains, np.diff(start, append=len(order)))
        return np.bincount(tokens.text, by_word[tokens.word], tokens.n_texts) + np.bincount(tokens.text[order], with_before, tokens.n_texts)

    @cached_property
    def in_tree(self) -> InTree:
        return InTree(self)


class InTree:
    """What a model says in the tree of words, fork by fork; only the place there predicts, besides the word before."""

    def __init__(self, model: Model):
        tree, scale = model.code.words, np.float32(1 / _SCALE)
        self.fork, row, depth = tree.forks
        odds = model.odds.take(_slots(self.fork, 0))
        gates = (depth >= 6) + np.int64(8) * (odds != 0)
        main = odds * scale
        row, bit = np.repeat(row, 2), np.tile(np.arange(2, dtype=np.int32), len(row))
        self.cell = model.cell(row, bit)
        self.alone = model.cell_logs(np.repeat(model.mixed(gates, [main]), 2), row, bit)
        self.with_pair = model.mixed(gates + 16, [main])
        self.pair_weight = (np.ascontiguousarray(model.weights[:, -2]) * scale).take(gates + 16)
        # Log-probability of the whole path of each symbol.
        path = np.zeros(len(tree.code))
        for first, stop, step in tree.walk(tree.order, len(tree.n_forks)):
            path[first:stop] += self.alone.take(step)
        self.path = np.empty(len(path))
        self.path[tree.order] = path


def _learn(shared, rate: float):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, odds = shared.value
        model = Model(code, odds)
        seen = np.zeros((_ROWS * _LEVELS, 2))
        bits = 0
        for batch in batches:
            for _, _, tokens in groups(batch.column("text")):
                for node, bit, gate, inputs in model.slices(tokens, 1024):
                    mixed = np.clip(model.mixed(gate, inputs), -_LIMIT, _LIMIT)
                    error = bit - 1 / (1 + np.exp(-mixed))
                    met = np.maximum(np.bincount(gate, minlength=_GATES), 1)
                    bits += len(bit)
                    step = rate * np.minimum(1, met / 256) / met / (1 + bits / 1e8)
                    for k, x in enumerate([*inputs, 1.0]):
                        model.weights[:, k] += (step * np.bincount(gate, error * x, _GATES)).astype(np.float32)
                    np.clip(model.weights, -2, 4, out=model.weights)
                    cells = model.cells(node, mixed)
                    seen[:, 0] += np.bincount(cells, minlength=len(seen))
                    seen[:, 1] += np.bincount(cells, bit, len(seen))
        if bits:
            values = np.concatenate([[bits], model.weights.astype(np.float64).ravel() * bits, seen.ravel()])
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values)})

    return learn


def fit_mixer(texts: DataFrame, code: Code, odds: np.ndarray, rate: float = 0.1) -> Model:
    """Weights learned online in every partition and averaged; the refining map counted over all of them."""
    shared = texts.sparkSession.sparkContext.broadcast((code, odds))
    learned = texts.mapInArrow(kept_small(_learn(shared, rate)), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = learned.collect()  # as many rows as the mixer has numbers
    if not found:
        return Model(code, odds)
    values = np.zeros(len(found))
    for row in found:
        values[row["place"]] = row["value"]
    weights = (values[1:1 + _GATES * _INPUTS] / values[0]).reshape(_GATES, _INPUTS).astype(np.float32)
    seen = values[1 + _GATES * _INPUTS:].reshape(-1, 2)
    level = (np.arange(_ROWS * _LEVELS) % _LEVELS) * (2 * _LIMIT / (_LEVELS - 1)) - _LIMIT
    prior = 1 / (1 + np.exp(-level))
    return Model(code, odds, weights, ((seen[:, 1] + 4 * prior) / (seen[:, 0] + 4)).astype(np.float32))


def fit_model(texts: DataFrame, mixing: DataFrame, code: Code) -> Model:
    """Weights and map learned on ``mixing`` with tables of ``texts``; then the tables take in the bits of both."""
    counts = bit_counts(texts, code)
    mixer = fit_mixer(mixing, code, stretched(counts))
    return Model(code, stretched(counts.unionByName(bit_counts(mixing, code))), mixer.weights, mixer.refined)


# Scores -------------------------------------------------------------------------------------------------------


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heavy = shared.value
        h1, h2, counts = heavy
        for batch in batches:
            for first, stop, tokens in groups(batch.column("text"), SMALL_GROUP):
                logs = model.log10(tokens)
                u1, u2 = tokens.h1[tokens.first_at], tokens.h2[tokens.first_at]
                at = np.minimum(np.searchsorted(h1, u1), max(len(h1) - 1, 0))
                found = (h1[at] == u1) & (h2[at] == u2) if len(h1) else np.zeros(len(u1), bool)
                known = np.where(found, np.log10(counts[at] + 1.0) if len(h1) else 0.0, 0.0)
                is_known = found[tokens.word]
                n = tokens.n_texts
                other = np.flatnonzero(~is_known)
                cut = np.searchsorted(tokens.text[other], np.arange(n + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(as_long(x[other])))  # noqa: E731, B023
                size = stop - first
                yield pa.RecordBatch.from_pydict({
                    "n_bytes": pa.array(tokens.words.offsets[1:].astype(np.int64) - tokens.words.offsets[:-1]), "uid": batch.column("uid").slice(first, size), "doc_id": batch.column("doc_id").slice(first, size), "held_out": batch.column("held_out").slice(first, size),
                    "n_tokens": pa.array(np.bincount(tokens.text, minlength=n)), "known": pa.array(np.bincount(tokens.text[is_known], minlength=n)),
                    "logs": pa.array(np.bincount(tokens.text, known[tokens.word], n)), "score": pa.array(logs), "o1": lists(tokens.h1), "o2": lists(tokens.h2),
                })

    return score


def score_texts(docs: DataFrame, fold: Column, held_fold: int, *, doc_id: str = "doc_id", text: str = "text", mix_fold: int = MIX_FOLD, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of ``docs``.

    ``bits_per_byte`` is that of the whole text with its end mark over its UTF-8 bytes, null for null and empty texts.
    Rows whose ``fold`` is ``held_fold`` are not learned from; those of ``mix_fold`` train the mixer before they enter the tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(fold, F.lit(-1)).alias("fold"))
    training = rows.where(F.col("fold") != held_fold)
    counts = word_counts(training.select("text"))
    words = counts.where("kind = 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    symbols = np.zeros(256, np.int64)
    for row in counts.where("kind = 1").collect():
        symbols[row["h1"]] = row["n"]
    # The count from which on at most ``heavy`` words remain: from the counts of counts, few and small.
    levels = words.groupBy("n").count().orderBy(F.col("n").desc()).select("n", F.sum("count").over(_falling()).alias("upto"))
    least = levels.where(F.col("upto") <= heavy).agg(F.min("n")).first()[0]
    is_heavy = F.col("n") >= F.lit(least if least is not None else (1 << 62))
    table = words.where(is_heavy).select("h1", "h2", "n").toArrow()
    by = np.argsort(table["h1"].to_numpy().view(U), kind="stable")
    heavy_words = tuple(table[c].to_numpy()[by].view(k) for c, k in (("h1", U), ("h2", U), ("n", np.int64)))
    most = np.lexsort((heavy_words[1], heavy_words[0], -heavy_words[2]))[:DICTIONARY]
    chosen = [x[most][heavy_words[2][most] >= LEAST] for x in heavy_words]
    code = Code(*chosen, int(n) - int(chosen[2].sum()), symbols)
    model = fit_model(training.where(F.col("fold") != mix_fold).select("text"), training.where(F.col("fold") == mix_fold).select("text"), code)
    shared = spark.sparkContext.broadcast((model, heavy_words))
    scored = pin(
        rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (F.col("fold") == held_fold).alias("held_out"), "text")
        .mapInArrow(kept_small(_score(shared)), "n_bytes long, uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, o1 array<long>, o2 array<long>"), "lm-scored")
    other = scored.select("uid", F.explode(F.arrays_zip("o1", "o2")).alias("w")).select("uid", F.col("w.o1").alias("h1"), F.col("w.o2").alias("h2"))
    rare = words.where(~is_heavy).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n")
    found = other.join(rare, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).groupBy(F.col("uid").alias("_uid")).agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = scored.join(found, F.col("uid") == F.col("_uid"), "left")
    base = F.coalesce(F.col("more_logs"), F.lit(0.0)) + F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _falling():
    from pyspark.sql import Window

    return Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
