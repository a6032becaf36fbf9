"""Words and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa

from tillwork.llm import sketch
from tillwork.llm.text import Words, blocks, string_bytes, window_hashes

TEXTS = ["", None, "one", " a  bb\tccc\x0b\r\nD ", "éa b ç x", "end", "x" * 70, "a", "b " * 40]


def words(texts, size=1 << 20):
    out = []
    for first, stop, w in blocks(pa.array(texts), size):
        for i in range(stop - first):
            out.append([w.data[w.start[k]:w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])])
    return out


def test_words_are_those_of_the_pattern_whatever_the_block_size():
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    for size in (1, 7, 40, 1 << 20):
        assert words(TEXTS, size) == want


def test_equal_words_have_equal_hashes_and_others_do_not():
    vocabulary = sorted({w for t in words(TEXTS) for w in t} | {f"w{i}" for i in range(2000)} | {"ab", "ba", "aab", "aba"})
    def hashes(texts, fold=False):
        return [int(h) for _, _, w in blocks(pa.array(texts), 50) for h in w.hashes(0, fold)]
    one, other = hashes(vocabulary), hashes([f" {w}  " for w in vocabulary])
    assert one == other and len(set(one)) == len(vocabulary)
    assert hashes(["AbC É"], fold=True) == hashes(["abc É"], fold=True) != hashes(["abc é"], fold=True)


def test_windows_stay_inside_their_text():
    data, offsets = string_bytes(pa.array(["a b c", "d e", "", "f g h i"]))
    w = Words(data, offsets)
    assert w.windows(3).tolist() == [0, 5, 6]
    runs = window_hashes(w.hashes(0), 3)
    assert len(set(runs[w.windows(3)].tolist())) == 3


def test_a_sketch_loses_no_repeated_key():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    one, two = sketch.Sketch(10), sketch.Sketch(16)
    for s in (one, two):
        s.add(keys), s.add(keys[:500]), s.add(np.empty(0, np.uint64))
        assert sketch.maybe_repeated(s.again, keys[:500], s.cell_bits).all()
    assert sketch.maybe_repeated(two.again, keys[500:], 16).mean() < 0.1
