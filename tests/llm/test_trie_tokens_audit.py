"""Operators 11 to 13 on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.llm import filter_audit, radix_tree, token_counts, turn_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string, depth string, n_convs string"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# Radix tree ---------------------------------------------------------------------------------------------------------

def test_a_node_grows_through_all_layouts():
    rng = random.Random(1)
    node, order, kinds = radix_tree.Node(b""), rng.sample(range(256), 256), []
    for n, byte in enumerate(order, 1):
        child = radix_tree.Node(bytes([byte]))
        node.put(byte, child)
        kinds.append((type(node.layout).__name__, getattr(node.layout, "size", None)))
        assert node.layout.get(byte) is child and [b for b, _ in node.layout.items()] == sorted(order[:n])
        assert all((node.layout.get(b) is None) == (b not in order[:n]) for b in range(256))
        other = radix_tree.Node(b"x")
        node.put(byte, other)
        assert node.layout.get(byte) is other
    assert [kinds[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [("Few", 4), ("Few", 16), ("Few", 16), ("Indexed", None), ("Indexed", None), ("Full", None), ("Full", None)]


def test_only_aligned_depths_are_reported():
    """Units of two bytes that part in either byte; keys that begin other keys; one path over several units."""
    rng = random.Random(2)
    units = [bytes([a, b]) for a in (0, 1, 255) for b in (0, 7, 9, 200)]
    keys = {b"".join(rng.choices(units, k=rng.randint(0, 6))) for _ in range(300)}
    tree = radix_tree.RadixTree()
    for key in rng.sample(sorted(keys), len(keys)):
        tree.insert(key, key)
    seen = []

    def close(state, units_):
        seen.append((state[0][:2 * units_], len(state)))
        return state

    whole = tree.aligned(2, lambda v: [] if v is None else [v], lambda a, b: a.extend(b), close)
    want = Counter(key[:2 * d] for key in keys for d in range(len(key) // 2 + 1))
    assert Counter(dict(seen)) == want and len(seen) == len(want) and sorted(whole) == sorted(keys)
    assert seen[-1] == (b"", len(keys))


# 11 conversations -----------------------------------------------------------------------------------------------------

def rebuilt(rows):
    """Conversations as lists of (role, text), with shared openings."""
    own = defaultdict(list)
    sha = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            r, t = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), sha(r, t), (r, t)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    words = {k: len(WORD.findall(k[-1][1])) if k else 0 for k in nodes}
    out = []
    for k, members in nodes.items():
        under = [x for x in nodes if x[:len(k)] == k]
        kids = [x for x in under if len(x) == len(k) + 1]
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids), sum(not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in under) for x in under),
            sum((len(nodes[x]) - 1) * words[x] for x in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(3)
    says = ["", None, "hi", "hi there", "one two three", "  ", "é ß"]
    rows = []
    for c in [*range(0, 9), *range(20, 31), 45, -3, -21, -40, 10 ** 12 + 7]:
        rows += [(c, rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(says)) for _ in range(rng.randint(1, 6))]
    opening = [(t, "user", f"same {t}") for t in range(5)]
    rows += [(c, *x) for c in range(60, 75) for x in opening]  # copies, and a first turn of many
    rows += [(c, *x) for c in range(80, 90) for x in opening[:1 + c % 5]]
    rows += [(c, t, "user", f"long {t % 3 if t < 40 else t}") for c in (100, 101, 104) for t in range(53 - c % 4)]
    rows += [(102, 0, "user", "w" * 1_000_000), (102, 1, "user", "w " * 500_000)]
    rows += [rows[3], rows[3], (None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("segment,block", [(64, 8192), (2, 3), (1, 1), (5, 7)])
def test_trie_against_brute_force(spark, conversations, segment, block, monkeypatch):
    monkeypatch.setattr(turn_trie, "_PIECE", 4)
    df = spark.createDataFrame([(*r, "mine", "too") for r in conversations], CONV).repartition(5)
    both = turn_trie.with_shared_openings(turn_trie.numbered_turns(df))
    got = turn_trie.prefix_trie(*both, segment=segment, block=block)
    convs = rebuilt(conversations)
    assert any(not t for t in convs.values()) and max(map(len, convs.values())) > 40
    assert collected(got, *TRIE) == brute_trie(convs)


def test_trie_in_many_partitions(spark, conversations):
    """Every range holds a key or two, so nearly all nodes are put together from several tasks."""
    df = spark.createDataFrame([(*r, "mine", "too") for r in conversations], CONV)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both = turn_trie.with_shared_openings(turn_trie.numbered_turns(df))
        assert collected(turn_trie.prefix_trie(*both, segment=8), *TRIE) == brute_trie(rebuilt(conversations))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "user", "x", "", "")]):
        df = spark.createDataFrame(rows, CONV)
        assert turn_trie.prefix_trie(*turn_trie.with_shared_openings(turn_trie.numbered_turns(df))).count() == 0


# 12 token counts ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    return lambda texts: [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def merges(vocabulary):
    return token_counts.Merges.of_file(vocabulary)


def test_counts_are_those_of_the_library(merges, library):
    rng = random.Random(5)
    parts = [*"aaabbcd  \n\t'sStlm1290.,!?-_éß漢字🙂  \u0085\x1c\x00", "<|endoftext|>", "<|endof", "text|>", "   ", "the ", "'ll", "́", "\U000323b0", "\U00012550", "\U0001df1f"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(3000)]
    texts += ["", "a" * 4999, "ab" * 3000, "<|endoftext|>" * 4, " " * 999, " \n" * 99, string.printable * 3, "x" + " " * 70000 + "y"]
    assert token_counts.Counter(merges).count(texts) == library(texts)


def test_every_character_is_split_as_the_library_does(merges, library):
    points = [*range(0x3000), *range(0xa000, 0xb000, 3), *range(0xf900, 0x11000, 5), *range(0x11000, 0x40000, 61)]
    texts = [f"a{chr(p)}1{chr(p)}!{chr(p)}  b" for p in points if not 0xD800 <= p < 0xE000]
    assert token_counts.Counter(merges).count(texts) == library(texts)


def test_long_texts_are_counted_whole(merges, library, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(token_counts, "_RUN", 500)
    monkeypatch.setattr(token_counts, "_LONG", 2000)
    monkeypatch.setattr(token_counts, "_KEPT", 100)
    texts = ["".join(rng.choices("abcdefghij klm\n", k=30_000)) for _ in range(3)] + ["q" * 300_000, "".join(rng.choices(string.ascii_lowercase, k=100_000)), "lorem <|endoftext|>ipsum " * 2000]
    assert token_counts.Counter(merges).count(texts) == library(texts)


def test_ragged_rounds_against_one_merge_at_a_time(merges):
    rng = np.random.default_rng(7)
    words = [bytes(rng.choice(list(b"aeinorst lh"), rng.integers(1, 40)).tolist()) for _ in range(400)]

    def slow(word):
        symbols = merges.of_byte[np.frombuffer(word, np.uint8)].tolist()
        while len(symbols) > 1:
            ranks = merges.rank(np.array(symbols[:-1]), np.array(symbols[1:]))
            at = int(ranks.argmin())
            if ranks[at] == token_counts._NONE:
                break
            symbols[at:at + 2] = [int(merges.makes[ranks[at]])]
        return len(symbols)

    flat = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    got = token_counts.surviving_symbols(flat, np.array([len(w) for w in words]), merges)
    assert got.tolist() == [slow(w) for w in words]
    assert token_counts.surviving_symbols(flat[:0], np.empty(0, np.int64), merges).tolist() == []


def test_tokens_of_odd_rows(spark, odd, vocabulary, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(90, "x" * 1_000_000), (91, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(4)
    n = library([t for _, t in rows])
    want = sorted(((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n)), key=str)
    got = token_counts.count_tokens(docs, vocabulary)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and collected(got, *got.columns) == want
    kept = token_counts.count_tokens(docs, vocabulary, keep=("doc_id", "text", "n_tokens"), limit=0)
    assert kept.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"] and kept.where("over_limit <> (n_tokens > 0)").count() == 0
    assert token_counts.count_tokens(docs.limit(0), vocabulary).count() == 0


def test_other_vocabularies_are_refused(vocabulary):
    other = os.path.join(os.path.dirname(vocabulary), "word_bpe_49k.json")
    with pytest.raises(ValueError):
        token_counts.Merges.of_file(other)


# 13 filter audit ------------------------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    texts, first = [t or "" for _, t, _ in rows], {}
    for (i, _, _), t in zip(rows, texts):
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for (i, _, lang), t in zip(rows, texts):
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, removed_by = [d for d in docs if d[0] == part], Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(removed)
                gone = sum(f in d[1] for d in own) - len(removed)
                steps.append((part, order, step, len(left), len(removed), gone, sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out, key=str)


def test_audit_against_brute_force(spark, prose):
    many = " ".join(prose)
    texts = [many, many, "AB cd", None, "", "a # b", many + " |", many.upper(), "x " * 300, prose[0], prose[0] + "É", "w" * 1_000_000, "v w " * 400_000]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 2)]
    rows += [(5, many, "en"), (5, many, "en"), (None, many, "en"), (None, many, "en"), (None, None, None), (7, None, "fr"), (7, None, "fr"), (-1, "a # b", "en")]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (999, 1, 1), (16, 1, 1), (16, 1, 1), (20, 0, 0)]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, lang string, part string, failed int").repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_orders(filter_audit.failures(docs, table))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert collected(got, *columns) == brute_audit(rows, labels)
    bare = filter_audit.audit_orders(filter_audit.failures(docs, table.limit(0)))
    assert collected(bare, *columns) == brute_audit(rows, [])
    assert filter_audit.audit_orders(filter_audit.failures(docs.limit(0), table)).count() == 0


def test_text_pieces_do_not_change_the_filters(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["aa", "b", "C", "é#", "dd\t", " "], k=rng.randint(0, 500))).encode() for _ in range(200)]
    whole = [filter_audit.failed_filters(t) for t in texts]
    monkeypatch.setattr(filter_audit, "_PIECE", 7)
    assert [filter_audit.failed_filters(t) for t in texts] == whole


def test_path_counts():
    edges = filter_audit.states_and_edges()
    assert len(edges) == 80 and sum(a * b for _, f, a, b in edges if f == 0) == 120
    assert all(a * b > 0 for *_, a, b in edges) and {s for s, *_ in edges} == set(range(31))
    assert len({o for o, *_ in filter_audit.orders()}) == 120


def test_counts_of_copies_meet_as_sums(spark):
    """A text that a third of all rows share is a few rows when texts are compared."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    counts = {r["failed"]: r["n"] for r in filter_audit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts[1] == 2001 and counts[1 | 16] == 999
