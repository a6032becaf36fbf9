"""Secret scan: candidates from whole texts, judged by a random forest trained on labelled findings.

Candidates are found with high recall: words with a long run of key characters and a digit, values with a known prefix,
values of 8 bytes and more behind an operator or a word like "password" (up to the closing quote or space), and private
key blocks of any length, also without an end. Features are the candidate's length, its changes of character class, how unlikely its letter
pairs are, its coverage by dictionary words, its make-up, the document's path, and the neighbouring words. The forest
(Spark ML) is trained on labelled findings: rows of (path, text before, candidate, text after, label). Where nobody has
labelled any, ``planted_findings`` makes them: generated keys and look-alikes in the contexts in which each kind occurs,
with neighbours and look-alikes taken from a bounded sample of the corpus.

The dictionary holds the ``dictionary`` most frequent words of 4 to 12 letters, counted over all documents; letter pairs
are counted over it. Forest and dictionary have a fixed size and are broadcast; scanning, judging and redacting are one
pass over the texts.

Cases: null and empty texts have no candidates. A null source is an empty path. Overlapping candidates are all judged; of
those confirmed the first counts, and the longest of them. Every occurrence of a repeated secret is reported, in every copy of a text. Rows that repeat an id
are scanned each. An empty table gives an empty result; with an empty dictionary the coverage is 0. In redaction all
columns are kept and null stays null; n_chars follows the new text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.samples import smallest_hashes
from tillwork.llm.text import blocks, by_bytes
from tillwork.session import fresh_path, pin

DICTIONARY = 20_000
SAMPLE_TEXTS = 1_000
FINDINGS = 6_000
TREES, DEPTH = 40, 9
THRESHOLD = 0.5
MARK = "[SECRET]"
_NEAR = 48  # bytes of text before and after a candidate that features look at

_KEY_CHARS = np.zeros(256, bool)
for _low, _high in (("a", "z"), ("A", "Z"), ("0", "9")):
    _KEY_CHARS[ord(_low):ord(_high) + 1] = True
_KEY_CHARS[[ord(c) for c in "+/_-=.~"]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[ord("0"):ord("9") + 1] = True

_VALUE = re.compile(rb"[A-Za-z0-9+/_\-=.~]{8,}")
_KEY_MARK = re.compile(rb"-----(BEGIN|END) [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(rb"(?:\s+(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash):[^\r\n]*|[A-Za-z0-9+/=]{16,}))*(?:\r?\n[A-Za-z0-9+/]+={0,2}(?!\S))?")
_LONG_BLOCK = 20_000  # beyond, the words between the marks must be long, as those of keys are
_ASSIGNED = re.compile(rb"(?i)(passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)[\w\-]*[\"']?\s*(?:[:=]|=>|:=)?\s*[\"'(]?$")
_GIVEN = re.compile(
    rb"((?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)[\w\-]*+)([\"']?\s++)?|[:=]>?\s*+")
_GIVEN_END = re.compile(rb"[\s\"']")
_SEPARATOR = re.compile(rb"[;,&|\s\"']")
_NEXT = re.compile(rb"[:=;,&|\s\"']")
_NO_VALUE = frozenset(b" \t\n\r\f\v:=")
_OPERATOR = re.compile(rb"[:=>]\s*[\"'(]?$")
_HARMLESS = re.compile(rb"(?i)\b(commit|sha\d*|md5|checksum|digest|hash|revision|rev|uuid|guid|etag|version|build|id|ref)\W{0,4}$")
_EXAMPLE = re.compile(rb"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test|fake|redacted|todo")
_KNOWN = re.compile(rb"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29\.|eyJ|npm_|SG\.)")
_PREFIX = re.compile(_KNOWN.pattern[1:])
_TEST_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|spec|docs?/|readme")
_CODE_PATH = re.compile(r"(?i)\.(env|ya?ml|json|ini|cfg|conf|py|js|ts|go|java|rb|sh|properties|toml|tf)$")
_HEX = re.compile(rb"^[0-9a-f]+$|^[0-9A-F]+$")
_UUID = re.compile(rb"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LETTER_RUN = re.compile(rb"[a-z]{4,}")

FEATURES = (
    "length", "log_length", "class_changes", "pair_surprise", "entropy", "digits", "uppers", "others", "hex", "hex_key_length", "dictionary", "longest_letters",
    "known_prefix", "uuid", "repeats", "assigned", "operator", "harmless_before", "example_near", "quoted", "at_sign_near", "url_near", "test_path", "code_path", "path_depth",
    *[f"near_{i}" for i in range(12)],
)


class Language:
    """The dictionary, and how surprising a pair of letters is under its words."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = frozenset(w.encode() for w, _ in words)
        self.beginnings = frozenset(w[:4] for w in self.words)
        pairs = np.ones((27, 27))
        for word, n in words:
            codes = [ord(c) - 96 for c in word]
            for a, b in zip([0, *codes], [*codes, 0]):
                pairs[a, b] += n
        self.surprise = -np.log2(pairs / pairs.sum(axis=1, keepdims=True))

    def coverage(self, value: bytes) -> float:
        """Share of the characters in dictionary words, longest first from the left."""
        covered = 0
        for run in _LETTER_RUN.findall(value.lower()):
            at = 0
            while at < len(run) - 3:
                if run[at:at + 4] in self.beginnings:
                    for n in range(min(12, len(run) - at), 3, -1):
                        if run[at:at + n] in self.words:
                            covered += n
                            at += n - 1
                            break
                at += 1
        return covered / max(1, len(value))


def describe(path: str, before: bytes, value: bytes, after: bytes, language: Language) -> list[float]:
    """The features of one candidate."""
    data = np.frombuffer(value, np.uint8)
    n = len(data)
    lower, upper, digit = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90), _IS_DIGIT[data]
    kind = lower * 1 + upper * 2 + digit * 3
    letters = np.where(lower, data.astype(np.int64) - 96, np.where(upper, data.astype(np.int64) - 64, 0))
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / n
    runs = max((len(r) for r in re.findall(rb"[A-Za-z]+", value)), default=0)
    hex_ = bool(_HEX.match(value))
    near = before[-_NEAR:] + b" " + after[:_NEAR]
    buckets = [0.0] * 12
    for word in [*_WORD.findall(before)[-3:], *_WORD.findall(after)[:2]]:
        buckets[hashlib.md5(word.lower()).digest()[0] % 12] = 1.0
    return [
        float(n), math.log(n), float((kind[1:] != kind[:-1]).sum()) / n, float(language.surprise[letters[:-1], letters[1:]].mean()) if n > 1 else 0.0,
        float(-(share * np.log2(share)).sum()), float(digit.mean()), float(upper.mean()), float((kind == 0).mean()), float(hex_), float(hex_ and n in (32, 40, 48, 64, 128)),
        language.coverage(value), float(runs), float(bool(_KNOWN.match(value))), float(bool(_UUID.match(value))), float(1 - len(counts[counts > 0]) / min(n, 64)),
        float(bool(_ASSIGNED.search(before[-_NEAR:]))), float(bool(_OPERATOR.search(before[-4:]))), float(bool(_HARMLESS.search(before[-24:]))),
        float(bool(_EXAMPLE.search(near) or _EXAMPLE.search(value))), float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        float(b"@" in before[-1:] + after[:1] or b"@" in before[-_NEAR:].split(b" ")[-1]), float(b"://" in before[-_NEAR:].split(b" ")[-1]),
        float(bool(_TEST_PATH.search(path))), float(bool(_CODE_PATH.search(path))), float(path.count("/")), *buckets,
    ]


def candidates(words, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(text number, first byte, byte after the last) of the candidates of a block, in order; they may overlap."""
    found: list[tuple[int, int]] = []
    if len(words):
        digits = np.append(0, np.cumsum(_IS_DIGIT[words.data]))
        n_digits = digits[words.end] - digits[words.start]
        length = words.end - words.start
        sets = np.append(0, np.cumsum((words.data == ord("=")) | (words.data == ord(":"))))
        sets = sets[words.end] - sets[words.start]
        behind = np.zeros(len(words), bool)
        last = words.data[words.end - 1]
        behind[1:] = (last[:-1] == ord("=")) | (last[:-1] == ord(":"))
        pick = (length >= 8) & (((length >= 16) & (n_digits > 0)) | (sets > 0) | behind)
        for i in np.flatnonzero(pick).tolist():
            start = int(words.start[i])
            for m in _VALUE.finditer(data, start, int(words.end[i])):
                a, z = m.span()
                value = m.group()
                # key=value inside one word: the value is what counts
                cut = value.find(b"=")
                if 0 < cut < len(value) - 8 and value[:cut].replace(b"_", b"").replace(b"-", b"").isalpha():
                    a += cut + 1
                value = data[a:z].rstrip(b".-")
                z = a + len(value)
                if len(value) >= 16 and any(48 <= c <= 57 for c in value) or len(value) >= 8 and (behind[i] or _OPERATOR.search(data, max(0, a - 4), a)):
                    found.append((a, z))
    for first, stop in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        found += _prefixed(data, first, stop)
        found += _given(data, first, stop)
        found += _key_blocks(data, first, stop)
    for a, z in sorted(set(found), key=lambda s: (s[0], -s[1])):
        yield int(np.searchsorted(words.offsets, a, "right")) - 1, a, z


def _prefixed(data: bytes, first: int, stop: int) -> Iterator[tuple[int, int]]:
    """Values that begin as a known kind of key: the first of a run of key characters with all of the run, and each
    up to the next that begins so."""
    starts = [m.start() for m in _PREFIX.finditer(data, first, stop) if m.start() == first or not data[m.start() - 1:m.start()].isalnum()]
    end = first
    for a, following in zip(starts, [*starts[1:], stop]):
        ends = {min(following, end)}
        if a >= end:
            value = _VALUE.match(data, a, stop)
            end = value.end() if value else a
            ends = {min(following, end), end}
        for z in ends:
            z = a + len(data[a:z].rstrip(b".-"))
            if z - a >= 8:
                yield a, z


def _given(data: bytes, first: int, stop: int) -> Iterator[tuple[int, int]]:
    """Values behind an operator or a word that names a secret.

    A quoted value ends at its closing quote in the line. Of the values of one run without quotes and spaces, the first
    takes all of the run. The run is cut at ";", ",", "&" and "|": the first value of a piece, and the first behind a word
    that names a secret, take the rest of the piece, others end before the next operator. So the bytes of all
    candidates stay in proportion to the text, however many operators it has.
    """
    at, run, piece, named_in, word = first, first, first, first, -1
    while (m := _GIVEN.search(data, at, stop)) is not None:
        at = a = m.end()
        if m[1] is not None and m[2] is None:
            word = m.end()
            continue
        named = m[1] is not None or 0 <= m.start() - word <= 1
        quote = data[a:a + 1] if a < stop and data[a] in b"\"'(" else b""
        if quote and a + 1 < stop and data[a + 1] in _NO_VALUE:
            quote = b""
        a += len(quote)
        if a >= stop or data[a] in _NO_VALUE:
            continue
        if quote in (b'"', b"'") and quote:
            z = data.find(quote, a, stop)
            if z >= 0 and data.find(b"\n", a, z) < 0:
                if z - a >= 8:
                    yield a, z
                continue
        ends = []
        if a >= run:
            end = _GIVEN_END.search(data, a, stop)
            run = end.start() if end else stop
            ends.append(run)
        if a >= piece:
            end = _SEPARATOR.search(data, a, run)
            piece = end.start() if end else run
            ends.append(piece)
        if named and a >= named_in:
            named_in = piece
            ends.append(piece)
        if not ends:
            end = _NEXT.search(data, a, piece)
            ends.append(end.start() if end else piece)
        for z in set(ends):
            z = a + len(data[a:z].rstrip(b".,;:)]}>"))
            if z - a >= 8:
                yield a, z


def _key_blocks(data: bytes, first: int, stop: int) -> Iterator[tuple[int, int]]:
    """Private key blocks; one without an end has the lines behind it that look like a key's."""
    marks = list(_KEY_MARK.finditer(data, first, stop)) if data.find(b"-----BEGIN", first, stop) >= 0 else []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == b"BEGIN":
            body = data[m.end():after.start()] if after is not None and after[1] == b"END" else None
            if body is not None and (len(body) <= _LONG_BLOCK or len(body) >= 16 * len(body.split())):
                yield m.start(), after.end()
            else:
                yield m.start(), _KEY_LINES.match(data, m.end(), stop).end()


class Forest:
    """Nodes of a fitted Spark forest as arrays; all trees are walked for all candidates at once."""

    def __init__(self, rows: list):
        trees: dict[int, dict[int, tuple]] = {}
        for r in rows:
            trees.setdefault(r["tree"], {})[r["id"]] = r
        self.trees = []
        for _, nodes in sorted(trees.items()):
            n = max(nodes) + 1
            feature, level, left, right, share = np.full(n, -1), np.zeros(n), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
            for i, r in nodes.items():
                total = sum(r["stats"])
                share[i] = r["stats"][1] / total if total else 0.0
                if r["left"] >= 0:
                    feature[i], level[i], left[i], right[i] = r["feature"], r["level"], r["left"], r["right"]
            self.trees.append((feature, level, left, right, share))

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, level, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (open_ := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= level[at]
                at = np.where(open_, np.where(go, left[at], right[at]), at)
            out += share[at]
        return out / max(1, len(self.trees))


# Dictionary and training ---------------------------------------------------------------------------------------

_LETTERS = re.compile(r"^[a-z]{4,12}$")
_HELD_WORDS = 1 << 17  # that a task sums up before it hands them on


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def counted() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return made

    for batch in by_bytes(batches, "text"):
        for _, _, words in blocks(batch.column("text")):
            length = words.end - words.start
            some = np.flatnonzero((length >= 4) & (length <= 12))
            if not len(some):
                continue
            _, first, n = np.unique(words.hashes(0)[some], return_index=True, return_counts=True)
            data = words.data.tobytes()
            for i, k in zip(some[first].tolist(), n.tolist()):
                word = data[words.start[i]:words.end[i]]
                if word.isalpha() and word.islower():
                    counts[word] = counts.get(word, 0) + k
        if len(counts) > _HELD_WORDS:
            yield counted()
    yield counted()


def learn_language(docs: DataFrame, *, text: str = "text", dictionary: int = DICTIONARY) -> Language:
    """The most frequent plain words, counted over all texts (ties by word).

    Counts fall into bins of a sixteenth of an octave, so that only words of the bins that can win are put in order; the
    driver gets the bins and the dictionary.
    """
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_plain_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = pin(counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "secrets-words")
    least = held = 0
    for r in sorted(counts.groupBy("bin").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        least, held = r["bin"], held + r["words"]
        if held >= dictionary:
            break
    best = pin(counts.where(F.col("bin") >= least).orderBy(F.col("n").desc(), "word").limit(dictionary), "secrets-dictionary")
    return Language([(r["word"], r["n"]) for r in best.collect()])


def _generated(rng: np.random.Generator) -> bytes:
    pick = lambda chars, n: bytes(rng.choice(np.frombuffer(chars, np.uint8), n))
    hexa, alnum, base64 = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = (
        lambda: pick(hexa, int(rng.choice([32, 40, 40, 64]))), lambda: pick(alnum, int(rng.integers(20, 64))), lambda: pick(base64, int(rng.integers(24, 88))) + b"=" * int(rng.integers(0, 3)),
        lambda: b"AKIA" + pick(upper, 16), lambda: b"ghp_" + pick(alnum, 36), lambda: b"xoxb-" + pick(b"0123456789", 12) + b"-" + pick(alnum, 24), lambda: b"sk_live_" + pick(alnum, 24),
        lambda: pick(alnum + b"@!#$%^&*?", int(rng.integers(10, 20))), lambda: pick(alnum, int(rng.integers(10, 20))), lambda: b"AIza" + pick(alnum, 35), lambda: b"eyJ" + pick(alnum, 33) + b"." + pick(alnum, 60) + b"." + pick(alnum, 43), lambda: pick(alnum, int(rng.integers(10, 20))) + pick(b"0123456789", 2),
    )
    return kinds[int(rng.integers(len(kinds)))]()


def _look_alike(rng: np.random.Generator, words: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(before, value, after) of a harmless finding."""
    pick = lambda chars, n: bytes(rng.choice(np.frombuffer(chars, np.uint8), n))
    some = lambda n: [words[int(i)] for i in rng.integers(0, len(words), n)]
    digits, hexa = b"0123456789", b"0123456789abcdef"
    kinds = (
        lambda: (b"", pick(digits, int(rng.integers(8, 20))), b""), lambda: (b"", b"-".join(pick(digits, 4) for _ in range(4)), b""),
        lambda: (b"", b".".join(pick(digits, int(rng.integers(1, 4))) for _ in range(4)), b""), lambda: (some(1)[0] + b"." + pick(digits, 2) + b"@", b"mail" + pick(digits, 1) + b".example.com", b""),
        lambda: (b"", some(1)[0] + b"." + pick(digits, 2), b"@mail.example.com"), lambda: (b"https://", b"example.com/" + b"/".join(some(3)) + b"/" + pick(digits, 3), b""),
        lambda: (b"commit ", pick(hexa, 40), b""), lambda: (b"sha256: ", pick(hexa, 64), b""), lambda: (b"md5=", pick(hexa, 32), b""), lambda: (b"revision ", pick(hexa, 40), b""),
        lambda: (b"id: ", b"-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), b""), lambda: (b"", b"_".join(some(3)) + b"_" + pick(digits, 1), b""),
        lambda: (b'password = "', b"changeme" + pick(digits, 2), b'"'), lambda: (b'token = "', b"your_token_here_" + pick(digits, 1), b'"'), lambda: (b"api_key: ", b"xxxxxxxxxxxxxxxx" + pick(digits, 1), b""),
        lambda: (b'name = "', b"-".join(some(3)), b'"'), lambda: (b"secret: ", b"".join(some(2)), b""), lambda: (b"", b"".join(some(4)) + pick(digits, 1), b""),
        lambda: (b"password ", b"".join(some(2)), b""), lambda: (b"token ", b"".join(some(2)), b""), lambda: (b"secret ", b"".join(some(3)), b""), lambda: (b"bearer ", b"-".join(some(2)), b""),
        lambda: (b"note: ", b",".join(some(3)), b""), lambda: (b'title="', b" ".join(some(3)), b'"'), lambda: (b"url=", b"https://example.com/" + b"/".join(some(2)) + b"?p=" + pick(digits, 2), b""),
        lambda: (b"contact: ", some(1)[0] + b"." + pick(digits, 2) + b"@mail" + pick(digits, 1) + b".example.com", b""), lambda: (b"at: ", b":".join(pick(digits, 2) for _ in range(3)), b""),
        lambda: (b"https:", b"//example.com/" + b"/".join(some(3)), b""), lambda: (b"", b"sk-" + b"-".join(some(2)), b""),
        lambda: (b"version=", b".".join(pick(digits, 2) for _ in range(4)) + b"-" + some(1)[0], b""), lambda: (b"password: ", b"_".join(some(2)), b""),
    )
    return kinds[int(rng.integers(len(kinds)))]()


_LEADS = (b'token = "', b'password = "', b"api_key=", b'"secret": "', b"SECRET_KEY: ", b"access_key = ", b"Authorization: Bearer ", b"export TOKEN=", b"auth_token: '", b'private_key="', b"credentials ", b"password ", b"password=", b"Bearer ", b"token ", b"")
_PATHS = ("src/config.py", "deploy/prod.env", "app/settings.yaml", "web", "crawl/a", "tests/fixtures/keys.json", "docs/example.md", "")


def planted_findings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", texts: int = SAMPLE_TEXTS, findings: int = FINDINGS) -> DataFrame:
    """(path, before, value, after, label): generated keys and look-alikes beside words of at most ``texts`` documents."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("path")).where("text is not null")
    sample = smallest_hashes(rows, F.col("doc_id"), texts, "text", "path").agg(F.collect_list("text").alias("text"), F.collect_list("path").alias("path"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(pair for b in batches for texts, paths in zip(b.column("text").to_pylist(), b.column("path").to_pylist()) for pair in zip(texts, paths))
        words = [_WORD.findall(t.encode()) for t, _ in rows]
        words = [w for w in words if w]
        flat = [x for w in words for x in w[:200] if 3 <= len(x) <= 14 and x.isalpha()] or [b"word", b"other", b"name"]
        paths = [p for _, p in rows] + list(_PATHS) * max(1, len(rows) // 16)
        rng = np.random.default_rng(5)
        out = []
        for _ in range(findings):
            around = words[int(rng.integers(len(words)))] if words else flat
            at = int(rng.integers(0, len(around)))
            left, right = b" ".join(around[max(0, at - 4):at]) + b" ", b" " + b" ".join(around[at:at + 4])
            label = int(rng.random() < 0.45)
            if label:
                lead = _LEADS[int(rng.integers(len(_LEADS)))]
                value = _generated(rng)
                while not lead and (not _KNOWN.match(value)):
                    value = _generated(rng)
                tail = lead[-1:] if lead[-1:] in (b'"', b"'") else b""
            else:
                lead, value, tail = _look_alike(rng, flat)
            out.append((paths[int(rng.integers(len(paths)))], left + lead, value, tail + right, label))
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "before", "value", "after", "label"), map(list, zip(*out)))))

    return sample.mapInArrow(plant, "path string, before binary, value binary, after binary, label long")


def train_forest(findings: DataFrame, language: Language, *, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A Spark ML random forest over the features of labelled findings, brought to arrays of bounded size."""
    spark = findings.sparkSession
    shared = spark.sparkContext.broadcast(language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([describe(r["path"] or "", r["before"], r["value"], r["after"], shared.value) for r in rows], pa.list_(pa.float64())),
                "label": pa.array([float(r["label"]) for r in rows], pa.float64()),
            })

    table = pin(findings.mapInArrow(features, "x array<double>, label double").repartition(1).sortWithinPartitions("x", "label"), "secrets-findings")
    fitted = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(
        table.select(array_to_vector("x").alias("features"), "label"))
    path = fresh_path(spark, "secrets-forest")
    fitted.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("level"))
    return Forest(nodes.collect())


# Scan and redact --------------------------------------------------------------------------------------------------


def _judged(texts: pa.Array, paths: list, model: tuple[Language, Forest], threshold: float) -> Iterator[tuple[int, bytes, int, int, float]]:
    """(row, bytes of its block, first byte, byte after, probability) of confirmed findings."""
    language, forest = model
    for first, _, words in blocks(texts):
        data = words.data.tobytes()
        found = list(candidates(words, data))
        if not found:
            continue
        is_block = np.array([bool(_KEY_MARK.match(data, a, z)) for _, a, z in found])
        x = np.array([
            describe(paths[first + t] or "", data[max(int(words.offsets[t]), a - 2 * _NEAR):a], data[a:a + 10] if block else data[a:z], data[z:min(int(words.offsets[t + 1]), z + 2 * _NEAR)], language)
            for (t, a, z), block in zip(found, is_block.tolist())
        ])
        p = forest.probability(x)
        p = np.where(is_block, 1.0, p)
        end = -1
        for (t, a, z), probability in zip(found, p.tolist()):
            if probability >= threshold and a >= end:
                end = z
                yield first + t, data[int(words.offsets[t]):int(words.offsets[t + 1])], a - int(words.offsets[t]), z - int(words.offsets[t]), probability


def fit_scanner(docs: DataFrame, findings: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[Language, Forest]:
    """Dictionary and forest; ``findings`` are labelled findings, by default planted ones."""
    language = learn_language(docs, text=text)
    return language, train_forest(findings if findings is not None else planted_findings(docs, doc_id=doc_id, text=text, source=source), language)


def scan_secrets(docs: DataFrame, model: tuple[Language, Forest], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, sha256, probability): places in characters, and a digest instead of the secret."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("path"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            ids, out = batch.column("doc_id").to_pylist(), []
            for row, data, a, z, p in _judged(batch.column("text"), batch.column("path").to_pylist(), shared.value, threshold):
                out.append((ids[row], len(data[:a].decode("utf-8", "replace")), len(data[a:z].decode("utf-8", "replace")), hashlib.sha256(data[a:z]).hexdigest(), p))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["doc_id", "start", "length", "sha256", "probability"])

    return rows.mapInArrow(scan, "doc_id long, start int, length int, sha256 string, probability double")


def redact_secrets(docs: DataFrame, model: tuple[Language, Forest], *, text: str = "text", source: str = "source", n_chars: str = "n_chars", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """The rows of ``docs`` with every confirmed secret replaced by ``mark``; n_chars is set anew where it exists and the text changed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            place, path = batch.schema.get_field_index(text), batch.schema.get_field_index(source)
            changed: dict[int, list] = {}
            for row, data, a, z, _ in _judged(batch.column(place), batch.column(path).cast(pa.string()).to_pylist(), shared.value, threshold):
                changed.setdefault(row, [data, []])[1].append((a, z))
            if changed:
                texts = batch.column(place).to_pylist()
                for row, (data, spans) in changed.items():
                    parts, at = [], 0
                    for a, z in spans:
                        parts += [data[at:a], mark.encode()]
                        at = z
                    texts[row] = b"".join([*parts, data[at:]]).decode("utf-8", "replace")
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
                size = batch.schema.get_field_index(n_chars)
                if size >= 0:
                    counts = batch.column(size).to_pylist()
                    for row in changed:
                        counts[row] = len(texts[row])
                    batch = batch.set_column(size, batch.schema.field(size), pa.array(counts, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(redact, docs.schema)
