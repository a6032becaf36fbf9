"""Prefix trie of conversations: every distinct sequence of first turns is a node, counted over all that begin with it.

A turn is known by an id of 16 bytes (a digest of role and text), so a conversation is a key of units of fixed width and
the trie is that of the keys. Tasks build adaptive radix trees over blocks of sorted keys (``radix_tree``) and report the
nodes at depths between turns; what they cannot know alone is put together by joins:

* Positions of turns come from a sort of all rows (``with_running``), so a conversation of any length is no group of its
  own. Keys are cut into segments of ``segment`` turns. A segment hangs below the digest of all turns before it, which is
  folded as a stream over one digest a segment; only conversations longer than a segment take part.
* Equal segments below the same beginning are counted first, then range-partitioned by key: a first turn that a third of
  all conversations share is spread over tasks like any other range, and copies are one row.
* In a block, a node is open if its subtree may go on elsewhere: it is a beginning of the first or last key of the block,
  or something below continues in a further segment. All other nodes are final. Open nodes (two paths a block, and the
  paths of long conversations) are summed by id, and their subtree totals come from pointer doubling: as many rounds as
  the depth has binary digits, each reading a written table.
* Ids of the conversations that end at a node are sorted by range and hashed in order; where a node's ids fill several
  tasks, their pieces are hashed by one task as a stream.

Cases: a null role or text counts as empty. Turns are ordered by ``turn``, nulls first, then by the digest of the turn, so
that ties have one order; equal rows are turns of their own. Rows without a conversation id belong to no conversation and
are left out. Texts may have any length: only digests and word counts leave the scan. Conversations without turns are
members of the root and end there. Without conversations there are no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.ngrams import fold_of
from tillwork.llm.radix_tree import RadixTree
from tillwork.plans.global_order import with_running
from tillwork.session import pin

WIDTH = 16
SEGMENT = 64
ROOT = bytes(WIDTH)
_BLOCK = 8_192  # keys of a radix tree
_PIECE = 1 << 16  # conversation ids hashed or handed on at once
_WORDS = r"[^\x20\x09-\x0D]+"


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, WIDTH)


def numbered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``position`` (from 1), ``id`` (16 bytes) and ``words`` of every turn; ``n_turns`` of its conversation."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        _digest(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary")).alias("id"),
        F.regexp_count(what, F.lit(_WORDS)).cast("long").alias("words"))
    placed = with_running(rows, [F.col("turn").asc_nulls_first(), F.col("id").asc()], group=["conv_id"], group_size="n_turns")
    return placed.select("conv_id", "position", "id", "words", "n_turns")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of another one: ``(conversations, turns)``.

    Conversation c takes the first h turns of c - c % ``every`` (h: the unsigned crc32 of its decimal id modulo ``most`` + 1;
    all turns if there are fewer), then its own turns after the first h. The first frame has ``conv_id`` and ``n_turns`` (0 is
    possible), the second the columns of ``turns``.
    """
    turns = pin(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("n_turns").alias("own"))
    opening = turns.where((F.col("conv_id") % every == 0) & (F.col("position") <= most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("position", "id", "words"))).alias("opening"))
    h = fold_of(F.col("conv_id"), most + 1).cast("int")
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(opening, "base", "left")
    none = F.array().cast(opening.schema["opening"].dataType)
    convs = convs.select("conv_id", "own", "h", F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")).alias("opening"))
    convs = pin(convs.withColumn("n_turns", F.size("opening") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    first = convs.select("conv_id", F.explode("opening").alias("o"), "n_turns").select("conv_id", "o.position", "o.id", "o.words", "n_turns")
    shift = convs.select(F.col("conv_id").alias("c"), "h", (F.size("opening") - F.col("h")).alias("shift"), F.col("n_turns").alias("n"))
    rest = turns.join(shift, (F.col("conv_id") == F.col("c")) & (F.col("position") > F.col("h")))
    rest = rest.select("conv_id", (F.col("position") + F.col("shift")).alias("position"), "id", "words", F.col("n").alias("n_turns"))
    return convs.select("conv_id", "n_turns"), first.unionByName(rest)


# Segments ----------------------------------------------------------------------------------------------------------

def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of all turns before each segment, from rows (conv_id, seg, digest) sorted by both."""
    conv, so_far = None, ROOT
    for batch in batches:
        out = []
        for c, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if c != conv:
                conv, so_far = c, ROOT
            out.append(so_far)
            so_far = below(so_far, digest)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["c", "s", "top"])


def below(top: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(top + digest).digest()[:WIDTH]


def node_id(top: bytes, key: bytes) -> bytes:
    """The id of the node that lies ``key`` below ``top``; also the ``top`` of a segment that follows a full one."""
    return below(top, hashlib.sha256(key).digest()[:WIDTH]) if key else top


def segments(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """One row per conversation and segment: ``top``, ``seg``, ``key`` (ids of the turns), ``words`` and ``last``."""
    number = F.floor((F.col("position") - 1) / segment).cast("long")
    cut = turns.groupBy("conv_id", number.alias("seg"), "n_turns").agg(F.sort_array(F.collect_list(F.struct("position", "id", "words"))).alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), ""))
    cut = cut.select("conv_id", "seg", "n_turns", key.alias("key"), F.col("t.words").alias("words"))
    empty = convs.where(F.col("n_turns") == 0).select(
        "conv_id", F.lit(0).cast("long").alias("seg"), "n_turns", F.lit(b"").alias("key"), F.array().cast("array<long>").alias("words"))
    cut = pin(cut.unionByName(empty).withColumn("last", (F.col("seg") + 1) * segment >= F.col("n_turns")), "segments")
    long_ = cut.where(F.col("n_turns") > segment).select("conv_id", "seg", _digest(F.col("key")).alias("d"))
    tops = long_.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_chain, "c long, s long, top binary")
    later = cut.where("seg > 0").join(tops, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
    return cut.where("seg = 0").withColumn("top", F.lit(ROOT)).unionByName(later)


# Blocks of keys ----------------------------------------------------------------------------------------------------

_NODE = "id binary, parent binary, depth long, n_convs long, conv_id long, words long, kids long, leaves long, saved long, open boolean, parent_conv long"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


class _State:
    """What is known below a place: members, smallest one, and the final nodes right below with the sums of their subtrees."""

    __slots__ = ("n", "conv", "kids", "leaves", "saved", "open", "row", "tops")

    def __init__(self):
        self.n, self.conv, self.kids, self.leaves, self.saved, self.open, self.row, self.tops = 0, None, 0, 0, 0, False, None, []


def _join(into: _State, other: _State) -> None:
    into.n += other.n
    if into.conv is None or (other.conv is not None and other.conv < into.conv):
        into.conv = other.conv
    into.kids += other.kids
    into.leaves += other.leaves
    into.saved += other.saved
    into.open |= other.open
    into.row = into.row or other.row
    into.tops += other.tops


def block_nodes(top: bytes, seg: int, rows: list[tuple], segment: int, cut_before: bool, cut_after: bool) -> list[list]:
    """The nodes of one block: rows (key, words, n, smallest conversation, how many end here) sorted by key below one top.

    ``cut_before`` and ``cut_after`` say that rows of the same top may lie in other blocks.
    """
    tree, out = RadixTree(), []
    for row in rows:
        tree.insert(row[0], row)
    edges = [rows[0][0]] * cut_before + [rows[-1][0]] * cut_after

    def start(row: tuple | None) -> _State:
        state = _State()
        if row is not None:
            state.n, state.conv, state.row, state.open = row[2], row[3], row, row[4] < row[2]
        return state

    def close(state: _State, units: int) -> _State:
        up = _State()
        up.n, up.conv, up.row = state.n, state.conv, state.row
        if not units:  # the top is a node of the segment before, which counts its members; the root has none before it
            own = (state.n, state.conv) if seg == 0 else (0, None)
            out.append([top, None, seg * segment, *own, 0, state.kids, state.leaves, state.saved, True, None])
            return up
        key, words = state.row[0][:units * WIDTH], state.row[1][units - 1]
        parent = node_id(top, key[:-WIDTH])
        node = [node_id(top, key), parent, seg * segment + units, state.n, state.conv, words, state.kids, state.leaves, state.saved, False, None]
        if state.open or any(e.startswith(key) for e in edges):
            node[9] = up.open = True
        else:
            node[7], node[8] = state.leaves + (state.kids == 0), state.saved + (state.n - 1) * words
            up.kids, up.leaves, up.saved = 1, node[7], node[8]
            for child in state.tops:
                child[10] = state.conv
            up.tops = [node]
        out.append(node)
        return up

    tree.aligned(WIDTH, start, _join, close)
    return out


def _blocks(segment: int, block: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, cut_before = [], None, True

        def made(cut_after: bool) -> pa.RecordBatch:
            nodes = block_nodes(*name, held, segment, cut_before, cut_after)
            columns = zip(*nodes)
            return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[f.split()[1]]) for c, f in zip(columns, _NODE.split(", "))], _NAMES)

        for batch in batches:
            for top, seg, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((top, seg) != name or len(held) == block):
                    same = (top, seg) == name
                    yield made(same)
                    held, cut_before = [], same
                name = (top, seg)
                held.append(tuple(row))
        if held:
            yield made(True)

    return build


# Totals of open nodes ----------------------------------------------------------------------------------------------

def _doubled(open_: DataFrame) -> DataFrame:
    """``id`` and the sums of ``leaves`` and ``saved`` over the open nodes of its subtree; rows have ``up``, their parent."""
    depth = open_.agg(F.max("depth")).first()[0] or 0
    state = open_.select("id", "up", "leaves", "saved")
    for _ in range(int(depth).bit_length()):
        given = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("at")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        step = state.select(F.col("id").alias("via"), F.col("up").alias("next"))
        state = state.join(given, F.col("id") == F.col("at"), "left").join(step, F.col("up") == F.col("via"), "left")
        added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        state = pin(state.select("id", F.col("next").alias("up"), added("leaves", "l"), added("saved", "s")), "doubled")
    return state.select("id", "leaves", "saved")


def _hashed(finish: bool):
    """Rows (node, conv_id), sorted, into hashes of nodes, or pieces of ids where other tasks may hold more of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, edge, out = None, [], True, []

        def flush(last: bool) -> None:
            if not ids:
                return
            piece = ",".join(map(str, ids)).encode()
            whole = not edge and not last
            out.append((node, ids[0], None if whole else piece, hashlib.sha256(piece).hexdigest() if whole else None))
            ids.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary(), pa.string()))], ["node", "first", "piece", "sha"])
            out.clear()
            return made

        for batch in batches:
            for n, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    flush(False)
                    edge, node = node is None, n
                elif len(ids) >= _PIECE:
                    edge = True  # this node goes on as pieces
                    flush(False)
                ids.append(conv)
            if out:
                yield batch_of()
        flush(True)
        if out:
            yield batch_of()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, nodes, found = None, None, [], []
        for batch in batches:
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if sha:
                        nodes.append(node)
                        found.append(sha.hexdigest())
                    node, sha = n, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
        if sha:
            nodes.append(node)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "sha"])

    return pieces if finish else run


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``node`` and ``sha``: SHA-256 of the ascending decimal ids, joined by commas, of rows (node, conv_id)."""
    spread = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    first = pin(spread.mapInArrow(_hashed(False), "node binary, first long, piece binary, sha string"), "ends")
    rest = first.where(F.col("sha").isNull()).select("node", "first", "piece")
    rest = rest.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed(True), "node binary, sha string")
    return first.where(F.col("sha").isNotNull()).select("node", "sha").unionByName(rest)


def prefix_trie(convs: DataFrame, turns: DataFrame, *, segment: int = SEGMENT, block: int = _BLOCK) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, position, id, words, n_turns) of ``convs`` (conv_id, n_turns).

    One row per node: ``node`` (16 bytes), ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (the parent's
    conv_id), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (words that
    sharing the subtree's turns saves) and ``ends_sha256`` (of the ids of the conversations that end at the node).
    """
    placed = pin(segments(convs, turns, segment), "placed")
    keys = placed.groupBy("top", "seg", "key", "words").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.sum(F.col("last").cast("long")).alias("ends"))
    spread = keys.repartitionByRange("top", "key").sortWithinPartitions("top", "key").select("top", "seg", "key", "words", "n", "conv", "ends")
    nodes = pin(spread.mapInArrow(_blocks(segment, block), _NODE), "trie")
    merged = nodes.where("open").groupBy("id").agg(
        F.max("parent").alias("up"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    merged = pin(merged, "open")
    more = merged.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("of")).agg(F.count(F.lit(1)).alias("more"))
    open_ = merged.join(more, F.col("id") == F.col("of"), "left").withColumn("kids", F.col("kids") + F.coalesce(F.col("more"), F.lit(0)))
    own = (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved")
    open_ = pin(open_.select("id", "up", "depth", "n_convs", "conv_id", "kids", *own), "open")
    sums = _doubled(open_).withColumnRenamed("id", "_id")
    open_all = open_.drop("leaves", "saved").join(sums, F.col("id") == F.col("_id")).drop("_id").withColumn("parent_conv", F.lit(None).cast("long"))
    final = nodes.where("NOT open").withColumnRenamed("parent", "up")
    columns = ["id", "up", "depth", "n_convs", "conv_id", "kids", "leaves", "saved", "parent_conv"]
    both = final.select(columns).unionByName(open_all.select(columns))
    # Only nodes whose parent is open lack its smallest member.
    parents = open_.select(F.col("id").alias("_id"), F.col("conv_id").alias("_conv"))
    known = both.where(F.col("parent_conv").isNotNull() | F.col("up").isNull())
    asked = both.where(F.col("parent_conv").isNull() & F.col("up").isNotNull()).join(parents, F.col("up") == F.col("_id"))
    both = known.unionByName(asked.withColumn("parent_conv", F.col("_conv")).drop("_id", "_conv"))
    end = F.when(F.length("key") == 0, F.col("top")).otherwise(_digest(F.concat("top", _digest(F.col("key")))))
    shas = hashed_ends(placed.where("last").select(end.alias("node"), "conv_id"))
    out = both.join(shas, F.col("id") == F.col("node"), "left")
    return out.select(
        F.col("id").alias("node"), "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.col("sha"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
