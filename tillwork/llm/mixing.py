"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is cut into blocks by the first hexadecimal digits of each document's md5 key, so the order of the keys is
a fixed random permutation of blocks, and of documents inside a block. A source's target is met by whole passes
over its blocks and then by the leading blocks of the permutation; only the last of them is taken in part. The block
draws of all sources are dealt to output shards by a binary tree: each node splits its draws between two halves of
its shards, and the number that each source sends to the left is a multivariate hypergeometric draw, so every shard
has its exact size and a random share of each source, without a global shuffle of rows. Every leaf draws its own blocks,
as many as its quota of a source says, and what is taken of a row is the sum of these draws.

Cases: a null text has size 0; a null source is a source of its own and sorts last; a null id is hashed as the text
"null". Documents of size 0 take part with 0 words. Rows that are equal in every column are kept apart, and which of
them is taken at a cut is of no consequence. An empty table gives an empty result. Added columns replace input columns
of the same name; all other columns come out unchanged, whatever their names. Each row of the splitting tree holds one number per source, so sources must be nameable (thousands,
not one per document).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.llm.columns import Aside
from tillwork.plans.global_order import with_running
from tillwork.session import pin

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_OF_SIZES = (3, 2)  # the mix has 150 % of all words
REPEATS = 2
SHARDS = 16
BLOCK_ROWS = 512
_BIG = "decimal(38,0)"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE_OF_SIZES, repeats: int = REPEATS) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per (_source, _words, _rows).

    Weights repeat in the sources' code point order. Sources whose share would pass ``repeats`` times their size are
    set to that, and the rest is shared again by weight, until no source is above.
    """
    order = [F.col("_source").asc_nulls_last()]
    slot = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    table = pin(
        with_running(sizes, order, position="_rank").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), slot + 1)),
        "mix-sources",
    )
    up, down = share
    limit = (F.col("_words") * repeats * down).cast(_BIG)
    total, free = table.agg(F.sum(F.col("_words").cast(_BIG)), F.sum(F.col("weight").cast(_BIG))).first()
    wanted = rest = int(total or 0) * up  # in 1/down words
    free = int(free or 0)
    while free:
        above = limit * F.lit(free).cast(_BIG) <= F.lit(rest).cast(_BIG) * F.col("weight")
        used, left = table.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if (int(left or 0), wanted - int(used or 0)) == (free, rest):
            break
        free, rest = int(left or 0), wanted - int(used or 0)
    shared = (F.lit(rest).cast(_BIG) * F.col("weight")).cast("double") / F.lit(float(down * max(free, 1)))
    above = (limit * F.lit(free).cast(_BIG) <= F.lit(rest).cast(_BIG) * F.col("weight")) | F.lit(free == 0)
    return table.withColumn("target", F.when(above, (F.col("_words") * repeats).cast("double")).otherwise(shared))


_UP = "(cast(_marked - k + 1 as double) * (_draws - k + 1)) / (cast(k as double) * (_total - _marked - _draws + k))"
_DOWN = "(cast(k + 1 as double) * (_total - _marked - _draws + k + 1)) / (cast(_marked - k as double) * (_draws - k))"


def _mass(steps: str, ratio: str) -> str:
    """Sum of the weights along ``steps``, the first relative to 1."""
    return f"aggregate({steps}, named_struct('w', 1D, 'm', 0D), (s, k) -> named_struct('w', s.w * {ratio}, 'm', s.m + s.w * {ratio})).m"


def _passed(steps: str, ratio: str, before: str) -> str:
    """How many of ``steps`` begin at or below _level, when ``before`` is the sum of weights ahead of them."""
    return (f"aggregate({steps}, named_struct('w', 1D, 'm', {before}, 'n', 0L), (s, k) -> named_struct('w', s.w * {ratio}, "
            f"'m', s.m + s.w * {ratio}, 'n', s.n + if(s.m <= _level, 1L, 0L))).n")


def _draw(rows: DataFrame) -> DataFrame:
    """Add ``_k``: how many of ``_marked`` among ``_total`` are in ``_draws`` draws, by inversion with the uniform ``_u``.

    Counts are walked from the mode upward, then from the mode downward, with weights relative to the mode's; beyond 14
    standard deviations those vanish in a double.
    """
    kept = rows.columns
    rows = rows.selectExpr(
        "*", "greatest(0L, _draws - (_total - _marked)) AS _low", "least(_draws, _marked) AS _high",
        "cast(14 * sqrt(cast(_draws as double) * _marked / greatest(_total, 1L) + 1) + 20 as bigint) AS _spread",
        "cast(floor((_draws + 1) * cast(_marked + 1 as double) / (_total + 2)) as bigint) AS _guess")
    rows = rows.selectExpr("*", "greatest(_low, least(_high, _guess)) AS _mode")
    rows = rows.selectExpr(
        "*", "if(_high > _mode, sequence(_mode + 1, least(_high, _mode + _spread)), cast(array() as array<bigint>)) AS _ups",
        "if(_low < _mode, sequence(_mode - 1, greatest(_low, _mode - _spread), -1L), cast(array() as array<bigint>)) AS _downs")
    rows = rows.selectExpr("*", f"{_mass('_ups', _UP)} AS _above", f"{_mass('_downs', _DOWN)} AS _below")
    rows = rows.selectExpr("*", "_u * (_above + _below + 1) AS _level")
    return rows.selectExpr(*kept, f"_mode + if(_level < _above + 1, {_passed('_ups', _UP, '1D')}, - {_passed('_downs', _DOWN, '_above + 1')}) AS _k")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def _dealt_left(nodes: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """(_lo, _from, _left): the counts of each source that a node sends to the left half of its shards.

    The draws of a node are split between two halves of its sources, again and again, each time by one
    hypergeometric draw; a single source gets what is left. Together that is one multivariate draw.
    """
    ranges = nodes.select("_lo", "_hi", F.lit(0).alias("_from"), "_counts", "_draws")
    for _ in range(max(0, math.ceil(math.log2(max(1, n_sources))))):
        size = F.size("_counts")
        half = F.floor((size + 1) / 2).cast("int")
        first, second = F.slice("_counts", F.lit(1), half), F.slice("_counts", half + 1, F.greatest(F.lit(0), size - half))
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_lo"), F.col("_hi"), F.col("_from"), size), 11) / F.lit(float(1 << 53))
        rows = _draw(ranges.withColumns({"_half": half, "_first": first, "_second": second, "_total": _sum(F.col("_counts")), "_marked": _sum(first), "_u": u}))
        halves = F.array(
            F.struct(F.col("_from").alias("f"), F.col("_first").alias("c"), F.col("_k").alias("d")),
            F.struct((F.col("_from") + F.col("_half")).alias("f"), F.col("_second").alias("c"), (F.col("_draws") - F.col("_k")).alias("d")),
        )
        ranges = pin(rows.select("_lo", "_hi", F.explode(F.filter(halves, lambda h: F.size(h["c"]) > 0)).alias("_h")).select(
            "_lo", "_hi", F.col("_h.f").alias("_from"), F.col("_h.c").alias("_counts"), F.col("_h.d").alias("_draws")), "mix-ranges")
    return ranges.groupBy("_lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_draws"))), lambda x: x["_draws"]).alias("_left"))


def shard_cuts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_source, _cuts): of each source's draws, shard j gets numbers _cuts[j] up to _cuts[j + 1]."""
    root = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("_source").isNull().alias("last"), "_source", "_draws"))).alias("_all"))
    root = pin(root.select(
        F.lit(0).alias("_lo"), F.lit(shards).alias("_hi"), F.col("_all._source").alias("_sources"), F.col("_all._draws").alias("_counts"),
        _sum(F.col("_all._draws")).alias("_whole"),
    ), "mix-tree")
    n_sources = root.select(F.size("_counts")).first()[0]
    at = lambda shard: F.floor(F.col("_whole") * shard / F.lit(shards)).cast("long")
    nodes = root
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        nodes = nodes.withColumn("_mid", F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int"))
        open_ = nodes.where(F.col("_hi") - F.col("_lo") > 1).withColumn("_draws", at(F.col("_mid")) - at(F.col("_lo")))
        left = _dealt_left(open_, n_sources, seed).withColumnRenamed("_lo", "_lo2")
        dealt = nodes.join(left, F.col("_lo") == F.col("_lo2"), "left")
        right = F.zip_with("_counts", "_left", lambda x, y: x - y)
        part = lambda lo, hi, counts: F.struct(lo.alias("lo"), hi.alias("hi"), counts.alias("counts"))
        halves = F.when(F.col("_left").isNotNull(), F.array(part(F.col("_lo"), F.col("_mid"), F.col("_left")), part(F.col("_mid"), F.col("_hi"), right)))
        halves = halves.otherwise(F.array(part(F.col("_lo"), F.col("_hi"), F.col("_counts"))))
        nodes = pin(dealt.select("_sources", "_whole", F.explode(halves).alias("_h")).select(
            "_sources", "_whole", F.col("_h.lo").alias("_lo"), F.col("_h.hi").alias("_hi"), F.col("_h.counts").alias("_counts")), "mix-tree")
    each = nodes.select("_lo", F.explode(F.arrays_zip(F.col("_sources").alias("source"), F.col("_counts").alias("count"))).alias("_x"))
    per = each.groupBy(F.col("_x.source").alias("_source")).agg(F.array_sort(F.collect_list(F.struct(F.col("_lo"), F.col("_x.count").alias("count")))).alias("_quotas"))
    cuts = F.aggregate("_quotas.count", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return per.select("_source", cuts.alias("_cuts"))


def leaf_draws(cuts: DataFrame) -> DataFrame:
    """(_source, _shard, _number): the draws of every leaf, numbered through the passes over the source's permuted blocks."""
    n = F.size("_cuts") - 1
    quota = F.arrays_zip(F.slice("_cuts", F.lit(1), n).alias("start"), F.slice("_cuts", F.lit(2), n).alias("stop"))
    leaves = cuts.select("_source", F.posexplode(quota).alias("_shard", "_quota")).where("_quota.stop > _quota.start")
    return leaves.select("_source", "_shard", F.explode(F.sequence(F.col("_quota.start"), F.col("_quota.stop") - 1)).alias("_number"))


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
    share=SHARE_OF_SIZES, repeats: int = REPEATS, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = 0,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken and shards (the output shard of each copy taken).

    Inside a shard the copies stand in the order of their md5 key (``shuffle_key``).
    """
    aside = Aside(docs)
    doc_id, text, source = map(aside.name, (doc_id, text, source))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    kept = aside.back("size", "source_size", "target", "taken", "shards", "shuffle_key")
    rows = aside.rows.select("*", word_count(text).alias("size"), key.alias("shuffle_key"), F.col(source).alias("_source"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_tie"))
    ids = rows.select("_source", "size", "shuffle_key")
    n_rows = docs.count()
    digits = max(1, math.ceil(math.log(max(1, n_rows / block_rows), 16)))
    block = F.substring("shuffle_key", 1, digits)
    per_block = pin(ids.groupBy("_source", block.alias("_block")).agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows")), "mix-blocks")
    sources = source_targets(per_block.groupBy("_source").agg(F.sum("_words").alias("_words"), F.count(F.lit(1)).alias("_blocks")), weights, share, repeats)
    whole = F.when(F.col("_words") > 0, F.floor(F.col("target") / F.col("_words"))).otherwise(0).cast("long")
    sources = sources.select(
        "_source", F.col("_words").alias("source_size"), "target", "_blocks", whole.alias("_whole"),
        (F.floor("target").cast("long") - whole * F.col("_words")).alias("_rest"),
    )
    ordered = with_running(per_block, [F.col("_block")], {"_upto": ("sum", "_words")}, position="_place", group=["_source"])
    s = sources.withColumnRenamed("_source", "_source2")
    blocks = ordered.join(s, F.col("_source").eqNullSafe(F.col("_source2"))).drop("_source2")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("_words"), F.col("_rest") - (F.col("_upto") - F.col("_words"))))
    blocks = pin(blocks.withColumn("_extra", extra), "mix-draws")
    last = F.coalesce(F.max(F.when(F.col("_extra") > 0, F.col("_place"))), F.lit(0))
    quotas = blocks.groupBy("_source").agg((F.first("_whole") * F.count(F.lit(1)) + last).cast("long").alias("_draws"))
    draws = leaf_draws(shard_cuts(quotas, shards, seed)).withColumnRenamed("_source", "_source2")
    draws = draws.join(sources.select("_source", "_blocks"), F.col("_source").eqNullSafe(F.col("_source2"))).select(
        "_source2", "_shard", (F.col("_number") % F.col("_blocks") + 1).alias("_place2"), F.expr("_number div _blocks").alias("_pass"))
    drawn = blocks.join(draws, F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_place") == F.col("_place2")), "left")
    full = F.col("_pass") < F.col("_whole")
    used = full | (F.col("_extra") > 0)
    blocks = drawn.groupBy(F.col("_source").alias("_source2"), F.col("_block").alias("_block2"), "source_size", "target").agg(
        F.count_if(full).alias("_full"), F.coalesce(F.sum(F.when(~full, F.col("_extra"))), F.lit(0).cast("long")).alias("_extra"),
        F.transform(F.array_sort(F.collect_list(F.when(used, F.struct("_pass", "_shard")))), lambda d: d["_shard"]).alias("_shards"),
    )
    joined = rows.join(blocks, F.col("_source").eqNullSafe(F.col("_source2")) & (block == F.col("_block2")))
    inside = W.partitionBy("_source2", "_block2").orderBy("shuffle_key", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_extra") - (F.sum("size").over(inside) - F.col("size"))))
    out = joined.withColumn("_part", part)
    return out.select(
        *kept, "size", "source_size", "target", (F.col("_full") * F.col("size") + F.col("_part")).alias("taken"),
        F.when((F.col("_extra") > 0) & (F.col("_part") == 0), F.slice("_shards", F.lit(1), F.col("_full").cast("int"))).otherwise(F.col("_shards")).alias("shards"),
        "shuffle_key",
    )
