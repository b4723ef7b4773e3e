"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in an order drawn from the seed, end to end,
and again from the start when the target asks for more than one pass. The stream is cut into
blocks; the quota of a source is its target in words, hence a number of blocks. A tree splits
the vector of block quotas among the output shards: a node's blocks are divided between its
children by a multivariate hypergeometric draw, as if shuffled blocks were dealt out, down to
single shards, so all quotas are met exactly. A shard then takes its share of each source's
blocks from a pseudo-random permutation of them (shares are disjoint) and is shuffled locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.llm import common

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Words of a block, blocks of a shard. numpy draws from fewer than 1e9 blocks: 1.6e13 words.
BLOCK_WORDS = 16_384
SHARD_BLOCKS = 32
#: Levels of the tree that one task splits, and sources drawn for at once.
LEVELS = 4
SOURCES_AT_ONCE = 1_024
#: Parts a source's order is cut into for its running sum.
CHUNKS = 1_024
SEED = 20_240_101
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``: the position of each source by code point, null last, from 0.

    Names are range-partitioned; a partition's places follow those of the partitions before.
    """
    order = [F.col("source").asc_nulls_last()]
    ranged = sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = common.written(ranged, "sources")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_base"),
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return local.withColumn("_place", within).join(base, "_part").select(
        *sources.columns, (F.col("_place") + F.col("_base")).alias("place")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add ``place`` and ``target`` to (source, source_size): the share of all words by weight.

    A target stops at ``most`` times its source's size; the excess is shared by weight among the
    others until none is above. Each round finds the sources that are full at the present
    level; the level only rises, and a round's totals are two numbers.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = common.written(ranked(sources).withColumn("_w", weight), "targets")
    cap = F.col("source_size") * most
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = cap <= F.col("_w") * level
        row = rows.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("_w"))).alias("open"),
            F.sum(capped.cast("long")).alias("full"),
        ).first()
        if not total or not row["open"] or row["full"] == full:
            break
        full, level = row["full"], (total - row["held"]) / row["open"]
    return rows.withColumn(
        "target", F.least(cap.cast("double"), F.col("_w") * level if total else F.lit(0.0))
    ).drop("_w")


def _permuted(block: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudo-random permutation of 0..n-1 for each key: a Feistel cipher on the smallest
    even number of bits that holds n, applied again while its result is n or more."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, top = block.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for turn in range(4):
            mixed = (right + key[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask[todo])
        x[todo] = left << half[todo] | right
        todo = x >= top
    return x.astype(np.int64)


def permuted_position(key: Column, block: Column, n: Column) -> Column:
    """Position of a block among its source's n blocks, in an order drawn from ``key``."""

    def run(keys: pd.Series, blocks: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(_permuted(blocks.to_numpy(), sizes.to_numpy(), keys.to_numpy().view(np.uint64)))

    return F.pandas_udf(run, "long")(key, block, n)


def _deal(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks by source among ``take`` dealt from ``counts``: over groups of sources first, then
    within each, which is the same distribution."""
    groups = np.add.reduceat(counts, np.arange(0, len(counts), SOURCES_AT_ONCE))
    by_group = rng.multivariate_hypergeometric(groups, take, method="marginals")
    return np.concatenate(
        [
            rng.multivariate_hypergeometric(counts[k * SOURCES_AT_ONCE : (k + 1) * SOURCES_AT_ONCE], int(n), method="marginals")
            for k, n in enumerate(by_group)
        ]
    )


def _split(seed: int, levels: int):
    """Split a node's blocks over 2**levels children; a node covers shards lo..lo+width-1."""

    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("place")
        place = node["place"].to_numpy()
        at = [(int(node["lo"].iloc[0]), int(node["width"].iloc[0]), node["first"].to_numpy(), node["n"].to_numpy())]
        for _ in range(levels):
            below = []
            for lo, width, first, n in at:
                if width == 1:
                    below.append((lo, width, first, n))
                    continue
                half = width // 2
                # Shards are equally large up to one block.
                take = int(n.sum()) * half // width
                left = _deal(n, take, np.random.default_rng([seed, lo, width]))
                below += [(lo, half, first, left), (lo + half, width - half, first + left, n - left)]
            at = below
        return pd.concat(
            [
                pd.DataFrame({"place": place, "lo": lo, "width": width, "first": first, "n": n})[n > 0]
                for lo, width, first, n in at
            ]
            or [node[["place", "lo", "width", "first", "n"]][:0]]
        )

    return run


def shares(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard, place, first, n: which permuted blocks of each source (place, blocks) a shard gets.

    Level by level of the splitting tree, ``LEVELS`` at a time; a node is one group.
    """
    nodes = quotas.where("blocks > 0").select(
        "place", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("width"),
        F.lit(0).cast("long").alias("first"), F.col("blocks").alias("n"),
    )
    schema = "place long, lo long, width long, first long, n long"
    for _ in range(0, max(1, (shards - 1).bit_length()), LEVELS):
        nodes = common.written(nodes.groupBy("lo").applyInPandas(_split(seed, LEVELS), schema), "shares")
    return nodes.select(F.col("lo").alias("shard"), "place", "first", "n")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, text_key, source, size, order: the narrow rows the mix is worked out on."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        common.text_key(text).alias("text_key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
    )
    return rows.withColumn("order", F.xxhash64(F.lit(SEED), F.coalesce("doc_id", F.lit(-1)), "text_key"))


def positions(rows: DataFrame) -> DataFrame:
    """Add ``begin`` to rows with words: the words before a document in its source's order.

    A source is cut into ``CHUNKS`` parts of its order, so that no task orders a whole source.
    """
    parted = rows.where("size > 0").withColumn("_chunk", F.shiftrightunsigned("order", 64 - CHUNKS.bit_length() + 1))
    sums = parted.groupBy("place", "_chunk").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("place").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("place", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = (
        Window.partitionBy("place", "_chunk")
        .orderBy("order", "doc_id", "text_key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = parted.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(base, ["place", "_chunk"]).withColumn("begin", F.col("_in") + F.col("_base")).drop(
        "_chunk", "_in", "_base"
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(rows, placements).

    rows: doc_id, text_key, source, size, source_size, target and a key ``order`` for every row
    of ``docs``, and the ``place`` of its source. placements: for every time the mix takes a
    document its source and place, order, begin, pass (from 0), words taken, shard and position in
    the shard. Rows of one id and text in several sources are told apart by their place.

    Words taken from a source are its target, rounded down to whole words; only the document at
    the end of a quota is taken in part (its first words). No words: never taken. A null source
    is a source of its own, a null id is a document like others, rows that repeat one another
    are taken one by one, an empty table gives empty results.
    """
    slim = common.written(sized(docs, doc_id, text, source), "sized")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = common.written(targets(sources, weights, most), "targets")
    known = slim.alias("d").join(aimed.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.source_size", "t.target", "t.place")
    quota = F.floor("target").cast("long")
    quotas = aimed.select("place", F.ceil(quota / block_words).cast("long").alias("blocks"))
    blocks = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-blocks // shard_blocks))
    dealt = shares(quotas, shards, seed)
    dealt = dealt.select("place", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))

    passes = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("pass")
    taken = positions(known).select("*", passes).withColumn("_start", F.col("pass") * F.col("source_size") + F.col("begin"))
    taken = taken.where(F.col("_start") < quota).select(
        "doc_id",
        "text_key",
        "order",
        "begin",
        "pass",
        "place",
        "source",
        F.least(F.col("size"), quota - F.col("_start")).alias("words"),
        F.floor(F.col("_start") / block_words).alias("block"),
        F.ceil(quota / block_words).cast("long").alias("blocks"),
    )
    at = permuted_position(F.xxhash64(F.lit(seed), "place"), F.col("block"), F.col("blocks"))
    met = taken.withColumn("at", at).join(dealt, ["place", "at"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "order", "pass"), "place", "begin", "pass")
    return known, met.select(
        "doc_id", "text_key", "source", "place", "order", "begin", "pass", "words", "shard", F.row_number().over(local).alias("position")
    )


def taken_words(rows: DataFrame, placements: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of the mix; rows that repeat one another
    share what is taken of them, as their turns come."""
    nth = Window.partitionBy("order", "doc_id", "text_key", "place").orderBy("size")
    taken = placements.groupBy("place", "doc_id", "text_key", "order", "begin").agg(
        F.sum("words").alias("taken"), F.count("*").alias("passes"), F.min("shard").alias("first_shard")
    )
    turn = Window.partitionBy("order", "doc_id", "text_key", "place").orderBy("begin")
    taken = taken.withColumn("nth", F.row_number().over(turn)).drop("begin")
    counted = rows.withColumn("nth", F.row_number().over(nth))
    joined = counted.alias("r").join(
        taken.alias("t"),
        F.expr("r.place = t.place AND r.order = t.order AND r.doc_id <=> t.doc_id AND r.text_key = t.text_key AND r.nth = t.nth"),
        "left",
    )
    return joined.select(
        "r.doc_id",
        "r.size",
        "r.source_size",
        "r.target",
        F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("t.passes", F.lit(0)).cast("long").alias("passes"),
        "t.first_shard",
    )
