"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (of the larger or the smaller ones, itself) to the smallest."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = directed.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def smallest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node of an edge with the smallest node it can reach.

    Large stars link a node's larger neighbours to its smallest one, small stars its smaller
    ones; when nothing changes every node points at its root. Rounds grow with the logarithm
    of the longest chain. Self-links and repeated links are allowed, null ends are not.
    """
    at = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    at = common.written(at, "edges")
    state = _state(at)
    while state[0]:
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        at = common.written(_star(large, False).where("u != v"), "edges")
        before, state = state, _state(at)
        if state == before:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
