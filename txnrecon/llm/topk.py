"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

A dimension is a term. A block of candidates is stored inverted: for each dimension the rows
that are not zero there and their weights. A block of queries is stored by query: its non-zero
dimensions and weights. Every query block meets every candidate block; each of its dimensions
scatters its weighted postings into dense score arrays, the k best of each query are selected by
partition, and the partial lists are merged. No candidate is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4_096

_OWN = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component x as double.

    Left out: null ids, null vectors, vectors with null or non-finite components.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


BLOCK = "ids array<long>, cuts array<int>, keys array<int>, weights array<long>"


def _blocks(rows: int, inverted: bool):
    """Pack (vec_id, v) into blocks of ``rows``: by row, or inverted by dimension."""

    def packed(ids: np.ndarray, row: np.ndarray, dim: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, place = ids[order], np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        row = place[row]
        full = weight != 0
        row, dim, weight = row[full], dim[full], weight[full]
        by, key = (dim, row) if inverted else (row, dim)
        order = np.lexsort((key, by))
        n = (int(dim.max()) + 1 if len(dim) else 0) if inverted else len(ids)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(by, minlength=n))))
        columns = (ids, cuts.astype(np.int32), key[order].astype(np.int32), weight[order])
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["ids", "cuts", "keys", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            lists = part.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            return packed(part.column("vec_id").to_numpy(), row, np.arange(len(flat)) - np.repeat(first, sizes), flat)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _best(k: int):
    """Over joined blocks: query_id, vec_id, score of the k best of each query in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_cuts, q_dims, q_weights, ids, cuts, rows, weights = (
                    c[i].values.to_numpy() for c in batch.columns
                )
                score = np.zeros((len(q_ids), len(ids)), dtype=np.int64)
                owner = np.repeat(np.arange(len(q_ids)), np.diff(q_cuts))
                by_dim = np.argsort(q_dims, kind="stable")
                bounds = np.searchsorted(q_dims[by_dim], np.arange(len(cuts)))
                for dim in range(len(cuts) - 1):
                    asks = by_dim[bounds[dim] : bounds[dim + 1]]
                    post = slice(cuts[dim], cuts[dim + 1])
                    if not len(asks) or post.start == post.stop:
                        continue
                    gain = q_weights[asks][:, None] * weights[post][None, :]
                    if len(asks) == len(q_ids) and post.stop - post.start == len(ids):
                        score += gain
                    else:
                        score[np.ix_(owner[asks], rows[post])] += gain
                lo, hi = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
                out = []
                for q in range(len(q_ids)):
                    others = np.delete(score[q], slice(lo[q], hi[q]))
                    names = np.delete(ids, slice(lo[q], hi[q]))
                    if len(others) > k:
                        least = np.partition(others, len(others) - k)[len(others) - k]
                        above, tied = np.flatnonzero(others > least), np.flatnonzero(others == least)
                        chosen = np.concatenate([above, tied[: k - len(above)]])  # ids ascend in a block
                    else:
                        chosen = np.arange(len(others))
                    out.append((np.full(len(chosen), q_ids[q]), names[chosen], others[chosen]))
                arrays = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return run


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = K,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``candidates`` for each of ``queries``, both
    (vec_id, v) with integer components; rows with the query's own id are no candidates.

    Ties go to the smaller vec_id. Vectors of different length meet in the dimensions they share.
    Of query rows that share an id the smallest vector asks; candidates that share an id all
    take part. Scores are 64-bit integers and wrap beyond that. No candidates, no rows.
    """
    spark = queries.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).repartition(F.col("vec_id"))
    q = asked.mapInArrow(_blocks(query_block, False), BLOCK).select(
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "cuts", "keys", "weights")],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    c = candidates.mapInArrow(_blocks(candidate_block, True), BLOCK)
    c = c.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    names = ("ids", "cuts", "keys", "weights")
    met = q.hint("merge").join(c, "salt").select(*[f"q_{n}" for n in names], *names)
    partial = met.mapInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
