"""Near-duplicates by SimHash and anchor points of a covering code.

A fingerprint has 64 bits. Two that differ in at most 4 agree up to 2 bits in one of their
32-bit halves. The anchors of a half are the words of a code of covering radius 1: the
perfect Hamming code on 31 bits, and one free bit. Two halves within 2 bits have a midpoint
within 1 of both; the midpoint has an anchor within the covering radius; so replicating a
half to every anchor within radius + 1 (16.5 on average) makes each such pair meet. Pairs
are compared on all 64 bits per anchor, so nothing is missed and nothing false is linked.

Equal fingerprints are one node. An anchor gives a spanning forest of its links, not all
pairs. An anchor with more than ``LIMIT`` fingerprints is cut into blocks, and each pair of
blocks is compared in a task of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common, components

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: Fingerprints of one anchor compared in one go.
LIMIT = 8_192
#: Shingles whose bits are counted at once.
SLAB = 65_536

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprint_of(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, most significant bit first."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in cuts), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), SLAB):
        # Each byte of a hash becomes eight one-byte counters; 255 of them add up without overflow.
        lanes = _LANES[hashes[k : k + SLAB].astype(">u8").view(np.uint8).reshape(-1, 8)]
        for j in range(0, len(lanes), 255):
            counts += lanes[j : j + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a signed long): one row per row of ``docs``.

    A null, empty or blank text has fingerprint 0. Words are separated by ASCII white space,
    A-Z are lower-cased; fewer words than a shingle make one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint_of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        common.text_key(text).alias("text_key"),
        F.col(text).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def anchor_masks() -> list[list[int]]:
    """By syndrome of a half's 31 coded bits: what to flip to reach each anchor within 2 bits."""
    free = 1 << 31
    masks = []
    for syndrome in range(32):
        near = [0] if syndrome == 0 else [1 << (syndrome - 1)]
        pairs = [
            (1 << (i - 1)) | (1 << ((i ^ syndrome) - 1))
            for i in range(1, 32)
            if syndrome and i < i ^ syndrome and i != syndrome
        ]
        masks.append(near + [m | free for m in near] + pairs)
    return masks


def _anchors(half: Column, side: int) -> Column:
    """Anchors near a 32-bit half; the side is part of the anchor."""
    parity = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    syndrome = sum(((F.bit_count(half.bitwiseAND(F.lit(m))) % 2) * (1 << k) for k, m in enumerate(parity)), F.lit(0))
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in anchor_masks()])
    flips = F.element_at(table, (syndrome + 1).cast("int"))
    return F.transform(flips, lambda m: half.bitwiseXOR(m) + F.lit(side << 32))


def replicas(fps: DataFrame) -> DataFrame:
    """anchor, fp: each distinct fingerprint beside every anchor near one of its halves."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select(F.explode(F.concat(_anchors(low, 0), _anchors(high, 1))).alias("anchor"), "fp")


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; every class is named by its smallest member."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(run: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints of equal ``run`` (sorted): smallest member, member."""
    n = len(fp)
    firsts = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1))
    sizes = np.diff(np.append(firsts, n))
    left = np.repeat(firsts + sizes, sizes) - np.arange(n)  # rows of the run from here on
    rows, root = np.flatnonzero(left > 1), np.arange(n)
    for lag in itertools.count(1):
        rows = rows[left[rows] > lag]
        if not len(rows):
            break
        near = rows[np.bitwise_count((fp[rows] ^ fp[rows + lag]).view(np.uint64)) <= threshold]
        if len(near):
            root = _roots(root, near, near + lag)
    linked = np.flatnonzero(root != np.arange(n))
    return fp[root[linked]], fp[linked]


FOUND = "block int, a long, b long"


def _found(block: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kinds = pa.array(np.full(len(a), block, dtype=np.int32))
    return pa.RecordBatch.from_arrays([kinds, pa.array(a), pa.array(b)], ["block", "a", "b"])


def _compare(threshold: int, limit: int):
    """Over (anchor, fp) sorted by anchor: links (block -1, smallest, member), or for anchors
    of more than ``limit`` rows the rows themselves (block number, anchor, fp)."""

    def small(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Large runs apart, so that their many lags don't touch the others."""
        firsts = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
        big = np.flatnonzero(np.diff(firsts) > 64)
        keep = np.ones(len(anchor), dtype=bool)
        for r in big:
            keep[firsts[r] : firsts[r + 1]] = False
            yield _found(-1, *_forest(anchor[firsts[r] : firsts[r + 1]], fp[firsts[r] : firsts[r + 1]], threshold))
        if keep.any():
            yield _found(-1, *_forest(anchor[keep], fp[keep], threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = fp = np.empty(0, dtype=np.int64)
        hot, block = None, 0
        for batch in batches:
            anchor = np.concatenate([anchor, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            while len(anchor):
                if hot is not None:
                    ours = int(np.searchsorted(anchor, hot, side="right"))
                    if not ours:  # only another anchor's row ends it: the next batch may go on with it
                        hot = None
                        continue
                    if ours == len(anchor) < limit:
                        break
                    ours = min(ours, limit)
                    yield _found(block, anchor[:ours], fp[:ours])
                    anchor, fp, block = anchor[ours:], fp[ours:], block + 1
                    continue
                last = int(np.searchsorted(anchor, anchor[-1]))
                if last:
                    yield from small(anchor[:last], fp[:last])
                    anchor, fp = anchor[last:], fp[last:]
                elif len(anchor) > limit:
                    hot, block = anchor[0], 0
                else:
                    break
        if len(anchor):
            yield _found(block, anchor, fp) if hot is not None else _found(
                -1, *_forest(anchor, fp, threshold)
            )

    return run


def _between_blocks(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = np.unique(np.concatenate([b.column("b").to_numpy() for b in batches]))
        yield _found(-1, *_forest(np.zeros(len(fp), dtype=np.int8), fp, threshold))

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect exactly what pairs
    within ``threshold`` bits connect. ``threshold`` may be at most 4, for which the anchors
    are chosen."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"threshold must be 0 to {THRESHOLD}")
    met = replicas(fps).repartition("anchor").sortWithinPartitions("anchor", "fp")
    first = common.written(met.mapInArrow(_compare(threshold, limit), FOUND), "links")
    crowd = first.where("block >= 0")
    blocks = crowd.groupBy("a").agg((F.max("block") + 1).alias("n"))
    paired = crowd.join(blocks, "a").select(
        "a", "b", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    )
    keyed = paired.select(
        "a", "b", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    second = keyed.groupBy("a", "i", "j").applyInArrow(_between_blocks(threshold), FOUND)
    return first.where("block < 0").select("a", "b").unionAll(second.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, limit: int = LIMIT
) -> DataFrame:
    """doc_id, text_key, fp, component_id, kept: one row per row of ``docs``.

    component_id is the smallest doc_id of the rows whose fingerprints are reachable over
    links; null if none has an id. ``kept`` marks the component's representative: its
    smallest doc_id, of rows with that id the one of smallest text hash; rows that repeat
    both id and text are all marked. An empty table gives an empty result.
    """
    marked = common.written(fingerprints(docs, doc_id, text), "fingerprints")
    one = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("rep"))
    nodes = common.written(one, "nodes")
    label = components.smallest(links(nodes.select("fp"), threshold, limit), "a", "b")
    rooted = nodes.join(label, nodes["fp"] == label["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    reps = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    known = rooted.join(reps, "root").select("fp", "first")
    return marked.join(known, "fp").select(
        "doc_id",
        "text_key",
        "fp",
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias(
            "kept"
        ),
    )


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
