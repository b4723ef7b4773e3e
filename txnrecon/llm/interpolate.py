"""Language-model scoring by deleted interpolation.

The probability of a token after its predecessor mixes three estimates: the bigram's relative
frequency, the token's, and a uniform one. The mixture weights depend on how often the context
was seen (a bucket per power of two). They are learned by expectation-maximisation on held-out
counts: each training token is held out in turn, that is, taken off the counts that predict it.

No n-gram table is collected or broadcast. Documents are packed into chunks; a chunk asks for the
training counts of its distinct n-grams, in sorted order, dealt out over buckets of the hash
space. A bucket adds up what its chunks bring and answers each with counts in the order asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

#: Tokens of a chunk; a longer document is a chunk of its own.
CHUNK_TOKENS = 1_500_000
#: Tokens a bucket of n-grams is cut for: buckets grow with the corpus.
BUCKET_TOKENS = 16_000_000
#: Buckets of context frequency: unseen, 1, 2-3, 4-7 and so on.
CONTEXTS = 33
#: Steps per power of two in which held-out estimates are gathered for EM.
STEPS = 8
ROUNDS = 100

_END, _BEGIN = np.uint64(0x51ED270B7A6B0F3D), np.uint64(0x2545F4914F6CDD1D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of two, from the hashes of their tokens."""
    h = first * _A ^ (second + _B) * (second | np.uint64(1))
    h = (h ^ (h >> np.uint64(32))) * _B
    return (h ^ (h >> np.uint64(29))) * _A


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


CHUNK = (
    "chunk long, doc_id array<long>, train array<boolean>, sizes array<int>, ids binary, hashes binary, trained long"
)


def chunks(docs: DataFrame, learn: Column, doc_id: str, text: str, tokens: int) -> DataFrame:
    """Documents as token numbers, a few thousand to a row: A-Z lower-cased, words between ASCII
    white space, number 0 for the end of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        numbers, ids, doc, train = _Numbers(), [], [], []

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
            blobs = _pack(np.concatenate(ids)), np.concatenate(([_END], hashes)).tobytes()
            trained = int(sizes[np.array(train)].sum())
            columns = [base + made], [doc], [train], [sizes], [blobs[0]], [blobs[1]], [trained]
            types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()
            names = ["chunk", "doc_id", "train", "sizes", "ids", "hashes", "trained"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        held = 0
        for batch in batches:
            for d, t, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (body.as_py() or b"").lower().split()
                line = np.zeros(len(words) + 1, dtype=np.uint32)
                line[:-1] = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words))
                ids.append(line)
                doc.append(d)
                train.append(t)
                held += len(line)
                if held >= tokens:
                    yield row()
                    made, held = made + 1, 0
                    numbers, ids, doc, train = _Numbers(), [], [], []
        if ids:
            yield row()

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(learn, F.lit(False)).alias("train"),
        F.col(text).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, CHUNK)


class _Chunk:
    """The n-grams of a chunk: per token the place of its unigram and its bigram among the
    sorted distinct ones."""

    def __init__(self, train: np.ndarray, sizes: np.ndarray, ids: bytes, hashes: bytes):
        self.sizes, self.train = sizes, np.repeat(train, sizes)
        number, known = _unpack(ids, np.uint32), np.frombuffer(hashes, dtype=np.uint64)
        self.firsts = np.cumsum(sizes) - sizes
        token = known[number]
        before = np.concatenate(([_BEGIN], token[:-1]))
        before[self.firsts] = _BEGIN
        order = np.argsort(known, kind="stable")
        place = np.empty(len(known), dtype=np.int64)
        place[order] = np.arange(len(known))
        self.keys = [known[order], None]
        self.places = [place[number], None]
        self.keys[1], self.places[1] = np.unique(_pairs(before, token), return_inverse=True)

    def trained(self, kind: int) -> np.ndarray:
        return np.bincount(self.places[kind][self.train], minlength=len(self.keys[kind])).astype(np.uint32)


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash space begins among sorted keys."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


REQUEST = "kind int, bucket int, chunk long, keys binary, trained binary"


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, train, sizes, ids, hashes = (c[i] for c in batch.columns)
                own = _Chunk(
                    np.array(train.as_py(), dtype=bool), sizes.values.to_numpy(), ids.as_py(), hashes.as_py()
                )
                for kind in (0, 1):
                    keys, trained = own.keys[kind], own.trained(kind)
                    cuts = _bucket_cuts(keys, buckets)
                    full = np.flatnonzero(np.diff(cuts))
                    parts = [slice(cuts[b], cuts[b + 1]) for b in full]
                    steps = [_pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts]
                    arrays = [
                        pa.array(np.full(len(full), kind, dtype=np.int32)),
                        pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), chunk.as_py(), dtype=np.int64)),
                        pa.array(steps, pa.binary()),
                        pa.array([_pack(trained[p]) for p in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["kind", "bucket", "chunk", "keys", "trained"])

    return run


ANSWER = "chunk long, kind int, bucket int, counts binary, types long"


def _answer(bucket: pa.Table) -> pa.Table:
    """Add up the training counts of a bucket and answer each chunk in the order it asked."""
    keys = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in bucket.column("keys").to_pylist()]
    trained = [_unpack(b, np.uint32) for b in bucket.column("trained").to_pylist()]
    kinds, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(trained), minlength=len(kinds)).astype(np.uint64)
    cuts = np.cumsum([0, *map(len, keys)])
    types = np.zeros(len(keys), dtype=np.int64)
    types[0] = (total > 0).sum()
    counts = [_pack(total[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    names = ["chunk", "kind", "bucket", "counts", "types"]
    columns = [bucket.column("chunk"), bucket.column("kind"), bucket.column("bucket"), pa.array(counts, pa.binary()), types]
    return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names)


ALIGNED = "doc_id array<long>, train array<boolean>, sizes array<int>, unigrams binary, bigrams binary"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per token of a chunk: the training count of its unigram and of its bigram."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, train, sizes, ids, hashes, answers = (c[i] for c in batch.columns)
            own = _Chunk(np.array(train.as_py(), dtype=bool), sizes.values.to_numpy(), ids.as_py(), hashes.as_py())
            given = sorted(answers.as_py(), key=lambda a: (a["kind"], a["bucket"]))
            counts = [np.concatenate([_unpack(a["counts"], np.uint64) for a in given if a["kind"] == k]) for k in (0, 1)]
            blobs = [_pack(counts[k][own.places[k]]) for k in (0, 1)]
            columns = [doc_id.as_py()], [train.as_py()], [sizes.as_py()], [blobs[0]], [blobs[1]]
            types = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()
            names = ["doc_id", "train", "sizes", "unigrams", "bigrams"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _counts(batch: pa.RecordBatch, i: int, begun: int) -> tuple[np.ndarray, ...]:
    """sizes, train flag, and per token the counts of its context, bigram and unigram."""
    sizes = batch.column("sizes")[i].values.to_numpy()
    train = np.array(batch.column("train")[i].as_py(), dtype=bool)
    one = _unpack(batch.column("unigrams")[i].as_py(), np.uint64).astype(np.float64)
    two = _unpack(batch.column("bigrams")[i].as_py(), np.uint64).astype(np.float64)
    context = np.concatenate(([0.0], one[:-1]))
    context[np.cumsum(sizes) - sizes] = begun
    return sizes, train, context, two, one


def _bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


def _held_out(begun: int, total: int):
    """Held-out estimates of the training tokens, gathered by context bucket and logarithmic
    steps: bucket, step of the bigram estimate (-1: zero), step of the unigram's, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, train, context, two, one = _counts(batch, i, begun)
                own = np.repeat(train, sizes)
                context, two, one = context[own] - 1, two[own] - 1, one[own] - 1
                step = lambda p: np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int64)
                keys = np.stack(
                    [_bucket_of(context), step(two / np.maximum(context, 1)), step(one / max(1, total - 1))], axis=1
                )
                packed = (keys[:, 0] << 40) + ((keys[:, 1] + 1) << 20) + keys[:, 2] + 1
                kinds, n = np.unique(packed, return_counts=True)
                arrays = [pa.array(kinds), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["held", "n"])

    return run


def weights(held: np.ndarray, n: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per context bucket, by EM."""
    bucket, two, one = held >> 40, ((held >> 20) & 0xFFFFF) - 1, (held & 0xFFFFF) - 1
    p = np.stack(
        [np.where(two < 0, 0, np.exp2(-two / STEPS)), np.where(one < 0, 0, np.exp2(-one / STEPS)), np.full(len(held), 1 / (types + 1))],
        axis=1,
    )
    mixed = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    mixed[0] = 0, 0.9, 0.1
    for _ in range(rounds):
        share = mixed[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        for k in range(3):
            gathered = np.bincount(bucket, share[:, k], CONTEXTS)
            # A tenth of a token to each estimate keeps rare buckets off the edges.
            mixed[:, k] = gathered + (0.1 if k else 0.1 * (np.arange(CONTEXTS) > 0))
        mixed /= mixed.sum(axis=1, keepdims=True)
    return mixed


def _scores(mixed: np.ndarray, begun: int, total: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, train, context, two, one = _counts(batch, i, begun)
                w = mixed[_bucket_of(context)]
                p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(1, total) + w[:, 2] / (types + 1)
                base = np.log10((one + 0.5) / (total + 0.5 * (types + 1)))
                firsts = np.cumsum(sizes) - sizes
                arrays = [
                    batch.column("doc_id")[i].values,
                    pa.array(~train),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((one > 0).astype(np.int64), firsts)),
                    pa.array(np.full(len(sizes), total, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, firsts)),
                    pa.array(np.add.reduceat(np.log10(p), firsts)),
                ]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return run


def score(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: per row of ``docs``.

    ``learn`` says which rows are counted. A null or empty text is one end token. With nothing to
    learn from, every token has probability one. Repeated rows count and are scored each; null
    ids stay null. Counts are of 64-bit hashes, exact up to 2^53.
    Estimates are mixed from bigrams, unigrams and a uniform one.
    """
    spark = docs.sparkSession
    packed = common.written(chunks(docs, learn, doc_id, text, tokens), "chunks")
    begun, total, each = packed.agg(
        F.sum(F.size(F.filter("train", lambda t: t))).cast("long"),
        F.sum("trained"),
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, size: n + size)),
    ).first()
    begun, total = begun or 0, total or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(each or 0) // BUCKET_TOKENS))
    asked = packed.select("chunk", "train", "sizes", "ids", "hashes").mapInArrow(_requests(buckets), REQUEST)
    answers = common.written(asked.groupBy("kind", "bucket").applyInArrow(_answer, ANSWER), "answers")
    types = answers.where("kind = 0").agg(F.sum("types")).first()[0] or 0
    given = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "counts")).alias("answers"))
    joined = packed.hint("merge").join(given, "chunk").select("doc_id", "train", "sizes", "ids", "hashes", "answers")
    aligned = common.written(joined.mapInArrow(_align, ALIGNED), "aligned")
    gathered = aligned.mapInArrow(_held_out(begun, total), "held long, n long").groupBy("held").agg(F.sum("n").alias("n"))
    rows = gathered.orderBy("held").collect()
    mixed = weights(
        np.array([r["held"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.float64), types
    )
    if not total:
        mixed = np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    return aligned.mapInArrow(
        _scores(mixed, begun, total, types),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
