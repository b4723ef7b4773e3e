"""Alignment of two tokenizers over whole texts, and how often their tokens end together.

Every text is encoded by a byte-level BPE of the tokenizers library (A, with a space before the
text) and by a sentencepiece model (B, which adds that space itself). Byte offsets where tokens of
both end cut them into groups; the two tokens that end there are linked.

Counting is external. Tasks turn chunks of documents into runs: one for each radix of the B id (its
high bits), holding (pair, document, times) in order of B, then A, compressed with zstd and
written. The runs of a radix are merged by a heap, many at a time and in several levels where there
are more, which sums each pair; as one B follows the other, the last merge also knows each B's
highest count. The counts then meet the same runs again and stream back, as one compressed vector
for each chunk and radix, what every document's links amount to. A radix that outgrows a task (one B
id may hold a third of all links) is merged and met in parts.

Defined results: texts that are null, empty or changed by a tokenizer have no tokens, and zeros;
repeated rows and null ids are rows like others; further columns of any name are ignored; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

#: Text and documents of a chunk, text encoded in one call.
CHUNK_BYTES, CHUNK_ROWS, CALL_BYTES = 2 << 20, 8_192, 1 << 18
#: Words a Python worker remembers, and their letters at most.
REMEMBERED, WORD = 100_000, 64
#: Words encoded in one piece.
TOGETHER = 128
#: B ids of one radix.
RADIX_BITS = 8
#: Runs and compressed bytes that one task merges or meets.
FAN, RUN_BYTES = 256, 16 << 20
#: Pairs decoded at once from a run.
BLOCK = 4_096
#: Bits of an id and of a document's number in a sort key.
ID_BITS, DOC_BITS = 20, 20

WRITTEN = (
    "chunk long, nth int, doc_id long, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>,"
    " radix int, pairs binary, entries binary"
)
RUN = "radix int, run long, pairs binary"
COUNTS = "radix int, counts binary"
SHARE = "chunk long, share binary"
SCORES = "chunk long, nth int, n_best long, count_sum long"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 10 * raw[0]
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        out.append(np.frombuffer(raw, dtype="<" + kind.decode(), count=n, offset=at))
        at += out[-1].nbytes
    return out


def byte_letters() -> dict[str, int]:
    """The letters a byte-level vocabulary writes for bytes: printable ones stand for themselves, the
    others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the words seen so far.

    Neither tokenizer merges across a single space between two characters that are not white space,
    so a text's tokens are those of its words, each with the space before it, in a row; and as
    tokens of both end with a word, so are its groups. Words are encoded once and remembered.
    """

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values(), default=0))
        for piece, number in vocabulary.items():
            known = all(c in letters for c in piece)
            self.a_bytes[number] = bytes(letters[c] for c in piece) if known else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        # A merge of B never crosses a space if pieces have it at their start only; else texts stay whole.
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_width = np.array([len(x) for x in self.a_bytes])
        self.b_width = np.array([len(x) for x in self.b_bytes])
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.same, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.pools = {name: common.Pool() for name in ("a", "b", "a_sizes", "b_sizes")}

    def _forget(self) -> None:
        """Keep the short words that the last texts used more than once."""
        words = [w for w, uses in zip(self.known, self.uses.tolist(), strict=True) if uses > 1 and len(w) <= WORD][: self.remembered // 2]
        kept = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.pools = {name: pool.of(kept) for name, pool in self.pools.items()}
        self.known, self.same, self.uses = {w: k for k, w in enumerate(words)}, self.same[kept], self.uses[kept]

    def _a_ids(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all words, and how many each has: words are encoded many in a row and cut where
        their bytes end, or one by one where that fails."""
        for run in (TOGETHER, 1):
            rows = [" " + " ".join(words[k : k + run]) for k in range(0, len(words), run)]
            ids = _flat([e.ids for e in self.a.encode_batch_fast(rows, add_special_tokens=False)])
            reached, ends = np.cumsum(self.a_width[ids]), np.cumsum(size)
            cuts = np.searchsorted(reached, ends)
            if len(reached) and cuts[-1] < len(reached) and np.array_equal(reached[cuts], ends):
                return ids, np.diff(cuts, prepend=-1)
        found = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        return _flat(found), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, words: list[str]) -> None:
        for begin, end in _calls(words):
            part = words[begin:end]
            raw = [b" " + w.encode() for w in part]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            a, a_many = self._a_ids(part, size)
            found = self.b.encode(part, num_threads=1)
            b, b_many = _flat(found), np.fromiter(map(len, found), np.int64, len(found))
            # A word whose tokens' bytes are not a space and the word has none.
            same = _spells(a, a_many, self.a_bytes, raw, size) & _spells(b, b_many, self.b_bytes, raw, size)
            a, b = a[np.repeat(same, a_many)], b[np.repeat(same, b_many)]
            a_many, b_many = a_many * same, b_many * same
            # The ends that both share, in A's order, and whose word they are in.
            a_end, b_end = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
            met = np.searchsorted(b_end, a_end)
            at = np.flatnonzero(b_end[met] == a_end) if len(a) else np.zeros(0, np.int64)
            groups = np.bincount(np.searchsorted(np.cumsum(a_many), at, side="right"), minlength=len(part))
            sizes = (np.diff(at, prepend=-1), np.diff(met[at], prepend=-1) if len(a) else at)
            for pool, flat, many in zip(self.pools.values(), (a, b, *sizes), (a_many, b_many, groups, groups), strict=True):
                pool.add(flat, many)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.same = np.append(self.same, same)

    def align(self, texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For a, b, a_sizes and b_sizes: those of all texts in a row, and how many each text has."""
        cut = [(_BETWEEN.split(t) if self.cuttable else [t]) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        self._learn(list(set(flat).difference(self.known)))
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.uses = np.bincount(index, minlength=len(self.known))
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        # A text whose bytes change anywhere has no tokens at all.
        changed = np.zeros(len(texts), bool)
        changed[owner[~self.same[index]]] = True
        kept = ~changed[owner]
        index, owner = index[kept], owner[kept]
        out = {}
        for name, pool in self.pools.items():
            many = np.bincount(owner, weights=pool.size[index], minlength=len(texts)).astype(np.int64)
            out[name] = pool.take(index), many
        if len(self.known) > self.remembered:
            self._forget()
        return out


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.array([*itertools.chain.from_iterable(lists)], np.int32)


def _spells(ids: np.ndarray, many: np.ndarray, spelled: list[bytes], raw: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which words' ids spell their bytes."""
    pieces = list(map(spelled.__getitem__, ids.tolist()))
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    last = np.cumsum(many) - 1
    if (many > 0).all() and np.array_equal(ends[last], np.cumsum(size)) and b"".join(pieces) == b"".join(raw):
        return np.ones(len(raw), bool)
    cuts = [0, *(last + 1).tolist()]
    return np.array([b"".join(pieces[m:n]) == r for m, n, r in zip(cuts[:-1], cuts[1:], raw, strict=True)])


def _calls(parts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, part in enumerate(parts):
        if size and size + len(part) > CALL_BYTES:
            yield begin, k
            begin, size = k, 0
        size += len(part)
    if begin < len(parts):
        yield begin, len(parts)


def _aligner(a_path: str, b_path: str) -> Aligner:
    kept = common.per_worker("aligners")
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Aligner(a_path, b_path)
    return kept[a_path, b_path]


def runs_of(b: np.ndarray, a: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Links of a chunk to runs: for each radix its pairs (key, total) and, in the same order, their
    entries (how many, document, times)."""
    key = (b.astype(np.int64) << ID_BITS | a) << DOC_BITS | doc
    key, times = np.unique(key, return_counts=True)
    pair, doc = key >> DOC_BITS, (key & (1 << DOC_BITS) - 1).astype("<i4")
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    pairs, totals = pair[first], np.add.reduceat(times, first) if len(first) else times
    entries = np.diff(np.append(first, len(pair)))
    radix = pairs >> ID_BITS + RADIX_BITS
    cuts = np.flatnonzero(np.diff(radix, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(pairs)), strict=True):
        inner = slice(first[lo], first[hi] if hi < len(first) else None)
        yield (
            int(radix[lo]),
            pack(np.diff(pairs[lo:hi], prepend=0), totals[lo:hi].astype("<i8")),
            pack(entries[lo:hi].astype("<i4"), doc[inner], times[inner].astype("<i4")),
        )


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if texts and (size + len(text) > CHUNK_BYTES or len(texts) >= rows):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def _lists(flat: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(many)).astype(np.int32), flat)


def _encode(a_path: str, b_path: str, chunk_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for ids, texts in _chunks(batches, chunk_rows):
            found, n = aligner.align(texts), len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * n, pa.int64()),
                    pa.array(range(n), pa.int32()),
                    pa.array(ids, pa.int64()),
                    *[_lists(*found[name]) for name in ("a", "b", "a_sizes", "b_sizes")],
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                    pa.nulls(n, pa.binary()),
                ],
                names=_NAMES,
            )
            # The last tokens of each group are linked.
            a, b = (found[k][0][np.cumsum(found[k + "_sizes"][0]) - 1] for k in ("a", "b"))
            runs = list(runs_of(b, a, np.repeat(np.arange(n), found["a_sizes"][1])))
            m, none = len(runs), pa.nulls(len(runs), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * m, pa.int64()),
                    pa.nulls(m, pa.int32()),
                    pa.nulls(m, pa.int64()),
                    *[none] * 4,
                    pa.array([r[0] for r in runs], pa.int32()),
                    pa.array([r[1] for r in runs], pa.binary()),
                    pa.array([r[2] for r in runs], pa.binary()),
                ],
                names=_NAMES,
            )
            chunk += 1

    return run


_NAMES = "chunk nth doc_id a b a_sizes b_sizes radix pairs entries".split()


def _decoded(blob: bytes) -> Iterator[tuple[int, int]]:
    steps, totals = unpack(blob)
    keys = np.cumsum(steps)
    for k in range(0, len(keys), BLOCK):
        yield from zip(keys[k : k + BLOCK].tolist(), totals[k : k + BLOCK].tolist(), strict=True)


def merged(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of all runs, ascending, each with its sum."""
    last, total = None, 0
    for key, times in heapq.merge(*map(_decoded, blobs)):
        if key != last:
            if last is not None:
                yield last, total
            last, total = key, 0
        total += times
    if last is not None:
        yield last, total


def _columns(pairs: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter((x for pair in pairs for x in pair), np.int64)
    return flat[::2], flat[1::2]


def _merge(key: tuple, runs: pa.Table) -> pa.Table:
    """One run of the runs given."""
    keys, totals = _columns(merged(runs.column("pairs").to_pylist()))
    rows = ([key[0].as_py()], [key[1].as_py()], [pack(np.diff(keys, prepend=0), totals)])
    return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["radix", "run", "pairs"])


def _count(key: tuple, runs: pa.Table) -> pa.Table:
    """The last merge: all pairs of a radix, their counts, and whether a B id has no higher one."""
    keys, totals = _columns(merged(runs.column("pairs").to_pylist()))
    first = np.flatnonzero(np.diff(keys >> ID_BITS, prepend=-1))
    most = np.maximum.reduceat(totals, first) if len(first) else totals
    best = totals == np.repeat(most, np.diff(np.append(first, len(keys))))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(keys, totals, best.astype("i1"))], pa.binary())], ["radix", "counts"])


def _shares(key: tuple, runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What a radix's links add to the documents of each chunk."""
    chunks, out = runs.column("chunk").to_pylist(), []
    keys, totals, best = unpack(counts.column("counts")[0].as_py()) if len(chunks) else (None,) * 3
    for pairs, entries in zip(runs.column("pairs"), runs.column("entries"), strict=True):
        at = np.searchsorted(keys, np.cumsum(unpack(pairs.as_py())[0]))
        many, doc, times = unpack(entries.as_py())
        at = np.repeat(at, many)
        sums = np.zeros((2, int(doc.max(initial=-1)) + 1), np.int64)
        np.add.at(sums[0], doc, times * best[at])
        np.add.at(sums[1], doc, times * totals[at])
        out.append(pack(sums[0], sums[1]))
    return pa.table([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], ["chunk", "share"])


def _sum_shares(key: tuple, shares: pa.Table) -> pa.Table:
    sums = np.zeros((2, 0), np.int64)
    for blob in shares.column("share"):
        found = np.stack(unpack(blob.as_py()))
        if found.shape[1] > sums.shape[1]:
            found, sums = sums, found.copy()
        sums[:, : found.shape[1]] += found
    n = sums.shape[1]
    columns = [pa.array([key[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(sums[0]), pa.array(sums[1])]
    return pa.table(columns, ["chunk", "nth", "n_best", "count_sum"])


class Alignment:
    """Both tokenizations of ``docs``, in the shared folder.

    documents  chunk, nth, doc_id, a, b (ids), a_sizes, b_sizes (tokens of each group)
    runs       radix, chunk, pairs, entries
    """

    def __init__(
        self, docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", fan: int = FAN,
        run_bytes: int = RUN_BYTES, chunk_rows: int = CHUNK_ROWS,
    ):
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        found = common.written(rows.mapInArrow(_encode(a_path, b_path, chunk_rows), WRITTEN), "aligned")
        self.documents = found.where("nth IS NOT NULL").drop("radix", "pairs", "entries")
        self.runs = found.where("nth IS NULL").select("radix", "chunk", "pairs", "entries")
        self.fan, self.run_bytes, self._counts = fan, run_bytes, None

    def _parts(self, runs: DataFrame, *blobs: str) -> tuple[DataFrame, int]:
        """radix, parts: in how many parts a task's share of runs each radix is cut; and the most of them.
        There are as many rows as radixes, which the vocabulary bounds."""
        size = sum((F.octet_length(b) for b in blobs[1:]), F.octet_length(blobs[0]))
        sizes = runs.groupBy("radix").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        enough = F.ceil(F.greatest(F.col("n") / self.fan, F.col("bytes") / self.run_bytes))
        parts = common.written(sizes.select("radix", enough.cast("long").alias("parts"), "n"), "parts")
        return parts, parts.agg(F.max(F.when(F.col("n") > 1, F.col("parts")).otherwise(1))).first()[0] or 1

    def counts(self) -> DataFrame:
        """radix, counts: the packed pairs of each radix, their counts and best flags."""
        if self._counts is None:
            runs = self.runs.select("radix", F.xxhash64("chunk").alias("run"), "pairs")
            parts, most = self._parts(runs, "pairs")
            while most > 1:
                dealt = runs.join(F.broadcast(parts), "radix").withColumn("run", F.pmod("run", F.greatest(F.lit(1), F.least("parts", F.ceil(F.col("n") / 2)))))
                runs = common.written(dealt.groupBy("radix", "run").applyInArrow(_merge, RUN), "merged")
                before = most
                parts, most = self._parts(runs, "pairs")
                if most >= before and runs.groupBy("radix").count().where(F.col("count") > self.fan).isEmpty():
                    break
            self._counts = common.written(runs.groupBy("radix").applyInArrow(_count, COUNTS), "counts")
        return self._counts

    def pairs(self) -> DataFrame:
        """a, b, count, best: every linked pair of ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    keys, totals, best = unpack(blob.as_py())
                    for k in range(0, len(keys), 1 << 16):
                        part = keys[k : k + (1 << 16)]
                        columns = [part & (1 << ID_BITS) - 1, part >> ID_BITS, totals[k : k + (1 << 16)], best[k : k + (1 << 16)] > 0]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "count", "best"])

        return self.counts().select("counts").mapInArrow(run, "a long, b long, count long, best boolean")

    def scores(self) -> DataFrame:
        """chunk, nth, n_best, count_sum of the documents with links."""
        parts, _ = self._parts(self.runs, "pairs", "entries")
        part = F.pmod(F.xxhash64("chunk"), F.col("parts")).alias("part")
        runs = self.runs.join(F.broadcast(parts), "radix").select("radix", part, "chunk", "pairs", "entries")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        counts = self.counts().join(F.broadcast(parts), "radix").select("radix", each, "counts")
        met = runs.groupBy("radix", "part").cogroup(counts.groupBy("radix", "part")).applyInArrow(_shares, SHARE)
        return common.written(met, "shares").groupBy("chunk").applyInArrow(_sum_shares, SCORES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``a1,a2|b1;a3|b2,b3`` as sha256."""
    spelled: list[str] = []
    for batch in batches:
        lists, out = [batch.column(k) for k in range(3, 7)], []
        for x, y, x_sizes, y_sizes in zip(*lists, strict=True):
            x, y, x_sizes, y_sizes = (v.values.to_numpy() for v in (x, y, x_sizes, y_sizes))
            if not len(x):
                out.append("")
                continue
            for k in range(len(spelled) // 3, 1 + int(max(x.max(), y.max()))):
                spelled += [f"{k},", f"{k}|", f"{k};"]
            # Tokens of A go before those of B in each group; a mark follows each.
            x_at = np.arange(len(x)) + np.repeat(np.cumsum(y_sizes) - y_sizes, x_sizes)
            y_at = np.arange(len(y)) + np.repeat(np.cumsum(x_sizes), y_sizes)
            marked = np.empty(len(x) + len(y), np.int64)
            marked[x_at], marked[y_at] = 3 * x, 3 * y
            marked[x_at[np.cumsum(x_sizes) - 1]] += 1
            marked[y_at[np.cumsum(y_sizes) - 1]] += 2
            said = "".join(map(spelled.__getitem__, marked.tolist()))
            out.append(hashlib.sha256(said[:-1].encode()).hexdigest())
        sizes = [pc.cast(pc.list_value_length(lists[k]), pa.int64()) for k in (0, 1, 2)]
        columns = [*(batch.column(k) for k in range(3)), *sizes, pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "nth", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])


def digests(documents: DataFrame) -> DataFrame:
    """chunk, nth, doc_id, n_a, n_b, n_groups, groups_sha256 of an alignment's documents."""
    schema = "chunk long, nth int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    return documents.select("chunk", "nth", "doc_id", "a", "b", "a_sizes", "b_sizes").mapInArrow(_digest, schema)
