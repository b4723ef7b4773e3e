"""Exact deduplication by Grace hashing.

Rows are first deduplicated where they are read: every task keeps the distinct texts it meets in
an open-addressing table and turns each into one *record* (text, rows, largest id), so a text
copied into a third of all rows arrives as one record a task. Records are then partitioned by a
hash of their text into buckets, written, and each bucket is run through one such table. A bucket
whose distinct texts outgrow the table spills the rest, which is partitioned again by another
hash, until nothing is left. Tables compare complete texts; hashes only choose slots and buckets.

Defined results: a null text counts as empty; of rows that repeat id and text one stays; a null
id stays only where a text has no other; further columns of any name are ignored; no rows give
no rows. Memory follows the limits below, whatever the number of copies; one text larger than a
limit is held alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

#: Bytes of distinct text a table holds while rows are read, and while a bucket is resolved.
READ_BYTES, TABLE_BYTES = 32 << 20, 96 << 20
#: Bytes of text a bucket is cut for.
BUCKET_BYTES = 32 << 20
#: Records of one hash beyond which they are first merged in salted parts, and those parts.
HEAVY, SALTS = 256, 64
#: Bytes of text handed back to Spark at once.
OUT_BYTES = 4 << 20

READ = "member boolean, local long, nth long, doc_id long, size long, h long, sha string, text binary"
RESOLVED = "local long, class long, nth long, doc_id long, size long, h long, sha string, text binary"


class Table:
    """Distinct texts under linear probing; a full comparison decides whether two are equal."""

    def __init__(self):
        self.mask, self.slots = 1023, [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> int:
        """The number of an equal text, or -1."""
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return k
            at = at + 1 & self.mask
        return -1

    def add(self, h: int, text: bytes) -> int:
        """The number of a text that is not held yet."""
        k = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text)
        if 2 * len(self.texts) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for n, held in enumerate(self.hashes):
                self._put(held, n)
        else:
            self._put(h, k)
        return k

    def _put(self, h: int, k: int) -> None:
        at = h & self.mask
        while self.slots[at] >= 0:
            at = at + 1 & self.mask
        self.slots[at] = k


class _Out:
    """Rows gathered into record batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> bool:
        self.rows.append(row)
        self.bytes += 64 + len(row[-1] or b"")
        return self.bytes > OUT_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _reader(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to one member row each, and records of the distinct texts met."""
    schema = common.arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table, held = _Out(schema), Table(), []
        first = TaskContext.get().partitionId() << 36

        def records() -> Iterator[pa.RecordBatch]:
            for k, (size, best, nth, sha) in enumerate(held):
                if out.add((False, first + k, nth, best, size, table.hashes[k], sha, table.texts[k])):
                    yield out.take()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                digest = hashlib.sha256(text)
                h = int.from_bytes(digest.digest()[:8], "little", signed=True)
                k = table.find(h, text)
                if k < 0:
                    k = table.add(h, text)
                    held.append([0, None, 0, digest.hexdigest()])
                mine = held[k]
                if doc_id is not None and (mine[1] is None or doc_id > mine[1]):
                    mine[1], mine[2] = doc_id, mine[0]
                if out.add((True, first + k, mine[0], doc_id, None, None, None, None)):
                    yield out.take()
                mine[0] += 1
                if table.bytes > limit:
                    yield from records()
                    first, table, held = first + len(held), Table(), []
        yield from records()
        yield out.take()

    return run


def _resolver(limit: int, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of a bucket with the class of their text: the first record that has it. Records for
    which the table has no room come out without a class, with their text; so do, where asked for,
    the first of each class with theirs."""
    schema = common.arrow_schema(RESOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table, first = _Out(schema), Table(), []
        for batch in batches:
            rest = zip(*(batch.column(n).to_pylist() for n in range(6)), batch.column(6), strict=True)
            for local, nth, doc_id, size, h, sha, text in rest:
                text = text.as_py()
                k, whole = table.find(h, text), None
                if k >= 0:
                    found = first[k]
                elif not table.texts or table.bytes + len(text) <= limit:
                    table.add(h, text)
                    first.append(local)
                    found, whole = local, text if keep_text else None
                else:
                    found, whole = None, text
                if out.add((local, found, nth, doc_id, size, h, sha, whole)):
                    yield out.take()
        yield out.take()

    return run


_RECORD = ["local", "nth", "doc_id", "size", "h", "sha", "text"]


def _round(records: DataFrame, keys: list, table_bytes: int, bucket_bytes: int, keep_text: bool = False) -> DataFrame:
    """One partitioning of records into buckets, resolved and written."""
    total = records.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    dealt = records.select(*_RECORD).repartition(buckets, F.xxhash64(*keys))
    return common.written(dealt.mapInArrow(_resolver(table_bytes, keep_text), RESOLVED), "bucket")


def _classes(records: DataFrame, table_bytes: int, bucket_bytes: int) -> DataFrame:
    """Every record with a class, in as many rounds as tables overflow."""
    done, level = None, 0
    while True:
        found = _round(records, [F.col("h"), F.lit(level)], table_bytes, bucket_bytes)
        fit = found.where("class IS NOT NULL").drop("text", "h")
        done = fit if done is None else done.unionAll(fit)
        records = found.where("class IS NULL")
        if records.isEmpty():
            return done
        level += 1


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    read_bytes: int = READ_BYTES,
    table_bytes: int = TABLE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    heavy: int = HEAVY,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``. ``kept`` marks
    the row of a text that stays, the one with the largest id."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    read = common.written(rows.mapInArrow(_reader(read_bytes), READ), "read")
    members, records = read.where("member").select("local", "nth", "doc_id"), read.where("NOT member")
    crowded = common.written(records.groupBy("h").count().where(F.col("count") > heavy).select("h"), "heavy")
    if crowded.isEmpty():
        classed = _classes(records, table_bytes, bucket_bytes)
    else:
        # A text that many tasks met is first merged in salted parts, of which the first record of
        # each goes on.
        crowded = common.narrow(crowded)
        salt = F.pmod(F.xxhash64("local"), F.lit(SALTS))
        merged = _round(records.join(crowded, "h", "left_semi"), [F.col("h"), salt], table_bytes, bucket_bytes, True)
        going = merged.where("text IS NOT NULL").select(*_RECORD)
        rest = records.join(crowded, "h", "left_anti").select(*_RECORD)
        classed = common.written(_classes(rest.unionAll(going), table_bytes, bucket_bytes), "classes")
        after = classed.select(F.col("local").alias("class"), F.col("class").alias("last"))
        past = merged.where("class IS NOT NULL AND class != local").drop("text", "h").join(after, "class")
        classed = classed.unionByName(past.drop("class").withColumnRenamed("last", "class"))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("local")).alias("by")))
    classes = classed.groupBy("class").agg(F.sum("size").alias("group_size"), best.alias("best"))
    known = classed.select("local", "class", "sha", F.col("nth").alias("chief")).join(classes, "class")
    mine = (F.col("nth") == F.col("chief")) & (F.col("local") == -F.col("best.by"))
    return members.join(known, "local").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        mine.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they are."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    key = F.struct(F.col(doc_id).cast("long").alias("id"), sha.alias("sha"))
    kept = dedup(docs, doc_id, text).where("kept").select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("key"))
    packed = docs.select(key.alias("key"), F.struct("*").alias("row"))
    met = packed.join(kept, packed["key"].eqNullSafe(kept["key"]), "left_semi")
    return met.groupBy("key").agg(F.first("row").alias("row")).select("row.*")
