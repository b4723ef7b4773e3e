"""Token ids as Parquet lists: written in ascending document order, read back by column or range.

A store is a folder of Parquet files. Every file holds a run of documents by ascending id, the
files are in ascending order too, and a row has

    shard INT        the file's number
    doc_id BIGINT
    position BIGINT  ids of the documents before it in the same file
    n_tokens BIGINT  with the end id
    ids ARRAY<INT>   the ids themselves

The ids are dictionary-encoded (a vocabulary is a small dictionary), the counters are
delta-encoded, row groups and pages are bounded, and Parquet's page indexes let a reader skip
the pages of other documents. Reading counters never touches the ids.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.llm import common

SCHEMA = "shard int, doc_id long, position long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 128 << 10
#: Words whose ids a Python worker remembers, and their letters at most.
REMEMBERED, WORD = 700_000, 64
#: Words encoded in one piece, and bytes of text worked on at once.
RUN, SLICE = 512, 8 << 20
#: Words encoded in one call.
PIECE = 32_768
#: Marks that never join the letters before them (an apostrophe may).
MARKS = ".,!?;:#$%&*+-/=@^_`~()[]{}<>|\"\\"
#: Two words parted by a line's end and nothing else.
LINE = r"^[^\s]*[\p{L}\p{N}.,!?;:]\n[\p{L}\p{N}][^\s]*$"

#: A space that simply parts two words.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, word by word.

    Such a tokenizer starts a new piece at a space between two characters that are not white
    space, so a text's ids are those of its words (each with its leading space) in a row.
    Words are encoded once, many in a row, and remembered.
    """

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.remembered = end_id, remembered
        # Words and, in the same order, their ids and how often they were used of late.
        self.words, self.pool, self.uses = pa.array([], pa.string()), common.Pool(), np.zeros(0, np.int64)
        # Bytes that an id stands for: a byte-level vocabulary writes each as one character.
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for piece, number in vocabulary.items():
            self.width[number] = len(piece)
        self.marks = MARKS
        for number, added in self.tokenizer.get_added_tokens_decoder().items():
            self.width[number] = len(added.content.encode())
            # Nothing is cut within an added token.
            self.marks = "".join(m for m in self.marks if m not in added.content)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([*itertools.chain.from_iterable(found)], dtype=np.int32), np.array([*map(len, found)], dtype=np.int64)

    def _joined(self, words: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space or a line's end, and how many each has. Words are encoded
        many in one piece, which is cut where the bytes of a word end; where that fails, one by one."""
        spelled, ends = words.to_pylist(), np.cumsum(_bytes(words) + 1)
        ids, many = self._ids([between + between.join(spelled[k : k + RUN]) for k in range(0, len(spelled), RUN)])
        reached = np.cumsum(self.width[ids])
        cuts = np.searchsorted(reached, ends)
        if len(reached) and cuts[-1] == len(reached) - 1 and np.array_equal(reached[cuts], ends):
            return ids, np.diff(cuts, prepend=-1)
        return self._ids([between + w for w in spelled])

    def _at(self, words: pa.Array) -> np.ndarray:
        """Where words are remembered, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, many: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.pool.add(ids, many)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember new words; where they are. A line's end between two words is a piece of its own, so
        such a word has the ids of its first half and those of the line's end with the second half."""
        lines = pc.match_substring_regex(new, LINE)
        places = lines.to_numpy(zero_copy_only=False)
        if not places.any():
            return self._units(new)
        halves = pc.split_pattern(new.filter(lines), "\n").flatten()
        before, after = halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2)))
        after = pc.binary_join_element_wise("", after, "\n")
        coded = pa.concat_arrays([new.filter(pc.invert(lines)), before, after]).dictionary_encode()
        at = self._units(coded.dictionary)[coded.indices.to_numpy()]
        plain = len(new) - len(before)
        both = at[plain:].reshape(2, -1).T
        found = np.empty(len(new), dtype=np.int64)
        found[~places], found[places] = at[:plain], len(self.words) + np.arange(len(before))
        self._add(new.filter(lines), self.pool.take(both.ravel()), self.pool.size[both].sum(axis=1))
        return found

    def _units(self, new: pa.Array) -> np.ndarray:
        """Remember new words, those that begin with a line's end included. Closing marks after a letter
        are a piece of their own, so a word with them has the ids of the bare word and those of the marks."""
        bare = pc.utf8_rtrim(new, characters=self.marks) if self.marks else new
        ends_in_letter = pc.utf8_is_alpha(pc.utf8_slice_codeunits(bare, -1))
        marked = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(new)), ends_in_letter)
        coded = pc.if_else(marked, bare, new).dictionary_encode()
        at = self._at(coded.dictionary)
        begins = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        for between, kind in ((" ", ~begins), ("\n", begins)):
            fresh = kind & (at < 0)
            names = coded.dictionary.filter(pa.array(fresh))
            at[fresh] = len(self.words) + np.arange(len(names))
            for k in range(0, len(names), PIECE):
                some = names.slice(k, PIECE)
                self._add(some, *self._joined(some if between == " " else pc.utf8_slice_codeunits(some, 1), between))
        at = at[coded.indices.to_numpy()]
        words, places = new.filter(marked), marked.to_numpy(zero_copy_only=False)
        if len(words):
            tails = [w[len(b) :] for w, b in zip(words.to_pylist(), bare.filter(marked).to_pylist(), strict=True)]
            kinds = {t: len(self.words) + k for k, t in enumerate(dict.fromkeys(tails))}
            # Marks without a space before them are entries under a name that no word has.
            self._add(pa.array([" " + t for t in kinds], pa.string()), *self._ids([*kinds]))
            both = np.stack([at[places], np.array([kinds[t] for t in tails])], axis=1)
            at[places] = len(self.words) + np.arange(len(words))
            self._add(words, self.pool.take(both.ravel()), self.pool.size[both].sum(axis=1))
        return at

    def _forget(self) -> None:
        """Keep the short words used most often of those used more than once; old uses count half."""
        kept = np.flatnonzero((self.uses > 1) & (_bytes(self.words) <= WORD))
        most = self.remembered // 2
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(-self.uses[kept], most)[:most]])
        self.words, self.pool, self.uses = self.words.take(pa.array(kept)), self.pool.of(kept), self.uses[kept] // 2

    def _parted(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts cut at the spaces that part two words: distinct words, the number of each word
        among them in text order, and the words of each text."""
        cut = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        parts = cut.flatten()
        coded = parts.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        # White space beside a space leaves empty parts or white space at a part's end: such texts
        # are parted anew.
        odd = _bytes(pc.utf8_trim_whitespace(words)) != _bytes(words)
        odd |= _bytes(words) == 0
        if not odd.any():
            return words, index, counts
        anew = np.zeros(len(texts), dtype=bool)
        anew[np.repeat(np.arange(len(texts)), counts)[odd[index]]] = True
        as_cut = parts.filter(pa.array(np.repeat(~anew, counts)))
        lists = [_BETWEEN.split(t) for t in texts.filter(pa.array(anew)).to_pylist()]
        counts[anew] = [len(words) for words in lists]
        again = pa.array([*itertools.chain.from_iterable(lists)], parts.type)
        coded = pa.concat_arrays([as_cut, again]).dictionary_encode()
        found, at = coded.indices.to_numpy(), np.repeat(anew, counts)
        index = np.empty(len(found), dtype=np.int64)
        index[~at], index[at] = found[: len(as_cut)], found[len(as_cut) :]
        return coded.dictionary, index, counts

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and how many each has."""
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        words, index, counts = self._parted(pc.fill_null(texts, ""))
        # A text's first word has no space before it.
        first = np.cumsum(counts) - counts
        heads, many = self._ids(words.take(pa.array(index[first])).to_pylist())
        body = np.delete(index, first)
        used = np.flatnonzero(np.bincount(body, minlength=len(words)))
        asked = words.take(pa.array(used))
        at = self._at(asked)
        if (at < 0).any():
            at[at < 0] = self._learn(asked.filter(pa.array(at < 0)))
        entry = np.zeros(len(words), dtype=np.int64)
        entry[used] = at
        # For this call heads and the end are entries after all words; then all in text order.
        pool, base = common.Pool(), len(self.words)
        pool.flat = np.concatenate([self.pool.flat, heads, [self.end]]).astype(np.int32)
        head_begin = len(self.pool.flat) + np.cumsum(many) - many
        pool.begin = np.concatenate([self.pool.begin, head_begin, [len(pool.flat) - 1]])
        pool.size = np.concatenate([self.pool.size, many, [1]])
        head_at = first + np.arange(len(counts))
        last_at = head_at + counts
        order = np.full(len(index) + len(counts), -1, dtype=np.int64)
        order[head_at] = base + np.arange(len(counts))
        order[last_at] = base + len(counts)
        body = entry[body]
        order[order < 0] = body
        ends = np.cumsum(pool.size[order])
        used = np.bincount(body, minlength=base)
        used[: len(self.uses)] += self.uses
        self.uses = used
        if base > self.remembered:
            self._forget()
        return pool.take(order), np.diff(ends[last_at], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text and the end id."""
        ids, sizes = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _bytes(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy().astype(np.int64)


def _encoder(path: str, end_id: int) -> Encoder:
    kept = common.per_worker("encoders")
    if (path, end_id) not in kept:
        kept[path, end_id] = Encoder(path, end_id)
    return kept[path, end_id]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The store's rows, in partitions of ascending doc_id (null ids last, equal ids by text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, position, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer, end_id)
        for batch in batches:
            # Slices of some megabytes of text; a longer text is one of its own.
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                ids, sizes = encoder.flat(part.column(1))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), shard, dtype=np.int32)),
                        part.column(0),
                        pa.array(position + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids),
                    ],
                    ["shard", "doc_id", "position", "n_tokens", "ids"],
                )
                position += int(sizes.sum())

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, SCHEMA)


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
) -> None:
    """Encode every whole text and write the store. A null or empty text has the end id only;
    rows that repeat an id are kept, one after the other; an empty table gives an empty store."""
    (
        encoded(docs, tokenizer, end_id, doc_id, text)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#position", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group))
        .option("parquet.page.size", str(page))
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a store."""
    return spark.read.schema(SCHEMA).parquet(path)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens: where each document's ids begin among all, without reading ids."""
    return starts(read(spark, path).select("shard", "doc_id", "position", "n_tokens"))


def starts(rows: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Add ``start``: a row's position in its file and the ids of all files before, which are
    summed from ``store`` (the rows as read), so that what made ``rows`` isn't repeated."""
    files = (rows if store is None else store).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    later = files.select(F.col("shard").alias("before"), "n")
    # One row per file: pair files with earlier ones by sums over blocks of files.
    block = 1 << 10
    per_block = later.groupBy(F.floor(F.col("before") / block).alias("b")).agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    past = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select("b", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    within = Window.partitionBy("b").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    inside = later.withColumn("b", F.floor(F.col("before") / block)).select(
        "before", "b", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("offset")
    )
    bases = inside.join(per_block, "b").select(F.col("before").alias("shard"), (F.col("base") + F.col("offset")).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("position")).drop("base")


def documents_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows of the documents first..last; other files, row groups and pages are skipped."""
    return read(spark, path).where(F.col("doc_id").between(first, last))


def digests(rows: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32: the unsigned crc32 of them as little-endian 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(crc, pa.int64())],
                [*kept, "ids_crc32"],
            )

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "ids_crc32 long"]))
