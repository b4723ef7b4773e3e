"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character. Dynamic
programming carries the best score and the number of pieces of the best segmentation so far, by
the tokenizer's own rules: candidates that end at a character are tried from the longest, one
must be strictly better to replace another, a character that no piece covers alone may stand as
unknown at the lowest score less ten, and a run of unknown characters becomes its bytes.

Text is split before every space, as a word marker; words are counted once and remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a Python worker remembers.
REMEMBERED = 1_000_000


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file in order, scored by rank: minus the logarithm of rank + 1.

    The public files hold merge vocabularies, whose order is one of frequency; a unigram
    tokenizer needs log probabilities, and by Zipf's law those fall with the logarithm of rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), -math.log(k + 1)) for k in range(model.get_piece_size())]


class Pieces:
    """Counts pieces of words; the vocabulary has an unknown piece and one for each byte."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.names = {piece for piece, _ in vocabulary}
        self.longest = max(map(len, self.names))
        self.lowest = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, k == unknown))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def _closed(self, word: str, begin: int, end: int) -> int:
        """Pieces of a run of unknown characters: its bytes."""
        run = word[begin:end]
        return 1 if end - begin <= self.longest and run in self.names else len(run.encode("utf-8", "surrogatepass"))

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)  # pieces: without an unknown run that is still open
        open_from = [-1] * (n + 1)
        found = self.automaton.iter(word)
        at, match = next(found, (n, None))
        for end in range(1, n + 1):
            best, start, unknown, single = None, 0, False, False
            while at == end - 1 and match is not None:
                length, worth, is_unknown = match
                value = worth + score[end - length]
                if best is None or value > best:
                    best, start, unknown = value, end - length, is_unknown
                single = single or length == 1
                at, match = next(found, (n, None))
            if not single:
                value = self.lowest + score[end - 1]
                if best is None or value > best:
                    best, start, unknown = value, end - 1, True
            score[end] = best
            begun = open_from[start]
            if unknown:
                open_from[end] = start if begun < 0 else begun
                pieces[end] = pieces[start]
            else:
                pieces[end] = pieces[start] + 1 + (self._closed(word, begun, start) if begun >= 0 else 0)
        return pieces[n] + (self._closed(word, open_from[n], n) if open_from[n] >= 0 else 0)

    def words(self, text: str) -> list[str]:
        """The text's words, without their leading markers."""
        marked = text.replace(" ", MARK)
        return (marked[1:] if marked.startswith(MARK) else marked).split(MARK) if text else []

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Words and pieces of each text."""
        parted = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for word in set().union(*parted).difference(known):
            known[word] = self.count(MARK + word)
        return [(len(words), sum(map(known.__getitem__, words))) for words in parted]


def _pieces(path: str) -> Pieces:
    kept = common.per_worker("pieces")
    if path not in kept:
        kept[path] = Pieces(zipf_vocabulary(path))
    return kept[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs``, over whole texts. A null or empty text has
    none of either; rows that repeat one another are counted each; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                found = pieces.counts([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))],
                    ["doc_id", "n_words", "n_tokens"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
