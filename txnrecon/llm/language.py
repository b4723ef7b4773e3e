"""Language identification by interpolated Kneser-Ney character language models.

One model per language over the characters of words (a word is read on its own, from a start
mark to an end mark). All models share one sorted array of n-gram hashes per order; beside each
hash stand, per language, the discounted probability of the n-gram's last character and the
weight with which it hands over, as a context, to the next lower order. The language of a text is
the one with the lowest cross-entropy per character; a cross-entropy above what calibration texts
of that language showed is marked as rejected.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.llm import common

ORDER = 4
#: Labelled texts a language's model is fitted on, and the most characters of such a text.
SAMPLE, SAMPLE_CHARS = 300, 20_000
#: Every so many of them calibrate confidence and rejection instead.
CALIBRATE = 5
REJECT_QUANTILE = 0.995
#: Words whose scores a Python worker remembers.
REMEMBERED = 600_000
UNKNOWN = "und"

_START, _END = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _positions(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every character of every word and its end mark: the number of its word, and the
    hashes of the n-grams of 1..order characters that end there."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    pad = order - 1
    flat = np.full(int(sizes.sum()) + len(words) * (pad + 1), _START, dtype=np.uint64)
    ends = np.cumsum(sizes + pad + 1)
    flat[ends - 1] = _END
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = np.ones(len(flat), dtype=bool)
    inside[ends - 1] = False
    heads = np.concatenate(([0], ends[:-1])).astype(np.int64)
    for k in range(pad):
        inside[heads + k] = False
    flat[inside] = text.astype(np.uint64) + np.uint64(3)
    real = inside
    real[ends - 1] = True
    at = np.flatnonzero(real)
    word = np.repeat(np.arange(len(words)), sizes + 1)
    hashes, h = [], np.zeros(len(at), dtype=np.uint64)
    for k in range(order):
        # An n-gram's hash adds a mixed term per character and distance from its end.
        term = (flat[at - k] + np.uint64(1)) * (_MIX + np.uint64(2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        term ^= term >> np.uint64(31)
        term *= np.uint64(0xD6E8FEB86659FD93)
        h = h + (term ^ (term >> np.uint64(29)))
        hashes.append(h)
    return word, hashes


def _contexts(words: list[str], order: int) -> list[np.ndarray]:
    """Hashes of the contexts (1..order-1 characters) before each character or end mark; the
    hash that the same characters have as an n-gram."""
    pad = order - 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word, hashes = _positions(words, order)
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    _, blank = _positions([""], order)  # the hashes of start marks alone
    out = []
    for n in range(1, order):
        moved = np.concatenate((hashes[n - 1][:1], hashes[n - 1][:-1]))
        moved[firsts] = _start_hash(n)
        out.append(moved)
    return out


def _start_hash(n: int) -> np.uint64:
    """Hash of n start marks."""
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for k in range(n):
            term = np.uint64(_START + 1) * (_MIX + np.uint64(2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            term ^= term >> np.uint64(31)
            term *= np.uint64(0xD6E8FEB86659FD93)
            h = h + (term ^ (term >> np.uint64(29)))
    return h


def words_of(text: str) -> list[str]:
    return text.lower().split()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Models:
    """Kneser-Ney models of several languages, fitted on word counts per language."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        self.key = uuid.uuid4().hex  # travels with the models: no others have it
        fitted = [self._fit(counts[lang]) for lang in self.langs]
        self.tables = []
        for n in range(order):
            keys = np.unique(np.concatenate([t[n][0] for t in fitted]))
            values = np.zeros((len(keys), 2 * len(fitted)), dtype=np.float64)
            values[:, 1::2] = 1.0  # a context never seen hands everything over
            for k, t in enumerate(fitted):
                found, prob, over = t[n]
                at = np.searchsorted(keys, found)
                values[at, 2 * k], values[at, 2 * k + 1] = prob, over
            self.tables.append((keys, values))
        self.start_over = np.array([t[order][0] for t in fitted])  # by language and context length
        self.first_over = np.array([t[order][1] for t in fitted])
        alphabet = len(self.tables[0][0]) + 1
        self.floor = 1.0 / alphabet
        self.slope, self.limits = 1.0, np.full(len(self.langs), np.inf)

    def _fit(self, words: Counter) -> list:
        """Per order: (hashes, probability of the last character, weight handed over as a
        context); then what start marks, and the empty context, hand over."""
        listed, weight = list(words), np.fromiter(words.values(), dtype=np.float64)
        word, hashes = _positions(listed, self.order)
        contexts = _contexts(listed, self.order)
        count = weight[word]
        grams, parents = [], []
        for n in range(self.order, 0, -1):
            keys, first, inverse = np.unique(hashes[n - 1], return_index=True, return_inverse=True)
            if n == self.order:
                c = np.bincount(inverse, weights=count)
            else:  # how many different characters come before
                left = np.unique(np.stack([hashes[n], hashes[n - 1]], axis=1), axis=0)[:, 1]
                c = np.bincount(np.searchsorted(keys, left), minlength=len(keys)).astype(np.float64)
            grams.append((keys, c, first))
            parents.append(contexts[n - 2][first] if n > 1 else np.zeros(len(keys), dtype=np.uint64))
        out, handed = [None] * self.order, {}
        for (keys, c, _), parent, n in zip(grams, parents, range(self.order, 0, -1), strict=True):
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            heads, inverse = np.unique(parent, return_inverse=True)
            total = np.bincount(inverse, weights=c)
            kinds = np.bincount(inverse)
            out[n - 1] = [keys, (c - d) / total[inverse], np.ones(len(keys))]
            handed[n] = (heads, d * kinds / total)
        starts = np.ones(self.order)
        for n in range(2, self.order + 1):
            heads, over = handed[n]
            lower = out[n - 2]
            at = np.minimum(np.searchsorted(lower[0], heads), len(lower[0]) - 1)
            hit = lower[0][at] == heads
            lower[2][at[hit]] = over[hit]
            mark = np.flatnonzero(heads == _start_hash(n - 1))
            if len(mark):
                starts[n - 1] = over[mark[0]]
        return [*out, (starts, float(handed[1][1][0]) if len(handed[1][1]) else 1.0)]

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (with its end mark) in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        word, hashes = _positions(words, self.order)
        fresh = np.concatenate(([True], word[1:] != word[:-1]))
        n_langs = len(self.langs)
        rows = []
        for n in range(self.order):
            keys, values = self.tables[n]
            at = np.minimum(np.searchsorted(keys, hashes[n]), len(keys) - 1)
            row = values[at]
            missed = keys[at] != hashes[n]
            row[missed, 0::2], row[missed, 1::2] = 0.0, 1.0
            rows.append(row)
        p = rows[0][:, 0::2] + self.first_over * self.floor
        for n in range(1, self.order):
            over = np.empty((len(word), n_langs))
            over[1:] = rows[n - 1][:-1, 1::2]
            over[fresh] = self.start_over[:, n]
            p = rows[n][:, 0::2] + over * p
        logs = np.log(p)
        return np.add.reduceat(logs, np.flatnonzero(fresh), axis=0)

    def entropies(self, texts: list[str], known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and the characters."""
        known = {} if known is None else known
        index = known.setdefault("index", {})
        if len(index) > REMEMBERED:
            known.clear()
            index = known.setdefault("index", {})
        parted = [words_of(t) for t in texts]
        new = list(set().union(*parted).difference(index)) if parted else []
        logs = known.setdefault("logs", np.zeros((1 << 12, len(self.langs) + 1)))
        at = len(index)
        if at + len(new) > len(logs):
            grown = np.zeros((max(2 * len(logs), at + len(new)), logs.shape[1]))
            grown[:at] = logs[:at]
            logs = known["logs"] = grown
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            logs[at + k : at + k + len(part), :-1] = self.log_probs(part)
            logs[at + k : at + k + len(part), -1] = [len(w) + 1 for w in part]
        index.update(zip(new, range(at, at + len(new)), strict=True))
        sums = np.zeros((len(texts), logs.shape[1]))
        for i, words in enumerate(parted):
            if words:
                sums[i] = logs[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n

    def confidence(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Posterior of each language, tempered by the calibrated slope."""
        x = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * self.slope
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str], quantile: float = REJECT_QUANTILE) -> None:
        if not texts:
            return
        entropy, n = self.entropies(texts)
        right = np.array([self.langs.index(lang) for lang in langs])
        rows = np.arange(len(right))
        best = None
        for slope in np.geomspace(0.05, 20, 40):
            self.slope = float(slope)
            loss = -np.log(np.maximum(self.confidence(entropy, n)[rows, right], 1e-9)).mean()
            if best is None or loss < best[0]:
                best = (loss, self.slope)
        self.slope = best[1]
        for k in range(len(self.langs)):
            own = entropy[right == k, k]
            if len(own):
                self.limits[k] = np.quantile(own, quantile) * 1.05


def sample(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_lang: int, chars: int) -> DataFrame:
    """lang, nth, text: at most ``per_lang`` texts of each language, drawn by a hash, rows that repeat
    one another once; of a text of more than ``chars`` characters, four stretches spread over it."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(doc_id, common.text_key(text)).alias("turn"), F.col(text).alias("text")
    )
    # Picked by hash alone; texts are met afterwards, by the few that were picked.
    by = Window.partitionBy("lang").orderBy("turn")
    picked = known.select("lang", "turn").distinct().withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_lang)
    picked = common.narrow(common.written(picked, "picked"))
    part = chars // 4
    step = F.floor((F.length("text") - part) / 3).cast("int")
    pieces = [F.substring(F.col("text"), F.lit(1) + k * step, F.lit(part)) for k in range(4)]
    some = F.when(F.length("text") > chars, F.concat_ws(" ", *pieces)).otherwise(F.col("text"))
    met = known.join(picked, ["lang", "turn"]).select("lang", "nth", some.alias("text"))
    return met.groupBy("lang", "nth").agg(F.min("text").alias("text"))


def fit(
    docs: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    per_lang: int = SAMPLE,
    chars: int = SAMPLE_CHARS,
) -> Models | None:
    """Fit on the rows that ``learn`` selects; None if none has a language. At most ``per_lang``
    texts of about ``chars`` characters per language come to the driver."""
    rows = sample(docs, learn, doc_id, text, lang, per_lang, chars).orderBy("lang", "nth").collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        if r["nth"] % CALIBRATE or r["nth"] < CALIBRATE:
            counts.setdefault(r["lang"], Counter()).update(words_of(r["text"]))
    counts = {k: c or Counter({"": 1}) for k, c in counts.items()}
    if not counts:
        return None
    models = Models(counts, order)
    held = [r for r in rows if not (r["nth"] % CALIBRATE or r["nth"] < CALIBRATE) and has_letter(r["text"])]
    models.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    return models


def _remembered(models: Models | None) -> dict:
    """What this Python worker knows of words from these models; what it knew from others goes."""
    kept, key = common.per_worker("languages"), models.key if models else None
    if key not in kept:
        kept.clear()
    return kept.setdefault(key, {})


def identify(docs: DataFrame, models: Models | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred, score (confidence, 0 to 1), entropy, rejected.

    A null text, or one without a letter, or any text where no language was learned, is ``und``
    with score 0, and rejected. Equal cross-entropies go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = shared.value
        known = _remembered(ours)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lettered = [ours is not None and has_letter(t) for t in texts]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
            rows = np.flatnonzero(lettered)
            if len(rows):
                h, n = ours.entropies([texts[i] for i in rows], known)
                best = h.argmin(axis=1)
                entropy[rows] = h.min(axis=1)
                score[rows] = ours.confidence(h, n).max(axis=1)
                rejected[rows] = entropy[rows] > ours.limits[best]
                for i, k in zip(rows.tolist(), best.tolist(), strict=True):
                    pred[i] = ours.langs[k]
            made = [pa.array(pred), pa.array(score), pa.array(entropy), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score", "entropy", "rejected"]
            )

    rows = docs.select(*keep, F.col(text).alias("_text"))
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{types}, lang_pred string, score double, entropy double, rejected boolean")
