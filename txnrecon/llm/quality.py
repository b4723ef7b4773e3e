"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Cyclic boosting visits one feature at a
time and fits a shallow tree on its bins to what the model still gets wrong; trees of a feature
add up to one lookup table. Pairs whose joint bins explain most of the rest get tables of their
own the same way. A score is the logistic of the sum of one entry per table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

#: Labelled rows the model is fitted on, at most.
SAMPLE = 8_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, LEAVES, SMOOTH = 0.15, 4, 4.0

FEATURES = (
    "log_bytes log_words word_length word_spread upper digit space newline mark pipe exclamation bracket other_symbol "
    "beyond_ascii distinct_words repeated_next top_word line_words distinct_lines byte_entropy mark_ended"
).split()

_CLASS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13),
    "newline": (10,),
    "mark": b".,;:?'\"-",
    "pipe": b"|",
    "exclamation": b"!",
    "bracket": b"()[]{}<>",
    "other_symbol": b"#$%&*+/=@\\^_`~",
    "beyond_ascii": range(128, 256),
}


def features_of(text: bytes | None) -> list[float]:
    """Numbers that describe a whole text; zeros for an empty or null one."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = {name: float(by_byte[list(codes)].sum()) / n for name, codes in _CLASS.items()}
    p = by_byte[by_byte > 0] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    kinds: dict[bytes, int] = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split(b"\n")
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(sizes.mean()),
        float(sizes.std()),
        *share.values(),
        len(kinds) / w,
        again / w,
        max(kinds.values(), default=0) / w,
        float(np.log1p(len(words) / len(lines))),
        len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()),
        len(re.findall(rb"[.!?](?=\s|$)", text)) / w,
    ]


class Additive:
    """Bin edges, one lookup table per feature and per chosen pair, an intercept."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.intercept = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _coarse(b: np.ndarray) -> np.ndarray:
        return b * PAIR_BINS // (BINS + 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[b[:, k]]
        c = self._coarse(b)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[c[:, i], c[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(gain: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Leaf values of a shallow regression tree over ordered bins, by best-first cuts."""
    g, m = np.concatenate(([0], np.cumsum(gain))), np.concatenate(([0], np.cumsum(mass)))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (m[b] - m[a] + SMOOTH)

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        c = np.arange(a + 1, b)
        better = worth(a, c) + worth(c, b) - worth(a, b)
        best = int(better.argmax())
        return float(better[best]), int(c[best])

    leaves = [(0, len(gain))]
    while len(leaves) < LEAVES:
        found = [(cut(a, b), (a, b)) for a, b in leaves]
        (better, at), (a, b) = max(found)
        if better <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(gain))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (m[b] - m[a] + SMOOTH)
    return out


def _quarters(gain: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over a pair's bins: one cut along each axis, at best."""
    g, m = gain.cumsum(0).cumsum(1), mass.cumsum(0).cumsum(1)
    best, out = -1.0, np.zeros_like(gain)
    for i in range(gain.shape[0] - 1):
        for j in range(gain.shape[1] - 1):
            parts = []
            for t in (g, m):
                a = t[i, j]
                parts.append(np.array([a, t[i, -1] - a, t[-1, j] - a, t[-1, -1] - t[i, -1] - t[-1, j] + a]))
            value = parts[0] / (parts[1] + SMOOTH)
            worth = float((parts[0] * value).sum())
            if worth > best:
                best, out = worth, np.empty_like(gain)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = value[0], value[1]
                out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value[2], value[3]
    return out


def fit_table(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on a feature matrix and 0/1 labels."""
    model = Additive()
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [
        np.zeros(0) for _ in range(x.shape[1])
    ]
    model.tables = [np.zeros(BINS + 1) for _ in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    if not len(x) or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            r, h = residual()
            step = RATE * _tree(np.bincount(b[:, k], r, BINS + 1), np.bincount(b[:, k], h, BINS + 1))
            model.tables[k] += step
            z += step[b[:, k]]
    c, size = Additive._coarse(b), PAIR_BINS * PAIR_BINS
    grid = lambda i, j, v: np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, size).reshape(PAIR_BINS, PAIR_BINS)
    r, h = residual()
    worth = []
    for i in range(x.shape[1]):
        for j in range(i):
            g, m = grid(i, j, r), grid(i, j, h)
            worth.append((float((g * g / (m + SMOOTH)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(worth, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            r, h = residual()
            step = RATE * _quarters(grid(i, j, r), grid(i, j, h))
            table += step
            z += step[c[:, i], c[:, j]]
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features_of(t.as_py()) for t in column], dtype=np.float64).reshape(-1, len(FEATURES))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and an array column ``x`` of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(_matrix(batch.columns[-1])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*batch.schema.names[:-1], "x"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes[:-1]), "x array<double>"]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE,
) -> Additive:
    """Fit on at most ``rows`` labelled rows of ``docs`` that ``learn`` (over doc_id) selects,
    in an order drawn from a hash. Rows with null labels or ids are no examples; without
    examples, or with one kind only, the model is its intercept."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learn).select(
        F.col(doc_id).cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("_y")
    )
    known = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    # Labels that no row of docs has take no place.
    present = known.select("_id").distinct().join(common.narrow(common.written(chosen.distinct(), "labels")), "_id")
    drawn = F.xxhash64("_id")
    chosen = common.written(present.orderBy(drawn, "_id", "_y").limit(rows), "labels")
    joined = known.join(F.broadcast(chosen), "_id")
    # Rows may share an id: at most twice as many are read, ids in the order drawn.
    found = features(joined, ["_id", "_y"], "_text").orderBy(drawn, "_id", "_y", "x").limit(2 * rows).collect()
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_table(x, np.array([r["_y"] for r in found], dtype=np.float64))


def score(docs: DataFrame, model: Additive, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and score (0 to 1). Null and empty texts are scored as texts of no
    bytes; every row is scored once, repeated or not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.scores(_matrix(batch.columns[-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes[:-1]), "score double"]))


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    """Whether crc32 of the id as text leaves ``remainder``; for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder
