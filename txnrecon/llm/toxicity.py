"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of its own vector (words of the labelled sample; one shared vector for
others) and the mean vector of its character trigrams. A window of words is read in both
directions by gated recurrent units, attention pools their states, and a logistic unit gives the
window's probability. A text's score is that of its most toxic window. Windows of 24 words overlap
by 12 (a window at every word would cost many times the budgeted time), so that any passage of up
to 13 words lies whole in one; a longer one lies in several. Labels belong to whole texts, so training alternates: all windows first, then the most
toxic windows that the present model finds.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrecon.llm import common

#: Labelled rows that the network is trained on, toxic and harmless; the bytes they bring on average at most.
SAMPLE, SAMPLE_BYTES = (800, 2_400), 6_000
WINDOW, STRIDE = 24, 12
VECTOR, STATE, ATTEND = 12, 8, 6
TRIGRAMS = 1 << 13
#: A word has a vector of its own from this share of the labelled texts on, and from so many.
LEAST_SHARE, LEAST_TEXTS = 0.008, 3
AT_ONCE = 2_048
#: Passes over the chosen windows: so many, and until so many steps are taken.
EPOCHS, STEPS, BATCH = 7, 400, 256
SEED = 7


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of each word (with a mark at both ends), and where words begin."""
    flat = np.frombuffer(b"\x01" + b"\x01\x01".join(words) + b"\x01", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    firsts = np.cumsum(sizes + 2) - (sizes + 2)
    here = flat * 961 * 961 + np.roll(flat, -1) * 961 + np.roll(flat, -2)
    n = np.maximum(sizes, 1)
    starts = np.cumsum(n) - n
    at = np.repeat(firsts - starts, n) + np.arange(int(n.sum()))
    return ((here[at] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) % TRIGRAMS, starts


def windows_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts laid end to end: owner, first word, end of the text."""
    owner, first, end, at = [], [], [], 0
    for k, n in enumerate(sizes):
        starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        owner.append(np.full(len(starts), k))
        first.append(starts + at)
        end.append(np.full(len(starts), at + n))
        at += n
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(owner or none), np.concatenate(first or none), np.concatenate(end or none)


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.numbers = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.bias = 0.0
        self.p = {
            "word": draw(0.1, len(vocabulary) + 1, VECTOR),
            "gram": draw(0.3, TRIGRAMS, VECTOR),
            "wx": draw(0.4, 2, VECTOR, 3 * STATE),
            "wh": draw(0.3, 2, STATE, 3 * STATE),
            "b": np.zeros((2, 1, 3 * STATE), dtype=np.float32),
            "att": draw(0.4, 2 * STATE, ATTEND),
            "ask": draw(0.4, ATTEND),
            "out": draw(0.4, 2 * STATE),
            "c": np.zeros(1, dtype=np.float32),
        }

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words: number in the vocabulary, trigram buckets, where each begins."""
        number = np.fromiter((self.numbers.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        return (number, *_trigrams(words)) if words else (number, number, number)

    def _vectors(self, number: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["gram"][grams], starts, axis=0)
        return self.p["word"][number] + sums / np.diff(np.append(starts, len(grams)))[:, None].astype(np.float32)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What each distinct word feeds to the gates, by direction; the last row is no word."""
        fed = vectors[None] @ self.p["wx"] + self.p["b"]
        return np.concatenate([fed, np.zeros((2, 1, 3 * STATE), dtype=np.float32)], axis=1)

    def forward(self, fed: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logit of each window; ids (windows, words) index ``fed``, its last row pads."""
        n, length = ids.shape
        pad = fed.shape[1] - 1
        by_step = np.stack([ids.T, ids.T[::-1]], axis=1)  # step, direction, window
        h, kept = np.zeros((2, n, STATE), dtype=np.float32), []
        states = np.empty((length, 2, n, STATE), dtype=np.float32)
        wh = self.p["wh"]
        for t in range(length):
            x = np.stack([fed[0][by_step[t, 0]], fed[1][by_step[t, 1]]])
            u = h @ wh
            gates = _sigmoid(x[:, :, : 2 * STATE] + u[:, :, : 2 * STATE])
            r, z = gates[:, :, :STATE], gates[:, :, STATE:]
            new = np.tanh(x[:, :, 2 * STATE :] + r * u[:, :, 2 * STATE :])
            real = (by_step[t] != pad)[:, :, None]
            after = np.where(real, new + z * (h - new), h)
            if keep:
                kept.append((h, r, z, new, u[:, :, 2 * STATE :], real))
            states[t] = h = after
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # word, window, state
        seen = np.tanh(both @ self.p["att"])
        e = seen @ self.p["ask"]
        e = np.where(ids.T != pad, e, np.float32(-30))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", a, both)
        logit = pooled @ self.p["out"] + self.p["c"]
        return (logit, (by_step, kept, both, seen, a, pooled)) if keep else logit

    def gradients(self, fed: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray):
        """Gradients of the weighted logistic loss, and of what words feed to the gates."""
        logit, (by_step, kept, both, seen, a, pooled) = self.forward(fed, ids, keep=True)
        d = (w * (_sigmoid(logit) - y) / w.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pool = d[:, None] * self.p["out"]
        d_a = np.einsum("ns,tns->tn", d_pool, both)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["ask"] = np.einsum("tn,tnk->k", d_e, seen)
        d_seen = d_e[:, :, None] * self.p["ask"] * (1 - seen**2)
        g["att"] = np.einsum("tns,tnk->sk", both, d_seen)
        d_both = a[:, :, None] * d_pool[None] + d_seen @ self.p["att"].T
        d_states = np.stack([d_both[:, :, :STATE], d_both[::-1, :, STATE:]], axis=1)
        g["wh"], d_fed = np.zeros_like(self.p["wh"]), np.zeros_like(fed)
        d_h = np.zeros_like(kept[0][0])
        for t in range(len(kept) - 1, -1, -1):
            h, r, z, new, un, real = kept[t]
            d_h = d_h + d_states[t]
            d_now = np.where(real, d_h, 0)
            d_new = d_now * (1 - z) * (1 - new**2)
            d_r = d_new * un * r * (1 - r)
            d_z = d_now * (h - new) * z * (1 - z)
            d_x = np.concatenate([d_r, d_z, d_new], axis=2)
            d_u = np.concatenate([d_r, d_z, d_new * r], axis=2)
            g["wh"] += h.transpose(0, 2, 1) @ d_u
            for side in (0, 1):
                np.add.at(d_fed[side], by_step[t, side], d_x[side])
            d_h = np.where(real, d_now * z, d_h) + d_u @ self.p["wh"].transpose(0, 2, 1)
        d_fed[:, -1] = 0
        return g, d_fed[:, :-1]

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Owner and logit of every window of the texts; and their words and ids, for training."""
        numbers: dict[bytes, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64)
        coded = self.encode(list(numbers))
        fed = self.inputs(self._vectors(*coded) if numbers else np.zeros((0, VECTOR), dtype=np.float32))
        owner, first, end = windows_of([len(t) for t in texts])
        flat = np.append(flat, len(numbers))
        logits = np.empty(len(owner), dtype=np.float32)
        ids = np.empty((len(owner), WINDOW), dtype=np.int32)
        for k in range(0, len(owner), AT_ONCE):
            at = first[k : k + AT_ONCE, None] + np.arange(WINDOW)
            ids[k : k + AT_ONCE] = flat[np.where(at < end[k : k + AT_ONCE, None], at, len(flat) - 1)]
            logits[k : k + AT_ONCE] = self.forward(fed, ids[k : k + AT_ONCE])
        return owner, logits, (coded, ids)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        owner, logits, _ = self.window_logits(texts)
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, owner, logits)
        return _sigmoid(most + self.bias)


def train(texts: list[list[bytes]], labels: list[int], seed: int = SEED) -> Network:
    """Train on texts with 0/1 labels. Without texts of both kinds nothing can be told apart: the
    network then warns and scores every text 0, so that no text counts as toxic."""
    seen = Counter(w for t in texts for w in set(t))
    least = max(LEAST_TEXTS, LEAST_SHARE * len(texts))
    net = Network(sorted(w for w, n in seen.items() if n >= least), seed)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        warnings.warn(f"{int(y.sum())} toxic and {int((1 - y).sum())} harmless texts to learn from: every score is 0", stacklevel=2)
        net.bias = -np.inf
        return net
    rng = np.random.default_rng(seed)
    m, v, turn = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0

    def step(coded: tuple, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal turn
        number, grams, starts = coded
        blank = np.where(rng.random(len(number)) < 0.1, 0, number)  # the trigrams must do without
        vectors = net._vectors(blank, grams, starts)
        g, d_fed = net.gradients(net.inputs(vectors), ids, target, weight)
        g["wx"], g["b"] = vectors.T[None] @ d_fed, d_fed.sum(axis=1, keepdims=True)
        d_vec = (d_fed @ net.p["wx"].transpose(0, 2, 1)).sum(axis=0)
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], blank, d_vec)
        sizes = np.diff(np.append(starts, len(grams)))
        np.add.at(g["gram"], grams, np.repeat(d_vec / sizes[:, None], sizes, axis=0))
        turn += 1
        for k, x in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            x -= rate * (m[k] / (1 - 0.9**turn) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-6) + 1e-3 * x)

    epoch = 0
    while epoch < EPOCHS or turn < STEPS:
        owner, logits, (coded, ids) = net.window_logits(texts)
        target = y[owner]
        if epoch < 1 or turn < STEPS // 8:
            chosen = np.flatnonzero((target > 0) | (rng.random(len(owner)) < 0.3))
        else:  # the most toxic window of each toxic text, and the worst of harmless ones
            order = np.lexsort((-logits, owner))
            nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            chosen = order[nth < np.where(target[order] > 0, 1, 4)]
        rng.shuffle(chosen)
        balance = target[chosen].mean()
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            used, local = np.unique(ids[part], return_inverse=True)
            number, grams, starts = coded
            if used[-1] == len(number):  # padding
                used = used[:-1]
            sizes = np.diff(np.append(starts, len(grams)))
            n = sizes[used]
            first = np.cumsum(n) - n
            some = grams[np.repeat(starts[used] - first, n) + np.arange(int(n.sum()))]
            weight = np.where(target[part] > 0, 0.5 / balance, 0.5 / (1 - balance)).astype(np.float32)
            if len(used):
                step((number[used], some, first), local.reshape(len(part), -1), target[part], weight, 0.02 if epoch < EPOCHS - 2 or turn < 0.7 * STEPS else 0.005)
        epoch += 1
    # The cut of 0.3 lies midway between the classes, where the fewest texts are on the wrong side.
    owner, logits, _ = net.window_logits(texts)
    most = np.full(len(y), -np.inf)
    np.maximum.at(most, owner, logits)
    order = np.argsort(most)
    toxic_below, harmless_above = np.cumsum(y[order])[:-1], np.cumsum(1 - y[order][::-1])[::-1][1:]
    wrong = toxic_below / y.sum() + harmless_above / (len(y) - y.sum())
    gaps = np.diff(most[order])
    cut = max(np.flatnonzero(wrong == wrong.min()), key=lambda k: gaps[k])
    net.bias = float(np.log(0.3 / 0.7) - (most[order][cut] + most[order][cut + 1]) / 2)
    return net


def _cap(sizes: list[int], budget: int) -> int:
    """The bytes that a text may bring, so that all together bring at most ``budget``."""
    ordered = sorted(sizes)
    for k, size in enumerate(ordered):
        share = budget // (len(ordered) - k)
        if size > share:
            return share
        budget -= size
    return ordered[-1] if ordered else 0


def _spread(text: bytes, most: int) -> bytes:
    """A text of more than ``most`` bytes by runs of two windows' words, evenly spread over it."""
    if len(text) <= most:
        return text
    words, run = text.split(), 2 * WINDOW
    runs = max(1, len(words) * most // len(text) // run)
    starts = np.linspace(0, max(0, len(words) - run), runs).astype(np.int64)
    return b" ".join(w for s in starts for w in words[s : s + run])[:most]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: tuple[int, int] = SAMPLE,
    most_bytes: int = SAMPLE_BYTES,
) -> Network:
    """Train on at most ``rows`` labelled rows of ``docs`` (toxic, harmless) that ``learn`` (over
    doc_id) selects, in an order drawn from a hash. Ids without a row in ``docs`` take no place.
    Texts are read whole as long as those of a kind bring ``most_bytes`` each on average; else the
    longest bring some of their windows."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learn).select(
        F.col(doc_id).cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("_y")
    )
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("_id"), common.text_key(text).alias("_key"), F.col(text).cast("binary").alias("_text")
    )
    present = common.written(texts.select("_id").join(common.narrow(known.distinct()), "_id").distinct(), "labels")
    parts = [present.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows[1 - k]) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    met = common.written(texts.join(F.broadcast(chosen), "_id").withColumn("_size", F.octet_length("_text")), "sample")
    first = lambda found, k: found.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id", "_key").limit(rows[1 - k])
    caps = [_cap([r[0] for r in first(met, k).select("_size").collect()], rows[1 - k] * most_bytes) for k in (0, 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("_y").to_pylist()
            made = pa.array([_spread(t.as_py(), caps[k]) for t, k in zip(batch.column("_text"), kinds, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_y", "_id", "_key")), made], ["_y", "_id", "_key", "_text"])

    brought = met.mapInArrow(cut, "_y int, _id long, _key long, _text binary")
    found = [r for k in (0, 1) for r in first(brought, k).collect()]
    return train([words_of(bytes(r["_text"])) for r in found], [r["_y"] for r in found])


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """row (all columns of ``docs``, whatever their names) and score (0 to 1): the most toxic of
    all overlapping windows of the whole text. A null, empty or blank text is one empty window;
    rows that repeat one another are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                found = shared.value.scores([words_of(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and score."""
    found = scored(docs.select(*keep, F.col(text).alias("_text")), net, "_text")
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "score")
