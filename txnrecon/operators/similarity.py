"""Merchant name similarity and the blocked join that finds similar names."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrecon.functions.text import canon_merchant, token_containment, tokens

# Names of one block on either side; a block is what a single task compares.
LEFT_CHUNK = 2048
RIGHT_CHUNK = 512
# Pairs looked at together, and characters (names times width) scored together.
PAIRS, CELLS = 1 << 16, 1 << 20
# Pairs that one task looks at.
TASK_PAIRS = 1 << 21
# Blocks that one task looks at, however small they are.
TASK_BLOCKS = 1 << 16
# Rows of whole keys that are compared together.
TASK_ROWS = 1 << 16
# Longest name whose places are the bits of one word, entries of a table of them, tokens compared at once.
WORD, MASKS, FEW = 64, 1 << 23, 8


def jaro_winkler(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro-Winkler of aligned names, whole batch at a time. The prefix bonus (four
    characters, 0.1 each) applies above 0.7 only; two empty names are equal."""
    n = len(left)
    if n == 0:
        return np.zeros(0)

    def codes(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        text = names.fillna("").to_numpy(dtype=object)
        size = np.array([len(t) for t in text])
        wide = max(1, int(size.max()))
        return np.array(text, dtype=f"<U{wide}").view(np.uint32).reshape(n, wide), size

    a, la = codes(left)
    b, lb = codes(right)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    at_b = np.arange(b.shape[1])[None, :]
    inside_b = at_b < lb[:, None]
    used_a = np.zeros(a.shape, dtype=bool)
    used_b = np.zeros(b.shape, dtype=bool)
    row = np.arange(n)
    for i in range(a.shape[1]):
        free = (b == a[:, i : i + 1]) & inside_b & ~used_b & (np.abs(at_b - i) <= reach)
        hit = free.any(axis=1) & (i < la)
        used_a[:, i] = hit
        used_b[row[hit], free.argmax(axis=1)[hit]] = True
    matches = used_a.sum(axis=1)

    def matched(chars: np.ndarray, used: np.ndarray) -> np.ndarray:
        line, col = np.nonzero(used)
        packed = np.zeros((n, max(1, int(matches.max()))), dtype=np.uint32)
        packed[line, (np.cumsum(used, axis=1) - 1)[line, col]] = chars[line, col]
        return packed

    swapped = (matched(a, used_a) != matched(b, used_b)).sum(axis=1) // 2
    m = np.maximum(matches, 1)
    jaro = (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (matches - swapped) / m) / 3.0
    jaro = np.where(matches == 0, np.where((la == 0) & (lb == 0), 1.0, 0.0), jaro)
    head = min(4, a.shape[1], b.shape[1])
    same = (a[:, :head] == b[:, :head]) & (np.arange(head)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1.0 - jaro), jaro)


def _jaro_winkler_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    """Scores of a batch; a pair that repeats within it is scored once."""
    pairs = pd.DataFrame({"a": left, "b": right})
    number = pairs.groupby(["a", "b"], sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(number, return_index=True)[1]
    some = [side.iloc[first].fillna("").tolist() for side in (left, right)]
    return pd.Series(_by_length(*some)[number])


# Marked non-deterministic so that a filter on the score is not pushed below the
# projection, where it would compute the score a second time.
jaro_winkler_udf = F.pandas_udf(_jaro_winkler_batch, T.DoubleType()).asNondeterministic()


def canonical(df: DataFrame, merchant: str, aliases: DataFrame | None, out: str) -> DataFrame:
    """Add the comparable form of a merchant: the first alias whose trigger occurs in the
    lower-cased name, then whitespace and case folding.

    The substring test is an equi-join: distinct names are cut into substrings of the
    lengths triggers have, so neither side is broadcast or crossed.
    """
    if aliases is None:
        return df.withColumn(out, canon_merchant(merchant))
    rules = aliases.where(F.length("trigger") > 0)
    lengths = rules.agg(F.collect_set(F.length("trigger"))).scalar()
    low = F.col("_low")

    def pieces(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - size + 1)
        return F.when(
            F.length(low) >= size, F.transform(starts, lambda at: F.substring(low, at, size))
        ).otherwise(F.array().cast("array<string>"))

    cut = F.array_distinct(F.flatten(F.transform(F.col("_lengths"), pieces)))
    names = df.select(F.col(merchant).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    grams = (
        names.withColumn("_low", F.lower("_name"))
        .withColumn("_lengths", lengths)
        .select("_name", F.explode(cut).alias("_gram"))
    )
    first = (
        grams.join(rules, F.col("_gram") == F.col("trigger"))
        .groupBy("_name")
        .agg(F.min_by("canonical", "pos").alias("_alias"))
    )
    joined = df.join(first, F.col(merchant) == F.col("_name"), "left")
    return joined.select(*df.columns, canon_merchant(F.coalesce("_alias", merchant)).alias(out))


def score_pairs(pairs: DataFrame, a: str = "name_a", b: str = "name_b") -> DataFrame:
    """Score each distinct pair of canonical names: the better of Jaro-Winkler and token
    containment. Identical names need no Python."""
    distinct = pairs.select(a, b).distinct()
    containment = token_containment(tokens(a), tokens(b))
    same = distinct.where(F.col(a) == F.col(b)).withColumn("score", F.lit(1.0))
    differing = distinct.where(F.col(a) != F.col(b))
    scored = differing.withColumn("score", F.greatest(jaro_winkler_udf(a, b), containment))
    return same.unionByName(scored)


def _by_length(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler`` of aligned names, those of like length together: a batch is as wide as its
    longest name, so one long name costs itself only."""
    out = np.zeros(len(left))
    if not len(left):
        return out
    longest = np.maximum(np.fromiter(map(len, left), np.int64, len(left)), np.fromiter(map(len, right), np.int64, len(right)))
    size = np.ceil(np.log2(np.maximum(longest, 8)))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cuts):
        most = max(1, CELLS >> int(size[same[0]]))
        for k in range(0, len(same), most):
            some = same[k : k + most]
            out[some] = jaro_winkler(pd.Series([left[i] for i in some]), pd.Series([right[i] for i in some]))
    return out


def _ascii_tokens(name: str) -> list[str]:
    """``tokens`` of a name in ASCII."""
    return [t.lower() for t in re.split("[^A-Za-z0-9]+", name) if len(t) >= 2]


def wide_tokens(name: Column) -> Column:
    """Tokens of a name that isn't ASCII, in one text; those of others are cut once per batch. It is
    never null: the JVM sizes a batch at each row and then fills a run of nulls anew."""
    return F.coalesce(F.when(F.octet_length(name) > F.length(name), F.array_join(tokens(name), " ")), F.lit(""))


class _Names:
    """Distinct names of a batch: lengths, uses and places of each character, and tokens."""

    def __init__(self, names: pa.Array, tokens: pa.Array):
        coded = names.dictionary_encode()
        self.index = coded.indices.to_numpy()
        self.names = coded.dictionary.to_pylist()
        n = len(self.names)
        flat = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, self.names), np.int64, n)
        chars, kind = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(n), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        # Beyond 128 characters, those that fall into one class count as one: an overlap is never too small.
        classes = min(len(chars), 128)
        uses = np.bincount(owner * classes + kind % max(classes, 1), minlength=n * classes).reshape(n, classes)
        self.uses = uses.astype(np.min_scalar_type(int(self.size.max(initial=0))))
        # Characters by place, with one that none is at the end, and the places of each as bits.
        short = place < WORD
        self.codes = np.full((n, WORD), len(chars), np.int32)
        self.codes[owner[short], place[short]] = kind[short]
        self.fits = (self.size <= WORD) & (n * (len(chars) + 1) <= MASKS)
        self.places = np.zeros((n, len(chars) + 1) if n * (len(chars) + 1) <= MASKS else (0, 0), np.uint64)
        if self.places.size:
            np.bitwise_or.at(self.places, (owner[short], kind[short]), np.uint64(1) << place[short].astype(np.uint64))
        first = np.zeros(n, np.int64)
        first[self.index[::-1]] = np.arange(len(self.index))[::-1]
        lists = tokens.take(pa.array(first)).to_pylist()
        if not pa.types.is_list(tokens.type):
            # Texts of ``wide_tokens``.
            lists = [_ascii_tokens(n) if n.isascii() else t.split(" ") if t else [] for n, t in zip(self.names, lists, strict=True)]
        number: dict[str, int] = {}
        self.tokens = [[number.setdefault(t, len(number)) for t in some] for some in lists]
        self.parts = np.fromiter(map(len, self.tokens), np.int64, n)
        # A token is one of 64 marks: names without a common mark share no token.
        self.marks = np.array([sum({1 << (t * 0x9E3779B1 >> 7 & 63) for t in some}) for some in self.tokens], np.uint64)
        self.listed = np.full((n, FEW), -1, np.int32)
        for k, some in enumerate(self.tokens):
            self.listed[k, : len(some)] = some[:FEW]

    def containment(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Share of the shorter token list that the other has; the left one's if they are as long."""
        swap = self.parts[i] > self.parts[j]
        small, big = np.where(swap, j, i), np.where(swap, i, j)
        out = np.zeros(len(i))
        few = self.parts[big] <= FEW
        found = np.zeros(int(few.sum()), np.int64)
        for k in range(FEW):
            asked = self.listed[small[few], k]
            found += (asked >= 0) & (self.listed[big[few]] == asked[:, None]).any(axis=1)
        out[few] = found / np.maximum(self.parts[small[few]], 1)
        for k in np.flatnonzero(~few).tolist():
            held = set(self.tokens[big[k]])
            out[k] = sum(t in held for t in self.tokens[small[k]]) / max(len(self.tokens[small[k]]), 1)
        return out

    def jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``jaro_winkler`` of pairs of names: places of one word's bits each, or else of arrays."""
        out = np.zeros(len(i))
        bits = self.fits[i] & self.fits[j]
        out[bits] = self._by_bits(i[bits], j[bits])
        rest = np.flatnonzero(~bits)
        out[rest] = _by_length([self.names[k] for k in i[rest]], [self.names[k] for k in j[rest]])
        return out

    def _by_bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        order = np.argsort(-self.size[i], kind="stable")
        i, j = i[order], j[order]
        la, lb = self.size[i], self.size[j]
        one = np.uint64(1)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        used, hits = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        # Names are in order of their length, so a place concerns the first ``n`` of them.
        many = [int((la > at).sum()) for at in range(int(la.max(initial=0)))]
        for at, n in enumerate(many):
            low = np.maximum(at - reach[:n], 0).astype(np.uint64)
            high = np.minimum(at + reach[:n], WORD - 1).astype(np.uint64)
            near = ((np.uint64(2) << high) - one) & ~((one << low) - one)
            free = self.places[j[:n], self.codes[i[:n], at]] & near & ~used[:n]
            taken = free & (~free + one)
            used[:n] |= taken
            hits[:n] |= (taken != 0).astype(np.uint64) << np.uint64(at)
        matches = np.bitwise_count(used).astype(np.int64)
        left, differ = used.copy(), np.zeros(len(i), np.int64)
        for at, n in enumerate(many):
            hit = hits[:n] >> np.uint64(at) & one != 0
            next_ = left[:n] & (~left[:n] + one)
            differ[:n] += hit & (next_ & self.places[j[:n], self.codes[i[:n], at]] == 0)
            left[:n] ^= np.where(hit, next_, np.uint64(0))
        m = np.maximum(matches, 1)
        jaro = (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (matches - differ // 2) / m) / 3.0
        jaro = np.where(matches == 0, np.where((la == 0) & (lb == 0), 1.0, 0.0), jaro)
        out = np.empty(len(i))
        out[order] = np.where(jaro > 0.7, jaro + 0.1 * self.prefix(i, j) * (1.0 - jaro), jaro)
        return out

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Characters, four at most, that two names begin with."""
        inside = np.arange(4)[None, :] < np.minimum(self.size[i], self.size[j])[:, None]
        same = (self.codes[i, :4] == self.codes[j, :4]) & inside
        return np.cumprod(same, axis=1).sum(axis=1)


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (row, left, right) positions of rows with so many names on either side, some at a time."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    lo, ro, size = np.cumsum(left) - left, np.cumsum(right) - right, left * right
    # Most rows have few pairs: those are laid out together.
    few = np.flatnonzero((size > 0) & (size <= PAIRS))
    for rows in np.split(few, np.flatnonzero(np.diff(np.cumsum(size[few]) // PAIRS)) + 1):
        n = size[rows]
        row = np.repeat(rows, n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield row, lo[row] + at // right[row], ro[row] + at % right[row]
    for row in np.flatnonzero(size > PAIRS).tolist():
        n, m = int(left[row]), int(right[row])
        step = max(1, PAIRS // m)
        for k in range(0, n, step):
            some = np.arange(lo[row] + k, lo[row] + min(n, k + step))
            yield np.full(len(some) * m, row), np.repeat(some, m), np.tile(np.arange(ro[row], ro[row] + m), len(some))


def _may_reach(names: _Names, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Necessary condition for a Jaro-Winkler score of at least ``threshold``.

    Matched characters cannot outnumber the characters two names share, so Jaro is at
    most (o/|a| + o/|b| + 1) / 3 for an overlap o. The prefix bonus closes a tenth of the
    gap to one for each common first character, above 0.7 only.
    """
    jaro = np.full(len(i), threshold)
    if threshold > 0.7:
        bonus = 0.1 * names.prefix(i, j)
        jaro = np.maximum(0.7, (threshold - bonus) / (1 - bonus))
    need = np.maximum(3 * jaro - 1 - 1e-9, 0.0)
    overlap = np.minimum(names.uses[i], names.uses[j]).sum(axis=1, dtype=np.int64)
    return overlap * (names.size[i] + names.size[j]) >= need * names.size[i] * names.size[j]


def _reaching(names: _Names, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of names reach the threshold, and their scores."""
    sharing = (names.marks[i] & names.marks[j]) != 0
    near = _may_reach(names, i, j, threshold) | (i == j)
    kept = np.flatnonzero(near | sharing)
    i, j, near, sharing = i[kept], j[kept], near[kept], sharing[kept]
    score = np.zeros(len(kept))
    score[near] = names.jaro_winkler(i[near], j[near])
    score[sharing] = np.maximum(score[sharing], names.containment(i[sharing], j[sharing]))
    score[i == j] = 1.0
    reached = score >= threshold
    return kept[reached], score[reached]


def best_near(threshold: float, window_days: int, keys: list[str], kept: list[str]):
    """Rows sorted by ``keys``, _side and _id to the charges among them (keys, day, name, ``kept``) with
    the journals of similar names within the window, the best free one, its score and the runner-up's.

    Rows: day, name, toks, _side (0: a charge that asks, -1: one that doesn't, 1: a journal), and of
    journals _id and _free. A key has few rows of either side; many keys are compared together.
    """
    shown = [*keys, "day", "name", *kept]

    def begins(rows: pa.Table) -> np.ndarray:
        """Where keys begin; a charge that doesn't ask is on its own."""
        side = rows["_side"].to_numpy()
        new = np.ones(len(side), bool)
        new[1:] = (side[1:] < 0) | (side[:-1] < 0)
        for key in keys:
            code = rows[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def best(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        side = rows["_side"].to_numpy()
        sides = [np.flatnonzero(side == k) for k in (0, 1)]
        group = np.searchsorted(at, np.arange(len(side)), side="right") - 1
        known = _Names(pc.fill_null(rows["name"].combine_chunks(), ""), rows["toks"].combine_chunks())
        name, day = known.index.astype(np.int64), pc.fill_null(rows["day"], 0).to_numpy()
        free_ = pc.fill_null(rows["_free"], False).to_numpy()
        n = len(side)
        plausible, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        score, second = np.full(n, np.nan), np.full(n, np.nan)
        # All pairs of a charge come together.
        for _, i, j in _pairs(*(np.bincount(group[k], minlength=len(at)) for k in sides)):
            i, j = sides[0][i], sides[1][j]
            near = np.abs(day[i] - day[j]) <= window_days
            i, j = i[near], j[near]
            # A pair of names that repeats is scored once.
            pairs, number = np.unique(name[i] * len(known.names) + name[j], return_inverse=True)
            reached, scores = _reaching(known, pairs // len(known.names), pairs % len(known.names), threshold)
            found = np.full(len(pairs), np.nan)
            found[reached] = scores
            found = found[number]
            similar = ~np.isnan(found)
            if not similar.any():
                continue
            i, j, found = i[similar], j[similar], found[similar]
            order = np.lexsort((j, -found, ~free_[j], i))
            i, j, found = i[order], j[order], found[order]
            free = free_[j]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            plausible[i[first]] = np.diff(first, append=len(i))
            top = first[free[first]]
            after = np.minimum(top + 1, len(i) - 1)
            place[i[top]], score[i[top]] = j[top], found[top]
            second[i[top]] = np.where((after > top) & (i[after] == i[top]) & free[after], found[after], np.nan)
        out = pa.array(side <= 0)
        none = np.isnan(score)
        added = {
            "n_plausible": pa.array(plausible, mask=plausible == 0), "best_score": pa.array(score, mask=none),
            "best_journal": rows["_id"].combine_chunks().take(pa.array(place, mask=none)),
            "second_score": pa.array(second, mask=np.isnan(second)),
        }
        columns = {k: rows[k].combine_chunks() for k in shown} | added
        return pa.RecordBatch.from_arrays([v.filter(out) for v in columns.values()], [*columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TASK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            at = begins(rows)
            # The last key may go on in the next batch.
            cut = int(at[-1])
            if cut:
                yield best(rows.slice(0, cut), at[:-1])
            rest = rows.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
        if size:
            rows = pa.Table.from_batches(held)
            yield best(rows, begins(rows))

    return run


def _compare(threshold: float, keys: int):
    """Blocks of names (keys, left names, right names) to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(keys), batch.column(keys + 1)]
            counts = [s.value_lengths().to_numpy() for s in sides]
            flat = [s.flatten() for s in sides]
            known = _Names(*(pa.concat_arrays([f.field(k) for f in flat]) for k in ("name", "toks")))
            left, right = np.split(known.index, [len(flat[0])])
            for row, i, j in _pairs(*counts):
                i, j = left[i], right[j]
                kept, score = _reaching(known, i, j, threshold)
                names = [pa.array([known.names[k] for k in side[kept]], pa.string()) for side in (i, j)]
                scoped = [batch.column(k).take(pa.array(row[kept])) for k in range(keys)]
                yield pa.RecordBatch.from_arrays([*scoped, *names, pa.array(score)], [*batch.schema.names[:keys], "name_a", "name_b", "score"])

    return run


def bucket_of(day: Column, window_days: int) -> Column:
    return F.floor(F.unix_date(day) / (2 * window_days + 1)).cast("bigint")


def buckets_near(day: Column, window_days: int) -> Column:
    """The one or two buckets that hold every day within the window."""
    return F.array_distinct(
        F.array(
            bucket_of(F.date_sub(day, window_days), window_days), bucket_of(F.date_add(day, window_days), window_days)
        )
    )


def similar_names(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    threshold: float,
    left_chunk: int = LEFT_CHUNK,
    right_chunk: int = RIGHT_CHUNK,
) -> DataFrame:
    """Pairs of names with a score of at least ``threshold`` that meet under ``keys``.

    ``left`` and ``right`` hold (keys, name). Names are made distinct first, so equal
    rows cost nothing. The names of a key are packed into blocks, a key with many names into a
    grid of several; a row is a pair of blocks, so names travel once per opposite block, not
    once per pair. A task counts the characters that two names share, for all pairs of its blocks
    at once, scores those that can reach the threshold, and hands on those that do.

    Returns keys, name_a, name_b, score.
    """
    ls, rs = (side.select(*keys, "name").distinct() for side in (left, right))
    grid = (
        ls.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .join(rs.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
        .select(
            *keys, F.ceil(F.col("_n") / left_chunk).alias("_rows"), F.ceil(F.col("_m") / right_chunk).alias("_cols"),
            (F.col("_n").cast("double") * F.col("_m")).alias("_pairs"),
        )
    )
    # Blocks are few bytes and much work: their number of tasks follows the pairs, not the bytes.
    pairs, found = grid.agg(F.sum("_pairs"), F.sum(F.col("_rows") * F.col("_cols"))).first()
    tasks = max(math.ceil((pairs or 0) / TASK_PAIRS), math.ceil((found or 0) / TASK_BLOCKS))

    def packed(side: DataFrame, own: str, own_count: str, other: str, other_count: str, out: str) -> DataFrame:
        return (
            side.join(grid.drop("_pairs"), keys)
            .groupBy(*keys, F.pmod(F.xxhash64("name"), F.col(own_count)).alias(own), other_count)
            .agg(F.collect_list("name").alias(out))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_count) - 1)))
            .drop(other_count)
        )

    met = packed(ls, "_r", "_rows", "_c", "_cols", "_left").join(packed(rs, "_c", "_cols", "_r", "_rows", "_right"), [*keys, "_r", "_c"])
    # Tokens are cut where the blocks are compared: only names travel.
    marked = [
        F.transform(side, lambda n: F.struct(n.alias("name"), wide_tokens(n).alias("toks"))).alias(side) for side in ("_left", "_right")
    ]
    blocks = met.repartition(max(1, tasks), *keys, "_r", "_c").select(*keys, *marked)
    schema = T.StructType([*blocks.select(*keys).schema, *T._parse_datatype_string("name_a string, name_b string, score double")])
    return blocks.mapInArrow(_compare(threshold, len(keys)), schema)
