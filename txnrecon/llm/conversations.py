"""Conversation structure repair: the cheapest edits that give a conversation legal roles.

A conversation's rows, in order of their turn, are kept (K, cost 0), given another role (R, 2) or
deleted (D, 3), and empty messages are inserted (I, 2), so that the roles read ``(s?(ua)+)?``. A
path through (row, last role) is weighed by one integer: its high digits are the cost, its low
ones the letters, two octal digits a row (an insert, the row's own letter; or that letter and a
zero) and two for inserts at the end. A row's letter always follows its insert, so no row's digits
begin another's, and the zeros at the end make the shorter of two audits the smaller: the plain
minimum of the integers is the cheapest repair and, among equals, the ASCII-least audit. Two
inserts in a row are only ever of use after a lone ``s`` at the end (and dearer than deleting it).

A conversation may be of any length. Its narrow rows (no texts) are range-sorted, so that a long
one is spread over tasks, and cut into blocks; each block yields the least weight from every role
before it to every role after it. Blocks of a conversation are then joined by their costs and the
ranks of their digits. What a task holds of one conversation is a few bytes a row, as its audit is
one value. Texts are joined to the decisions afterwards, by key.

Defined results: rows of one turn are taken by role, then SHA-256 of the text; null turns come
first; null role and text count as one space; a null conv_id is a conversation of its own;
repeated rows are duplicates; further columns of any name are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.llm import common

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: Letters of the octal digits; a zero is no letter.
LETTERS = {"0": None, "1": "D", "2": "I", "3": "K", "4": "R"}
#: What may follow the start (0), a system (1), user (2) or assistant (3) message.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}
#: From a last role to the end: cost and inserts.
TAIL = {0: (0, ""), 3: (0, ""), 2: (2, "I"), 1: (4, "II")}
LEGAL = {"su", "ua", "au"}
#: Rows of a block.
BLOCK = 512
#: Short blocks whose weights a Python worker remembers.
REMEMBERED = 1 << 14
FORCED = 8

KEY = ["none", "conv", "timed", "at", "role", "sha"]
BLOCKS = (
    "none boolean, conv long, part int, block long, n long, blank long, duplicate long, truncated long, illegal long,"
    " first string, last string, low long, high long, turns long, ends array<int>, weights array<binary>,"
    " rows array<struct<timed:boolean,at:long,role:string,sha:binary,copies:long>>"
)
DECIDED = (
    "none boolean, conv long, part int, block long, state int, line long, slots string, gaps long, blank long,"
    " duplicate long, truncated long, illegal long, cost long, audit string"
)
LINES = (
    "none boolean, conv long, line long, edit string, timed boolean, at long, role string, sha binary, as_role string"
)
DIGESTS = "none boolean, conv long, sha256 string"


def edges(code: int) -> list[list[tuple[int, int, int]]]:
    """For each last role the (next one, cost, digits) of a row's edits, the least for each next."""
    forced, kind, truncated = code == FORCED, "sua?"[code // 2 % 4], code % 2
    out = []
    for state in range(4):
        least: dict[int, tuple[int, int]] = {}
        for before in (None, "u", "a"):
            at = state if before is None else STEP.get((state, before))
            if at is None:
                continue
            edits = [(at, 3, DELETE)]
            if not forced:
                edits += [(STEP[at, kind], truncated, KEEP)] if (at, kind) in STEP else []
                edits += [(STEP[at, r], 2 + truncated, REROLE) for r in "ua" if (at, r) in STEP]
            for to, cost, letter in edits:
                found = (cost, letter << 3) if before is None else (cost + 2, INSERT << 3 | letter)
                if to not in least or found < least[to]:
                    least[to] = found
        out.append([(to, *found) for to, found in sorted(least.items())])
    return out


def weigh(codes: bytes, opened: bool) -> dict[tuple[int, int], int]:
    """(role before, role after) to the least weight of a block's edits: cost above six bits a row."""
    n, out = len(codes), {}
    steps = {code: edges(code) for code in set(codes)}
    for start in range(4) if opened else (0,):
        at = {start: 0}
        for i, code in enumerate(codes):
            shift, then = 6 * (n - 1 - i), {}
            for state, weight in at.items():
                for to, cost, digits in steps[code][state]:
                    w = weight + (cost << 6 * n) + (digits << shift)
                    if to not in then or w < then[to]:
                        then[to] = w
            at = then
        out.update(((start, end), w) for end, w in at.items())
    return out


def _remembered(codes: bytes, opened: bool) -> dict[tuple[int, int], int]:
    """``weigh``; short conversations repeat one another."""
    if len(codes) > 64:
        return weigh(codes, opened)
    known = common.per_worker("weights")
    if (codes, opened) not in known:
        if len(known) > REMEMBERED:
            known.clear()
        known[codes, opened] = weigh(codes, opened)
    return known[codes, opened]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    yield batch()


class _Block:
    """Rows of one conversation that are weighed together."""

    def __init__(self, none: bool, conv: int, opened: bool):
        self.none, self.conv, self.opened = none, conv, opened
        self.codes, self.rows = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, r: dict, copies: int, first: bool) -> None:
        """``copies`` rows alike, the first of which is the first at all if ``first``."""
        initial = r["role"][:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        fresh = first and not r["repeated"] and not r["blank"]
        if r["blank"]:
            self.blank += copies
        else:
            self.duplicate += copies - fresh
            self.truncated += fresh and r["cut"]
        kind = "sua".find(initial) if initial else -1
        code = 2 * (kind if kind >= 0 else 3) + r["cut"] if fresh else FORCED
        self.codes += bytes([code]) + bytes([FORCED]) * (copies - 1)
        if r["timed"] and r["at"] != self.high:
            self.turns += 1
            self.low = r["at"] if self.low is None else self.low
            self.high = r["at"]
        self.rows.append({"timed": r["timed"], "at": r["at"], "role": r["role"], "sha": r["sha"], "copies": copies})

    def row(self, part: int, number: int) -> tuple:
        n = len(self.codes)
        found = _remembered(bytes(self.codes), self.opened)
        ends = [4 * s + t for s, t in found]
        weights = [w.to_bytes((w.bit_length() + 7) // 8, "big") for w in found.values()]
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.none, self.conv, part, number, n, *counts, self.first, self.last, self.low, self.high, self.turns,
                ends, weights, self.rows)


def _cut(width: int):
    """Sorted narrow rows to blocks."""
    schema = common.arrow_schema(BLOCKS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, number, block, first_seen = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                conv = (r["none"], r["conv"])
                left, first = r["copies"], True
                while left:
                    if block is None or (block.none, block.conv) != conv or len(block.codes) >= width:
                        again = block is not None and (block.none, block.conv) == conv
                        if block is not None:
                            yield block.row(part, number)
                            number += 1
                        first_seen = first_seen or conv
                        block = _Block(*conv, again or conv == first_seen)
                    take = min(left, width - len(block.codes))
                    block.add(r, take, first)
                    left, first = left - take, False
        if block is not None:
            yield block.row(part, number)

    return lambda batches: _batches(blocks(batches), schema, 200)


def _after(state: int, slots: str) -> int:
    """Messages that the letters of a block leave."""
    return len(slots) - slots.count("D") - slots.count(" ")


def _join_blocks(blocks: list[dict]) -> Iterator[tuple]:
    """A conversation's blocks in order to one decision each and one row for the whole."""
    after = {s: (cost, len(inserts), None) for s, (cost, inserts) in TAIL.items()}
    plans = []
    for b in reversed(blocks):
        n = b["n"]
        weights = {divmod(e, 4): int.from_bytes(w, "big") for e, w in zip(b["ends"], b["weights"], strict=True)}
        digits = {pair: w & (1 << 6 * n) - 1 for pair, w in weights.items()}
        rank = {d: k for k, d in enumerate(sorted(set(digits.values())))}
        least: dict[int, tuple[int, int]] = {}
        for (s, t), w in weights.items():
            cost, behind, _ = after[t]
            whole = (w >> 6 * n) + cost << 16 | rank[digits[s, t]] << 8 | behind
            if s not in least or whole < least[s][0]:
                least[s] = (whole, t)
        # Order among the chosen ends of a conversation, whatever they cost.
        order = {w: k for k, w in enumerate(sorted({w & 0xFFFF for w, _ in least.values()}))}
        after = {s: (w >> 16, order[w & 0xFFFF], t) for s, (w, t) in least.items()}
        plans.append((b, {s: (t, digits[s, t]) for s, (_, t) in least.items()}))
    state, line, audit = 0, 0, []
    head, tail = blocks[0], blocks[-1]
    key = (head["none"], head["conv"])
    illegal = sum(b["illegal"] for b in blocks)
    turns, high = 0, None
    for k, (b, plan) in enumerate(reversed(plans)):
        to, digits = plan[state]
        octal = f"{digits:o}".zfill(2 * b["n"])
        slots = "".join(LETTERS[d] or " " for d in octal)
        if k == len(blocks) - 1:
            slots += TAIL[to][1]
        yield (*key, b["part"], b["block"], state, line, slots, *[None] * 7)
        audit.append(slots.replace(" ", ""))
        line += _after(state, slots)
        state = to
        if k:
            illegal += blocks[k - 1]["last"] + b["first"] not in LEGAL
        turns += b["turns"] - (b["low"] is not None and b["low"] == high)
        high = b["high"] if b["high"] is not None else high
    low = next((b["low"] for b in blocks if b["low"] is not None), None)
    gaps = 0 if low is None else high - low + 1 - turns
    counts = [sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")]
    yield (*key, tail["part"], None, None, None, None, gaps, *counts, illegal, after[0][0], "".join(audit))


def _mapped(rows, ddl: str):
    """A mapInArrow function that yields the tuples of ``rows`` as batches."""
    schema = common.arrow_schema(ddl)
    return lambda batches: _batches(rows(batches), schema)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held: list[dict] = []
    for batch in batches:
        for b in batch.to_pylist():
            if held and (held[0]["none"], held[0]["conv"]) != (b["none"], b["conv"]):
                yield from _join_blocks(held)
                held = []
            held.append(b)
    if held:
        yield from _join_blocks(held)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks and their decisions to the messages that stay or come in, without texts."""
    for batch in batches:
        for b in batch.to_pylist():
            yield from _lines_of(b, b["state"], b["line"], b["slots"])


def _lines_of(b: dict, state: int, line: int, slots: str) -> Iterator[tuple]:
    key = (b["none"], b["conv"])
    # Each row has two places; those after the last are inserts at the end.
    owned = [r for r in b["rows"] for _ in range(2 * r["copies"])]
    for r, letter in itertools.zip_longest(owned, slots):
        wanted = "u" if state != 2 else "a"
        if letter == "I":
            found = ("I", None, None, None, None, NAME[wanted])
        elif letter == "R":
            found = ("R", r["timed"], r["at"], r["role"], r["sha"], NAME[wanted])
        elif letter == "K":
            found = ("K", r["timed"], r["at"], r["role"], r["sha"], r["role"])
        else:
            continue
        yield (*key, line, *found)
        state, line = STEP[state, found[-1][:1]], line + 1


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows under a key without nulls."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.alias("text"),
    )


def _faults(keyed: DataFrame) -> DataFrame:
    """One narrow row for each key: its copies, and whether it is blank, cut short or came before."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = keyed.select(*KEY, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    found = common.written(narrow.groupBy(*KEY, "blank", "cut").agg(F.count("*").alias("copies")), "turns")
    same = ["none", "conv", "role", "sha"]
    seen = found.groupBy(*same).agg(F.min(F.struct("timed", "at")).alias("earliest"), F.count("*").alias("times"))
    again = common.narrow(common.written(seen.where("times > 1").drop("times"), "seen"))
    later = F.coalesce(F.struct("timed", "at") > F.col("earliest"), F.lit(False))
    return found.join(again, same, "left").withColumn("repeated", later).drop("earliest")


class Repair:
    """Decisions on the conversations of ``rows`` (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame, width: int = BLOCK):
        self.keyed = _keyed(rows)
        order = ["none", "conv", "timed", "at", "role", "sha"]
        ranged = _faults(self.keyed).repartitionByRange(*order).sortWithinPartitions(*order)
        self.blocks = common.written(ranged.mapInArrow(_cut(width), BLOCKS), "blocks")
        dealt = self.blocks.drop("rows").repartition("none", "conv").sortWithinPartitions("none", "conv", "part", "block")
        self.decided = common.written(dealt.mapInArrow(_mapped(_decide, DECIDED), DECIDED), "decided")

    def totals(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row a conversation."""
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return self.decided.where("block IS NULL").select(_conv(), *counts)

    def messages(self) -> DataFrame:
        """conv_id, line, edit, role, text: the repaired conversations."""
        return self._messages().select(_conv(), "line", "edit", F.col("as_role").alias("role"), "text")

    def _messages(self) -> DataFrame:
        plans = self.decided.where("block IS NOT NULL").select("part", "block", "state", "line", "slots")
        told = self.blocks.select("none", "conv", "part", "block", "rows").join(plans, ["part", "block"])
        lines = told.mapInArrow(_mapped(_lines, LINES), LINES)
        texts = self.keyed.groupBy(*KEY).agg(F.first("text").alias("text"))
        return lines.join(texts, KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))

    def digests(self) -> DataFrame:
        """conv_id, sha256 of a repaired conversation's ``role:text`` lines; none without lines. A
        digest of one value is made in order, so a conversation streams through one task here."""
        lines = self._messages().select("none", "conv", "line", F.concat_ws(":", "as_role", "text").alias("said"))
        dealt = lines.repartition("none", "conv").sortWithinPartitions("none", "conv", "line")
        return dealt.mapInArrow(_mapped(_digest, DIGESTS), DIGESTS).select(_conv(), "sha256")


def _conv() -> Column:
    return F.when(~F.col("none"), F.col("conv")).alias("conv_id")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at, state = None, None
    for batch in batches:
        for none, conv, said in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (none, conv) == at:
                state.update(b"\n" + said.encode())
                continue
            if at is not None:
                yield (*at, state.hexdigest())
            at, state = (none, conv), hashlib.sha256(said.encode())
    if at is not None:
        yield (*at, state.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by the crc32 of ``conv_id:turn``, modulo 20: 0 drops a row, 1 empties
    its text, 2 takes its closing marks, 3 repeats it, 4 makes its role user. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("by"))
    named = rows.select("conv_id", "turn", said("role").alias("by"), said("text").alias("said"), kind.alias("kind"))
    again = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return named.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("_n")).drop("_n")


def repaired(rows: DataFrame, damaged: DataFrame, width: int = BLOCK) -> DataFrame:
    """A row for every conv_id of ``rows``: totals of the repair of ``damaged``, and the digest."""
    repair = Repair(damaged, width)
    ids = rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    totals = repair.decided.where("block IS NULL")
    digests = repair.digests().select(
        F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("sha256")
    )
    met = ids.join(totals, ["none", "conv"], "left").join(digests, ["none", "conv"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select(
        _conv(), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256")
    )
