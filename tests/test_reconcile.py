"""Matching: similarity, blocking, scenarios, and equality with the plain pairwise rules."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

import brute
from txnrecon import schema
from txnrecon.operators import ledger, reconcile, similarity
from txnrecon.operators.params import ReconcileParams

P = ReconcileParams()
DAY = datetime.date(2026, 4, 20)


def charge(i, merchant, amount, ref=None, day=0, ccy="USD", account=1):
    return (account, i, ref or f"{i:010d}", merchant, Decimal(str(amount)), ccy, DAY + datetime.timedelta(day))


def journal(i, merchant, amount, ext=None, day=0, ccy="USD", account=1):
    return (account, i, DAY + datetime.timedelta(day), Decimal(str(amount)), ccy, merchant, ext)


def run(spark, charges, journals, aliases=None, shuffle=False):
    c = spark.createDataFrame(charges, schema.CHARGES)
    j = spark.createDataFrame(journals, schema.JOURNALS)
    a = None if aliases is None else spark.createDataFrame([(n, t, x) for n, (t, x) in enumerate(aliases)], schema.ALIASES)
    if shuffle:
        c, j = c.repartition(5), j.repartition(3)
    asked = reconcile.intents(c, j, a)
    decided = reconcile.resolve(asked, j)
    got = {r.charge_id: (r.outcome, r.journal_id) for r in decided.collect()}
    left = {r.journal_id for r in reconcile.unmatched(j, decided).collect()}
    return got, left


def expected(charges, journals, aliases=()):
    out, left = {}, set()
    for account in {c[0] for c in charges} | {j[0] for j in journals}:
        cs = [(c[1], c[2], c[3], c[4], c[5], c[6]) for c in charges if c[0] == account]
        js = [(j[1], j[2], j[3], j[4], j[5], j[6]) for j in journals if j[0] == account]
        o, l = brute.reconcile(cs, js, P, aliases)
        out.update(o)
        left |= l
    return out, left


SCENARIOS = {
    "same amount": ([charge(1, "METRO WEST", 10)], [journal(1, "METRO WEST CENTRAL", 10)], {1: ("confirmed", 1)}),
    "other amount": ([charge(1, "METRO WEST", 10)], [journal(1, "metro west", "10.02")], {1: ("mismatch", 1)}),
    "within tolerance": ([charge(1, "METRO WEST", 10)], [journal(1, "metro west", "10.01")], {1: ("confirmed", 1)}),
    "nothing near": ([charge(1, "METRO WEST", 10)], [journal(1, "Zyzzyva", 10)], {1: ("book_new", None)}),
    "gray zone": ([charge(1, "martha", 10)], [journal(1, "marhtx qq", 10)], None),
    "two equal": ([charge(1, "Shop", 10)], [journal(1, "Shop", 10), journal(2, "Shop", 10)], {1: ("review", None)}),
    "prior booking": (
        [charge(1, "Shop", 10, ref="1234567890")],
        [journal(1, "Other", 10, ext="bpstmt:1234567890", ccy="EUR", day=90)],
        {1: ("confirmed", 1)},
    ),
    "outside window": ([charge(1, "Shop", 10)], [journal(1, "Shop", 10, day=6)], {1: ("book_new", None)}),
    "edge of window": ([charge(1, "Shop", 10)], [journal(1, "Shop", 10, day=-5)], {1: ("confirmed", 1)}),
    "other currency": ([charge(1, "Shop", 10)], [journal(1, "Shop", 10, ccy="EUR")], {1: ("book_new", None)}),
    "other account": ([charge(1, "Shop", 10)], [journal(1, "Shop", 10, account=2)], {1: ("book_new", None)}),
    "contention": (
        [charge(1, "Shop", 10), charge(2, "Shop", 11)], [journal(1, "Shop", "10.5")],
        {1: ("review", None), 2: ("review", None)},
    ),
    "cluster by amount": (
        [charge(1, "Shop", 50), charge(2, "Shop", 10), charge(3, "Shop", 30)], [journal(1, "Shop", "10.10")],
        {1: ("book_new", None), 2: ("mismatch", 1), 3: ("book_new", None)},
    ),
    "repeated reference": (
        [charge(1, "Shop", 10, ref="7" * 10), charge(2, "Shop", 20, ref="7" * 10)],
        [journal(1, "x", 10, ext="bpstmt:" + "7" * 10), journal(2, "x", 20, ext="bpstmt:" + "7" * 10)],
        {1: ("confirmed", 1), 2: ("confirmed", 2)},
    ),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    charges, journals, want = SCENARIOS[name]
    got, left = run(spark, charges, journals)
    assert (got, left) == expected(charges, journals)
    if want is not None:
        assert got == want


def test_alias_bridges_disjoint_names(spark):
    charges, journals = [charge(1, "GIFT X1", 10)], [journal(1, "Harbour Relief Fund", 10)]
    aliases = [("", "never"), ("gift", "Harbour Relief Fund"), ("gi", "Other")]
    assert run(spark, charges, journals)[0] == {1: ("book_new", None)}
    assert run(spark, charges, journals, aliases)[0] == {1: ("confirmed", 1)}


def random_ledger(seed, n=60):
    rng = random.Random(seed)
    words = ["red", "blue", "old", "anvil", "ring", "shop", "café", "x", "online", "jr", "east"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(12)]
    charges = [
        charge(i, rng.choice(names), rng.choice([10, 10.5, 20, 21, 40]), day=rng.randint(-8, 8),
               ccy=rng.choice(["USD", "USD", "DOP"]), account=rng.choice([1, 1, 2]))
        for i in range(1, n)
    ]
    journals = [
        journal(i, rng.choice(names) + rng.choice(["", "", " ONLINE"]), rng.choice([10, 10.5, 20, 21, 40]),
                ext=rng.choice([None, None, None, f"bpstmt:{rng.randint(1, n):010d}", "tx"]), day=rng.randint(-8, 8),
                ccy=rng.choice(["USD", "USD", "DOP"]), account=rng.choice([1, 1, 2]))
        for i in range(1, n)
    ]
    return charges, journals


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_pairwise_rules_and_ignores_order(spark, seed):
    charges, journals = random_ledger(seed)
    want = expected(charges, journals)
    assert run(spark, charges, journals) == want
    random.Random(seed).shuffle(charges)
    assert run(spark, charges, journals[::-1], shuffle=True) == want


def test_one_hot_account_in_small_blocks(spark, monkeypatch):
    """All names in one account and bucket, cut into blocks of a few names."""
    rng = random.Random(9)
    names = ["".join(rng.choices("abcdef gh", k=rng.randint(0, 9))).strip() for _ in range(60)]
    frame = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    other = spark.createDataFrame([(1, n) for n in names[::-1][:40]], "k int, name string")
    got = similarity.similar_names(frame, other, ["k"], 0.70, left_chunk=7, right_chunk=5)
    rows = [(r.name_a, r.name_b, round(r.score, 9)) for r in got.collect()]
    want = {
        (a, b, round(brute.similarity(a, b), 9)) for a in set(names) for b in set(names[::-1][:40])
        if brute.similarity(a, b) >= 0.70
    }
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("threshold", [0.5, 0.70, 0.9])
def test_bound_never_loses_a_pair(spark, threshold):
    rng = random.Random(4)
    names = ["".join(rng.choices("abcé1 ", k=rng.randint(0, 12))).strip() for _ in range(80)]
    frame = spark.createDataFrame([(1, " ".join(n.split())) for n in names], "k int, name string")
    got = {(r.name_a, r.name_b) for r in similarity.similar_names(frame, frame, ["k"], threshold).collect()}
    distinct = {" ".join(n.split()) for n in names}
    assert got == {(a, b) for a in distinct for b in distinct if brute.similarity(a, b) >= threshold}


def test_jaro_winkler_matches_the_scalar_rule():
    rng = random.Random(0)
    a = ["".join(rng.choices("abcdé ", k=rng.randint(0, 15))) for _ in range(500)]
    b = ["".join(rng.choices("abcdé ", k=rng.randint(0, 15))) for _ in range(500)]
    got = similarity.jaro_winkler(pd.Series(a), pd.Series(b))
    assert np.allclose(got, [brute.jaro_winkler(x, y) for x, y in zip(a, b)])
    known = similarity.jaro_winkler(pd.Series(["martha", "", "a"]), pd.Series(["marhta", "", ""]))
    assert known == pytest.approx([0.961111111, 1.0, 0.0])


def test_double_book_probe(spark):
    records = spark.createDataFrame(
        [(1, 1, DAY, "Shop One"), (2, 1, DAY + datetime.timedelta(30), "Shop One"), (3, 2, DAY, "Shop One")],
        "rec int, account_id bigint, txn_date date, merchant string",
    )
    journals = spark.createDataFrame(
        [
            journal(9, "shop one", 99, ext="bpstmt:1", ccy="EUR", day=5),
            journal(7, "shop one", 1, ext="consumo", day=0),
            journal(8, "Shop One Ltd", 1, ext="bpstmt:2", day=-5),
            journal(6, "shop one", 1, ext="bpstmt:3", day=6),
        ],
        schema.JOURNALS,
    )
    got = {r.rec: r.statement_journal_id for r in ledger.double_book(records, journals).collect()}
    assert got == {1: 8, 2: None, 3: None}


def test_params_are_checked():
    with pytest.raises(ValueError):
        ReconcileParams(merchant_gray=0.9)
    with pytest.raises(ValueError):
        ReconcileParams(score_epsilon=-1)
