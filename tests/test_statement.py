"""Running computations, statement grammar, row grouping, balances and the report."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import brute
from txnrecon import schema
from txnrecon.operators import ordered, statement
from txnrecon.plans import statements

D = datetime.date


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_equals_a_plain_scan(spark, width):
    rng = random.Random(width)
    rows = [(k, i * rng.choice([1, 2]) + i, rng.choice([None, None, rng.randint(0, 9)])) for k in (1, 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "k int, o bigint, v int")
    one = F.when(F.col("v").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    got = ordered.running(
        frame, ["k"], "o", last={"last": F.col("v")}, before={"before": F.col("v")}, total={"n": one}, width=width
    ).collect()
    want = set()
    for k in (1, 2):
        newest, n = None, 0
        for _, o, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            before = newest
            newest = v if v is not None else newest
            n += v is not None
            want.add((k, o, v, newest, before, n))
    assert {(r.k, r.o, r.v, r["last"], r.before, r.n) for r in got} == want and len(got) == len(rows)


def test_ordinal_across_chunks(spark):
    frame = spark.createDataFrame([(1, i * 7) for i in range(50)] + [(2, 3)], "k int, o bigint")
    got = {(r.k, r.o): r.n for r in ordered.ordinal(frame, ["k"], "o", "n", width=20).collect()}
    assert got == {**{(1, i * 7): i + 1 for i in range(50)}, (2, 3): 1}


SAMPLE = [
    ["BALANCE TOTAL"], ["1.00", "2.00", "3.00", "4.00"],  # before any section: ignored, the label stays armed
    ["Visa", "Prestige DOP"],
    ["****-****-****-2468", "500,000.00", "22/01/2026", "16/02/2026", "41,250.10"],
    ["28/12", "28/12", "0700112233", "Pago", "-41,250.35"],
    ["4321", "012345"], ["1111", "2"],
    ["****-****-****-2468", "1.00", "22/01/2026", "9.99"],  # repeated header
    ["25/01", "24/01", "31415926535897932384626", "GIFT  SHOP ", "HARBOUR", "1,000.00", "trailer"],
    ["5.00", "interest"],
    ["0", "0.00", "50.00", "500.00", "888.66"],
    ["0", "0.00", "50.00", "500.00", "111.11"],  # not armed any more
    ["VISA PRESTIGE USD"],
    ["****-****-****-2468", "22/01/2026", "3,141.59"],
    ["14/01", "17/01", "27182818284590452353602", "Kiosk 12", "Airport", "6.25"],
]


def rows_of(spark, lines, stmt=1):
    data = [(stmt, i, 0.0, [(float(x), t) for x, t in enumerate(cells)]) for i, cells in enumerate(lines)]
    return spark.createDataFrame(data, schema.TEXT_ROWS)


@pytest.mark.parametrize("parts", [None, 2, 7])
def test_statement_grammar(spark, parts):
    context = statement.contextual(rows_of(spark, SAMPLE), parts)
    sections = {r.section_no: r for r in statement.sections(context).collect()}
    assert [(s.currency, s.last4, s.cut_date) for s in (sections[1], sections[2])] == [
        ("DOP", "2468", D(2026, 1, 22)), ("USD", "2468", D(2026, 1, 22)),
    ]
    assert (sections[1].balance_anterior, sections[1].balance_total) == (Decimal("41250.10"), Decimal("888.66"))
    assert (sections[2].balance_anterior, sections[2].balance_total) == (Decimal("3141.59"), None)
    txns = {r.txn_no: r for r in statement.transactions(context).collect()}
    assert len(txns) == 3
    assert (txns[1].direction, txns[1].amount, txns[1].auth_date) == ("in", Decimal("41250.35"), D(2025, 12, 28))
    assert (txns[1].mcc, txns[1].auth_code) == ("4321", "012345")
    assert (txns[2].merchant, txns[2].amount, txns[2].mcc) == ("GIFT SHOP HARBOUR", Decimal(1000), None)
    assert (txns[2].posting_date, txns[2].auth_date, txns[2].section_no) == (D(2026, 1, 25), D(2026, 1, 24), 1)
    assert (txns[3].currency, txns[3].section_no) == ("USD", 2)
    assert statement.statement_errors(context).count() == 0
    checked = {r.section_no: r for r in statement.balance(statement.sections(context), statement.transactions(context)).collect()}
    assert checked[1].delta == abs(Decimal("41250.10") + 1000 - Decimal("41250.35") - Decimal("888.66"))
    assert (checked[2].delta, checked[2].balance_checked, checked[2].balance_mismatch) == (None, False, False)


@pytest.mark.parametrize(
    ("lines", "error"),
    [
        ([["nothing here"]], "sections_missing"),
        ([["****-****-****-2468", "22/01/2026"]], "card_outside_section"),
        ([["25/01", "24/01", "0700112233", "m", "1.00"]], "txn_outside_section"),
        ([["VISA PRESTIGE USD"], ["25/01", "24/01", "0700112233", "m", "1.00"]], "cut_date_missing"),
        ([*SAMPLE[2:4], ["31/02", "24/01", "0700112233", "m", "1.00"]], "txn_date_invalid"),
        ([*SAMPLE[2:4], ["25/01", "24/01", "0700112233", "m"]], "amount_unusable"),
        ([*SAMPLE[2:4], ["25/01", "24/01", "0700112233", "1.00"]], "merchant_empty"),
        ([*SAMPLE[2:4], ["25/01", "24/01", "0700112233", "m", "1.00001"]], "amount_unusable"),
    ],
)
def test_unusable_statements(spark, lines, error):
    (row,) = statement.statement_errors(statement.contextual(rows_of(spark, lines))).collect()
    assert error in row.parse_error


def test_rows_are_anchored_not_chained(spark):
    runs = [(1, 1, 0, 5.0, 100.0, "a"), (1, 1, 1, 1.0, 98.0, "b"), (1, 1, 2, 0.0, 96.5, "c"), (1, 1, 3, 2.0, 100.0, "d"),
            (1, 2, 0, 0.0, 100.0, "other page")]
    got = statement.group_rows(spark.createDataFrame(runs, schema.TEXT_RUNS)).collect()
    assert {(r.page, r.row_no): [c.text for c in r.cells] for r in got} == {
        (1, 1): ["d", "a", "b"], (1, 2): ["c"], (2, 1): ["other page"],
    }


def test_row_grouping_equals_the_fold(spark):
    rng = random.Random(3)
    runs = [(1, 1, i, round(rng.uniform(0, 9), 1), round(rng.uniform(0, 60), 1), f"t{i}") for i in range(150)]
    got = statement.group_rows(spark.createDataFrame(runs, schema.TEXT_RUNS)).orderBy("row_no").collect()
    assert [[c.text for c in r.cells] for r in got] == [t for _, t in brute.group_runs([(x, y, n, t) for _, _, n, x, y, t in runs])]


def test_pages_over_many_tasks(spark):
    rng = random.Random(4)
    runs = [(1, p, i, 0.0, round(rng.uniform(0, 300 if p < 3 else 3), 1), "t") for p in (1, 2, 3) for i in range(900)]
    frame = spark.createDataFrame(runs, schema.TEXT_RUNS)
    one, many = ({(r.page, r.y): r.anchor for r in statement.row_anchors(frame, parts=n).collect()} for n in (1, 9))
    want = {}
    for page in (1, 2, 3):
        anchor = None
        for y in sorted({r[4] for r in runs if r[1] == page}, reverse=True):
            anchor = y if anchor is None or anchor - y > statement.ROW_TOLERANCE else anchor
            want[page, y] = anchor
    assert one == many == want


def test_statements_over_many_tasks(spark):
    """One long statement and many short ones, with sparse row numbers, against a plain fold."""
    rng = random.Random(5)
    kinds = ["title", "card", "txn", "balance_label", "balance_value", "ignored"]
    rows = []
    for stmt in range(1, 40):
        at = 0
        for _ in range(600 if stmt == 20 else rng.randint(1, 12)):
            at += rng.randint(1, 10 ** rng.randint(1, 9))
            kind = rng.choice(kinds)
            rows.append((stmt, at, kind, rng.choice(["DOP", "USD"]) if kind == "title" else None, D(2026, 1, rng.randint(1, 28)) if kind == "card" else None))
    frame = spark.createDataFrame(rows, "stmt_id long, row_no long, kind string, title_currency string, card_cut date")
    want, state = {}, None
    for stmt, at, kind, title, cut in rows:
        if state is None or state["stmt"] != stmt:
            state = dict(stmt=stmt, currency=None, card=None, section=0, txn=0, cut=None, armed=False)
        opens = armed = False
        if kind == "title":
            state["currency"] = title
        elif kind == "card":
            state["cut"] = cut
            opens = state["currency"] is not None and state["currency"] != state["card"]
            state["section"] += opens
            state["card"] = state["currency"] or state["card"]
        elif kind == "txn":
            state["txn"] += 1
        elif kind == "balance_label":
            state["armed"] = True
        elif kind == "balance_value" and state["section"]:
            armed, state["armed"] = state["armed"], False
        want[stmt, at] = (state["currency"], state["cut"], state["section"], state["txn"], opens, armed)
    for parts in (1, 11):
        got = {
            (r.stmt_id, r.row_no): (r.section_currency, r.cut_date, r.section_no, r.txn_no, r.opens_section, r.is_balance)
            for r in statement.fold(frame, parts).collect()
        }
        assert got == want


def plan_inputs(spark):
    dims = spark.createDataFrame(
        [("account", "banco_popular_usd", "7"), ("account", "banco_popular_paying_usd", "8")], schema.DIMS
    )
    lines = [
        ["VISA PRESTIGE USD"], ["****-****-****-2468", "22/05/2026", "100.00"],
        ["10/05", "10/05", "1000000001", "Confirmed Shop", "10.00"],
        ["10/05", "10/05", "1000000002", "Mismatch Store", "12.00"],
        ["10/05", "10/05", "1000000003", "Brand New Place", "30.00"],
        ["10/05", "10/05", "1000000004", "Payment", "-52.00"],
        ["BALANCE TOTAL"], ["0.00", "0.00", "0.00", "100.00"],
        ["VISA PRESTIGE DOP"], ["****-****-****-2468", "22/05/2026", "1.00"],
        ["10/05", "10/05", "1000000005", "Unrouted", "5.00"],
    ]
    rows = rows_of(spark, lines).unionByName(rows_of(spark, [["junk"]], stmt=2))
    day = D(2026, 5, 11)
    journals = spark.createDataFrame(
        [
            (7, 1, day, Decimal("10.00"), "USD", "confirmed shop", None),
            (7, 2, day, Decimal("11.00"), "USD", "Mismatch Store Ltd", None),
            (7, 3, day, Decimal("99.00"), "USD", "zzz qqq", None),
            (7, 4, D(2026, 1, 1), Decimal("99.00"), "USD", "too old", None),
        ],
        schema.JOURNALS,
    )
    rates = spark.createDataFrame([], schema.RATES)
    return rows, dims, journals, rates


def test_statement_report(spark):
    rows, dims, journals, rates = plan_inputs(spark)
    got = {r.stmt_id: r.asDict() for r in statements.report(rows, dims, journals, rates).collect()}
    want = dict(reconciled=1, amount_mismatch=1, corrected=0, booked_new=1, payments_booked=1, unmatched_booked=1,
                deferred=0, review=1, balance_mismatch=0, balance_checked=True, balance_delta=Decimal("0.0000"), is_clean=False)
    assert {k: v for k, v in got[1].items() if k != "stmt_id"} == want
    assert got[2]["review"] == 1 and got[2]["is_clean"] is False and got[2]["balance_delta"] is None


def test_statement_report_with_corrections(spark):
    rows, dims, journals, rates = plan_inputs(spark)
    fixed = statements.report(rows, dims, journals, rates, autocorrect_pct=Decimal(25)).where("stmt_id = 1").collect()[0]
    assert (fixed.corrected, fixed.amount_mismatch) == (1, 0)
    bounded = statements.report(rows, dims, journals, rates, autocorrect_pct=Decimal(5)).where("stmt_id = 1").collect()[0]
    assert (bounded.corrected, bounded.amount_mismatch) == (0, 1)


def test_a_statement_run_again_books_nothing(spark):
    rows, dims, journals, rates = plan_inputs(spark)
    early = D(2026, 1, 2)
    held = [
        (7, 5, early, Decimal("30.00"), "USD", "posted before the window", "bpstmt:1000000003"),
        (7, 6, early, Decimal("52.00"), "USD", "paid before the window", "bpstmt:1000000004"),
        (7, 7, early, Decimal("52.00"), "USD", "held twice", "bpstmt:1000000004"),
    ]
    known = journals.unionByName(spark.createDataFrame(held, schema.JOURNALS))
    got = statements.report(rows, dims, known, rates).where("stmt_id = 1").collect()[0]
    assert (got.booked_new, got.payments_booked, got.reconciled) == (0, 0, 3)
