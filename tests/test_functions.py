"""Scalars."""

import datetime
import hashlib
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnrecon.functions import answers, dates, keys, numbers, receipts, status, text, wires

D = datetime.date


def many(spark, build, values, type_="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, c {type_}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("c"))).collect()]


def test_amount_gate_takes_plain_decimals_only(spark):
    good = ["0", "149.99", " 1250.0000 ", "007"]
    bad = ["1.00000", "1e3", "-1", "+1", "1,250.00", "$1", "", ".5", "5.", "1 2", "١", None]
    assert all(v is not None for v in many(spark, numbers.amount_gate, good))
    assert many(spark, numbers.amount_gate, bad) == [None] * len(bad)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(0, 10**9, places=2), min_size=1, max_size=40))
def test_amount_round_trip(spark, amounts):
    assert many(spark, numbers.amount_gate, [f"{a:f}" for a in amounts]) == amounts


def test_decimal_text_is_canonical(spark):
    values = [Decimal("100.0000"), Decimal("0.0000"), Decimal("12.5000"), Decimal("0.0001")]
    assert many(spark, numbers.decimal_text, values, "decimal(18,4)") == ["100", "0", "12.5", "0.0001"]


def test_half_even_rounding(spark):
    frame = spark.createDataFrame(
        [(Decimal("2.5"), 0), (Decimal("3.5"), 0), (Decimal("1.005"), 2), (Decimal("1.015"), 2), (Decimal("7"), None)],
        "v decimal(18,4), n int",
    )
    got = [r[0] for r in frame.select(numbers.round_half_even(F.col("v"), F.col("n"))).collect()]
    assert got == [Decimal(2), Decimal(4), Decimal("1.00"), Decimal("1.02"), None]


def test_statement_figures(spark):
    values = ["-60,999.81", "1,000.00", "-", "", "abc", "12", "7.28-"]
    got = many(spark, numbers.statement_decimal, values)
    assert got == [Decimal("-60999.81"), Decimal("1000.00"), None, None, None, Decimal(12), None]


def test_ledger_magnitude_trims_zeros_before_the_scale_rule(spark):
    values = ["-12.500000000000", "3.10000001", "x", "100"]
    assert many(spark, numbers.magnitude, values) == [Decimal("12.5"), None, None, Decimal(100)]


def test_digit_shapes(spark):
    assert many(spark, numbers.reference_number, ["0601324353", " 123456789 ", "12345678901a"]) == ["0601324353", None, None]
    assert many(spark, numbers.last4, [" 7524 ", "752", "75244"]) == ["7524", None, None]
    assert many(spark, numbers.auth_code, ["1", "", "1x"]) == ["1", None, None]


def test_wallet_dates(spark):
    values = ["2026-05-11", "May 11, 2026", "may  1, 2026", "Sept 1, 2026", "05/11/2026", "13/05/2026", "2026-02-30"]
    assert many(spark, dates.wallet_date, values) == [
        D(2026, 5, 11), D(2026, 5, 11), D(2026, 5, 1), None, D(2026, 5, 11), None, None,
    ]


def test_bank_dates_are_day_first(spark):
    assert many(spark, dates.bank_date, ["27/05/2026", "04/03/2026", "2026-03-04", "5/27/2026"]) == [
        D(2026, 5, 27), D(2026, 3, 4), D(2026, 3, 4), None,
    ]


def test_every_month_name(spark):
    days = [D(2023, m, 9) for m in range(1, 13)]
    assert many(spark, dates.english_date, [d.strftime("%B %d, %Y") for d in days]) == days
    assert many(spark, dates.english_date, [d.strftime("%b %d, %Y") for d in days]) == days


def test_year_inference_wraps_at_the_cut(spark):
    frame = spark.createDataFrame(
        [("25/12", D(2026, 1, 22)), ("22/01", D(2026, 1, 22)), ("31/02", D(2026, 5, 1)), ("1/2", D(2026, 5, 1))],
        "t string, cut date",
    )
    got = [r[0] for r in frame.select(dates.infer_year(F.col("t"), F.col("cut"))).collect()]
    assert got == [D(2025, 12, 25), D(2026, 1, 22), None, None]


def test_ledger_date_is_the_written_day(spark):
    assert many(spark, dates.ledger_date, ["2026-04-21T23:59:00-04:00", "2026-04-21", "bad"]) == [
        D(2026, 4, 21), D(2026, 4, 21), None,
    ]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Approved", "approved"), ("approved, then reversed", "declined"), ("successfully refunded", "declined"),
        ("payment pending", "other"), ("on hold / paid", "other"), ("prepaid", "other"), ("unpaid", "declined"),
        ("Aprobada", "approved"), ("Declinada", "declined"), ("", "other"), ("PAID_IN_FULL", "approved"),
    ],
)
def test_status_class(value, raw, expected):
    assert value(status.status_class, raw) == expected


def test_known_currency(spark):
    assert many(spark, status.is_known_currency, ["usd", "DOP", "XYZ"]) == [True, True, False]
    assert len(status.KNOWN_CURRENCIES) == 36


def test_canon_merchant_folds_ascii_only(value):
    assert value(text.canon_merchant, "  CAFÉ  \tÉlan ") == "cafÉ Élan"


def test_tokens_count_bytes(value):
    assert value(text.tokens, "JR-East é a 7 Ωμ x2") == ["jr", "east", "é", "ωμ", "x2"]


def test_token_containment(spark):
    rows = [(["a1", "b1"], ["b1", "c1", "a1"]), (["a1", "a1", "zz"], ["a1", "qq", "rr"]), ([], ["a1"])]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in frame.select(text.token_containment(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, pytest.approx(2 / 3), 0.0]


def test_windows_1252(spark):
    data = bytes([0x80, 0x81, 0x92, 0x97, 0xE9, 0x41])
    frame = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert frame.select(text.decode_windows_1252(F.col("b"))).collect()[0][0] == "€�’—éA"


def test_noise_trim(value):
    clean = "You paid\n\n\n\nx"
    assert value(text.trim_noise, clean) == clean
    noisy = "a<https://t.example/\nx>b[image: logo]\n\n\n\n\nc\nHelp & Contact\nfooter"
    assert value(text.trim_noise, noisy) == "ab\n\nc\n"
    assert value(text.trim_noise, "a [image: open\nrest") == "a "


def test_from_header(spark):
    frame = spark.createDataFrame([("Bank ", "a@b"), (" ", "a@b"), (None, "a@b"), ("x", "")], "n string, a string")
    got = [r[0] for r in frame.select(text.from_header(F.col("n"), F.col("a"))).collect()]
    assert got == ["Bank <a@b>", "<a@b>", "<a@b>", None]


def test_comma_list(value):
    assert value(text.comma_list, " a, b,,c ,") == ["a", "b", "c"]


def test_html_to_text(value):
    html = "<html><head><title>t</title></head><body><script>x<1</script><p>One&nbsp;&amp; two</p><br>three</body>"
    assert value(text.html_to_text, html) == "One & two\nthree"


RECEIPT = (
    "You paid $1,250.00 USD on May 29, 2026\n\nPayPal Credit will receive it\n\nLogged on March 01, 2026\n"
    "Transaction ID\n 9AB12 \n\nDate\nMay 28, 2026\n\nPaid with\nFIRST BANK fx-9999 x-0130\n\nSee x-7777\n"
)


def test_payment_receipt(value):
    got = value(receipts.payment_fields, RECEIPT)
    assert (got["amount"], got["currency"], got["txn_date"]) == (Decimal("1250"), "USD", D(2026, 5, 28))
    assert (got["external_id"], got["source_key"], got["parse_error"]) == ("pp-payment:9AB12", "0130", None)


@pytest.mark.parametrize(
    ("old", "new", "error"),
    [
        ("$1,250.00", "1,250.00", "no amount and currency"),
        (" USD on", " USDT on", "currency rejected"),
        ("Transaction ID\n 9AB12", "Transaction ID\n", "no transaction id"),
        ("x-0130", "x-01301", "no funding last-4"),
        ("Paid with\n", "Paid with\n\n", "no funding last-4"),
    ],
)
def test_payment_receipt_gaps(value, old, new, error):
    assert error in value(receipts.payment_fields, RECEIPT.replace(old, new))["parse_error"]


def test_payment_date_falls_back_to_the_headline_only(value):
    no_label = RECEIPT.replace("Date\nMay 28, 2026", "")
    assert value(receipts.payment_fields, no_label)["txn_date"] == D(2026, 5, 29)
    no_headline = no_label.replace(" on May 29, 2026", "")
    assert value(receipts.payment_fields, no_headline)["txn_date"] is None


def test_quoting_mail_is_no_receipt(value):
    assert value(receipts.is_payment_receipt, "You said: you paid $5 USD") is False
    assert value(receipts.is_payment_receipt, RECEIPT) is True


def test_installments_are_no_purchase(value):
    assert value(receipts.is_purchase, "You made a payment for your Pay in 4 plan. Transaction ID: 1") is False
    assert value(receipts.is_purchase, "Your order is on its way") is False
    assert value(receipts.is_purchase, "You paid $5 to Shop") is True


def test_usd_total_takes_the_first_usable_line(value):
    body = "Total amount of this transaction: $1.23456 USD\nTOTAL AMOUNT OF THIS TRANSACTION: $54.50 USD\n"
    assert value(receipts.usd_transaction_total, body) == Decimal("54.50")
    assert value(receipts.usd_transaction_total, "nothing") is None


WIRE = (
    'pacs.008.001.08\n<CdtTrfTxInf><UETR>u-1</UETR><IntrBkSttlmAmt Ccy="USD">\n'
    "12/1/99-4:5:06   AICMACKB   33\n____\n2,100.00</IntrBkSttlmAmt>"
    "<IntrBkSttlmDt>2026-05-29</IntrBkSttlmDt><Dbtr><Nm>Me</Nm></Dbtr>"
    "<DbtrAcct><Id><Othr><Id>XX12 ABCD 4189</Id></Othr></Id></DbtrAcct>"
    "<CdtrAgt><F><BICFI>abcdus33xxx</BICFI></F></CdtrAgt><CdtrAcct>z</CdtrAcct><Cdtr><Nm> ACME </Nm></Cdtr></CdtTrfTxInf>"
)


def test_wire(value):
    got = value(wires.wire_fields, WIRE)
    assert (got["amount"], got["currency"], got["txn_date"]) == (Decimal(2100), "USD", D(2026, 5, 29))
    assert (got["source_key"], got["dest_key"], got["external_id"]) == ("4189", "ABCDUS33", "swift:u-1")
    assert (got["description"], got["parse_error"]) == ("SWIFT wire to ACME", None)


@pytest.mark.parametrize(
    ("old", "new", "error"),
    [
        ("<UETR>", "<NbOfTxs>2</NbOfTxs><UETR>", "multi-transaction"),
        ("<UETR>u-1", "<CdtTrfTxInf><UETR>u-1", "multi-transaction"),
        ("<UETR>", '<InstdAmt Ccy="DOP">1</InstdAmt><UETR>', "cross-currency"),
        ("2026-05-29<", "29/05/2026<", "settlement date"),
        ("<UETR>u-1", "<UETR> ", "wire identifier"),
        ("<BICFI>abcdus33xxx</BICFI>", "", "creditor agent"),
    ],
)
def test_wire_guards(value, old, new, error):
    assert error in value(wires.wire_fields, WIRE.replace(old, new))["parse_error"]


def test_wire_without_creditor_name(value):
    got = value(wires.wire_fields, WIRE.replace("<Cdtr><Nm> ACME </Nm></Cdtr>", "").replace("33xxx", "33abc"))
    assert got["description"] == "International transfer (ABCDUS33ABC)"


def test_composite_hash_matches_the_formula(spark):
    frame = spark.createDataFrame(
        [("banco_popular", D(2026, 5, 27), Decimal("5130.00"), "JPY", " Shop ", None, " Aprobada", None)],
        "source string, txn_date date, amount decimal(18,4), currency string, merchant string, account_hint string, "
        "status string, external_id string",
    )
    expected = hashlib.sha256(b"banco_popular|2026-05-27|5130|JPY|Shop||aprobada").hexdigest()
    assert frame.select(keys.dedup_key()).collect()[0][0] == expected


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text(max_size=6), st.text(max_size=12) | st.integers(), max_size=4))
def test_balanced_span_survives_prose(spark, doc):
    import json

    from txnrecon.functions.answers import _span

    body = json.dumps(doc, ensure_ascii=False)
    assert _span("Sure: " + body + " } trailing {") == body


def test_salvage_shapes(spark):
    rows = [
        ('{"a": 1}',), ('<think>{x</think>\n```json\n{"a": "}"}\n```',), ("<think>never closed {",), ("plain",),
        ('Here: {"a": {"b": "\\"}"}} done',),
    ]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, answer string")
    got = answers.salvage_answers(frame).orderBy("i").select(F.to_json("doc")).collect()
    assert [r[0] for r in got] == ['{"a":1}', '{"a":"}"}', None, None, '{"a":{"b":"\\"}"}}']
