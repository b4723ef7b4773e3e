"""Unwrapping, dispatch, answers and the message path."""

import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnrecon import schema
from txnrecon.operators import extract, router, validate
from txnrecon.plans import notifications
from txnrecon.sources import mail

MARK = "---------- Forwarded message ---------\n"
HEAD = MARK + "From: PayPal <Service@PayPal.com>\nDate: x\nSubject: You paid: Shop\nTo: b@e.com\n"


def unwrapped(spark, text, from_hdr="Human <me@home.org>"):
    frame = spark.createDataFrame([("m", text, from_hdr)], "msg_id string, text string, from_hdr string")
    row = extract.unwrap(frame).collect()[0]
    return row.original_sender, row.original_subject, row.body


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (HEAD + "\nYou paid\nFrom: x@y\n", ("service@paypal.com", "You paid: Shop", "You paid\nFrom: x@y\n")),
        ("intro\n" + HEAD + " \t\r\n\nbody", ("service@paypal.com", "You paid: Shop", "\nbody")),
        (MARK + "\nFrom: a@b.c\n\nbody", (None, None, "From: a@b.c\n\nbody")),
        (MARK + "From: nobody here\n\nbody", (None, None, "body")),
        (MARK + "From: first a@b.c rest\nFrom: z@z.z", ("a@b.c", None, "From: first a@b.c rest\nFrom: z@z.z")),
        (MARK + "  from : <<x>\n\nq", (None, None, "q")),
        (MARK + "From: Bank <not-an-address> «N@Popularenlinea.com»\n\nq", ("n@popularenlinea.com", None, "q")),
        ("plain body", ("me@home.org", None, "plain body")),
        (MARK + "From: a@b.c\n\n", ("a@b.c", None, "")),
        (MARK + "From: a@b.c\n", ("a@b.c", None, "From: a@b.c\n")),
        (MARK.strip(), (None, None, "Forwarded message ---------")),
    ],
)
def test_unwrap(spark, text, want):
    got = unwrapped(spark, text)
    if want[0] is None:
        assert got[0] is None
    else:
        assert got == want


def test_unwrap_without_any_sender(spark):
    assert unwrapped(spark, "plain", None)[0] is None
    assert unwrapped(spark, "plain", "no address")[0] is None


def test_statement_class(spark):
    none = []
    pdf = [("b", "Application/PDF", None, 1)]
    named = [("b", None, "Estado.PDF", 1)]
    rows = [
        ("1", "Estado de Cuenta", "x@y", "t", pdf, None), ("2", "Hi", "x@y", "t", pdf, None),
        ("3", "Cuenta: 1", "x@y", "t", none, None), ("4", None, "Hint@bank.com", "t", named, None),
        ("5", None, None, "t", named, None),
    ]
    frame = spark.createDataFrame(rows, schema.MESSAGES)
    got = {r.msg_id: r.s for r in frame.select("msg_id", extract.is_statement("hint@BANK").alias("s")).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": True, "5": False}


def typed(spark, answer, adapter="paypal", body=""):
    frame = spark.createDataFrame([("m", adapter, body, answer)], "msg_id string, adapter string, body string, answer string")
    return extract.records(frame).orderBy("rec_idx").collect()


GOOD = '{"amount": "%s", "currency": "usd", "date": "2026-05-11", "merchant": " Shop "%s}'


def test_records_defaults(spark):
    (row,) = typed(spark, GOOD % ("149.99", ', "external_id": " 7AB ", "direction": "sideways"'))
    assert (row.external_id, row.raw_ref, row.direction, row.status) == ("7AB", "7AB", "out", "")
    assert (row.amount, row.currency, row.merchant, row.source) == (Decimal("149.99"), "USD", "Shop", "paypal")
    assert row.message_error is None and row.skip_reason is None


def test_bank_records_have_no_id_and_take_grouped_amounts(spark):
    (row,) = typed(spark, GOOD % ("5,130.00", ', "external_id": "x", "direction": "in"'), "banco_popular")
    assert (row.external_id, row.direction, row.amount, row.raw_ref) == (None, "out", Decimal(5130), "")
    (bad,) = typed(spark, GOOD % ("5,130.00", ""))
    assert bad.message_error == "amount rejected"


@pytest.mark.parametrize("amount", ['1e3', '-5', '$5', '1.00000', ''])
def test_loose_amounts_fail_closed(spark, amount):
    assert typed(spark, GOOD % (amount, ""))[0].message_error == "amount rejected"


def test_numeric_amounts(spark):
    body = GOOD.replace('"%s"', "%s", 1)
    assert typed(spark, body % ("150.0", ""))[0].amount == Decimal(150)
    assert typed(spark, body % ("true", ""))[0].message_error == "amount rejected"
    assert typed(spark, body % ("-1", ""))[0].message_error == "amount rejected"


def test_one_bad_record_fails_the_message(spark):
    rows = typed(spark, f'[{GOOD % ("1.00", "")}, {{"amount": "x"}}]')
    assert [r.message_error for r in rows] == ["amount rejected"] * 2
    assert extract.usable_records(extract.records(spark.createDataFrame(
        [("m", "paypal", "", f'[{GOOD % ("1.00", "")}, 3]')], "msg_id string, adapter string, body string, answer string"
    ))).count() == 0


def test_kind_other_skips_wallet_mail_only(spark):
    assert typed(spark, '{"kind": "OTHER"}')[0].skip_reason is not None
    assert typed(spark, '[{"kind": "other"}]')[0].skip_reason is None
    assert typed(spark, '{"kind": "other"}', "banco_popular")[0].skip_reason is None


def test_usd_total_overrides_every_record(spark):
    body = "Total amount of this Transaction: $54.50 USD"
    rows = typed(spark, f'[{GOOD % ("1", "")}, {GOOD % ("2", "")}]', body=body)
    assert {(r.amount, r.currency) for r in rows} == {(Decimal("54.5"), "USD")}
    assert typed(spark, GOOD % ("1", ""), "banco_popular", body)[0].amount == 1


def test_reasons_map_to_categories(spark):
    reasons = [validate.NO_FORWARD, validate.NO_SOURCE, validate.DOUBLE_BOOK, validate.INCOMING, "unknown currency: X",
               "no account configured", validate.NOTHING_EXTRACTED, validate.NOTHING_BOOKED, "merchant is empty", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "i int, r string").orderBy("i")
    got = [r[0] for r in frame.select(validate.review_category(F.col("r"))).collect()]
    assert got == ["not_a_forward", "no_adapter", "double_book", "over_ceiling", "currency_mismatch", "no_account",
                   "extraction", "extraction", "other", None]
    assert frame.select(validate.review_category(F.col("r"), True)).collect()[3][0] == "incoming"


def test_disposition_precedence(spark):
    rows = [
        ("a", 0, "review", "r0"), ("a", 1, "booked", None), ("b", 0, "duplicate", None), ("b", 1, "review", "x"),
        ("c", 1, "review", "second"), ("c", 0, "review", "first"), ("d", 0, "skipped", None),
        ("e", 0, "booked", None), ("e", 1, "deferred", None), ("f", 0, "review", None),
    ]
    frame = spark.createDataFrame(rows, "msg_id string, rec_idx int, outcome string, reason string").withColumn("source", F.lit("s"))
    got = {r.msg_id: (r.disposition, r.reason, r.route) for r in router.routed(router.dispositions(frame)).collect()}
    assert got == {
        "a": ("booked", None, "processed"), "b": ("duplicate", None, "processed"), "c": ("review", "first", "review"),
        "d": ("skipped", None, "processed"), "e": ("deferred", None, "deferred"),
        "f": ("review", "message_empty: no record", "review"),
    }


def test_route_tables_and_dry_run(spark, tmp_path):
    frame = spark.createDataFrame([("a", "booked"), ("b", "review")], "msg_id string, disposition string")
    router.write_routed(frame, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    router.write_routed(frame, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("route = 'review'").count() == 1


def test_http_failures(spark):
    frame = spark.createDataFrame([(c,) for c in (500, 599, 408, 429, None, 404, 401, 200)], "c int")
    got = [r[0] for r in frame.select(router.http_failure(F.col("c"))).collect()]
    assert got == ["defer"] * 5 + ["review"] * 3


def test_new_messages_since_a_cursor(spark):
    rows = [("a", 1, 1, True), ("b", 5, 5, True), ("c", 2, 7, True), ("d", 6, 6, False), ("e", 9, 9, True), ("e", 9, 9, True)]
    frame = spark.createDataFrame(rows, "msg_id string, created_seq bigint, updated_seq bigint, in_inbox boolean")
    assert sorted(r.msg_id for r in mail.new_messages(frame, 4).collect()) == ["b", "c", "e"]
    assert sorted(r.msg_id for r in mail.new_messages(frame).collect()) == ["a", "b", "c", "e"]
    assert mail.next_cursor(frame).collect()[0][0] == 9


def test_body_text_falls_back_to_html_and_raw(spark):
    raw = b"Subject: x\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>H\xc3\xa9llo</p>"
    plain = b"Subject: x\r\nContent-Type: text/plain\r\n\r\nplain one"
    rows = [
        ("a", ["one", "two"], None, None), ("b", [" "], "<p>para</p>", None), ("c", [], None, bytearray(raw)),
        ("d", [], None, bytearray(plain)), ("e", [], None, None),
    ]
    frame = spark.createDataFrame(rows, "msg_id string, text_parts array<string>, html string, raw binary")
    got = {r.msg_id: r.text for r in mail.body_text(frame).collect()}
    assert got["a"] == "one\ntwo\n" and got["b"] == "para" and got["c"] == "Héllo" and got["d"].strip() == "plain one"
    assert got["e"] is None


def test_model_sees_the_model_branch_only(spark):
    rows = [
        ("1", 1, HEAD + "\nYou paid $5 USD to Shop\n[image: x]"), ("2", 2, HEAD + "\nYour parcel"), ("3", 3, "hello"),
    ]
    frame = spark.createDataFrame(rows, "msg_id string, msg_seq bigint, text string").withColumn("from_hdr", F.lit("x@y.z"))

    def answer(batch: pd.DataFrame) -> pd.Series:
        return batch["adapter"] + "|" + batch["prompt_body"]

    got = extract.model(extract.dispatch(frame), answer).collect()
    assert [(r.msg_id, r.answer) for r in got] == [("1", "paypal|You paid $5 USD to Shop\n")]
    assert got[0].body.endswith("[image: x]")


def test_message_path_books_a_key_once(spark):
    """The same receipt forwarded twice, and a record restated within one mail."""
    text = HEAD + "\nYou paid 10.00 USD to Shop\nTransaction date May 11, 2026\nTransaction ID: K1\nStatus: approved\nPaid with x\n"
    rows = [("1", 2, text), ("2", 1, text), ("3", 3, text.replace("K1", "K2")), ("4", 4, "nothing")]
    messages = spark.createDataFrame(rows, "msg_id string, msg_seq bigint, text string").withColumn("from_hdr", F.lit("x@y.z"))
    from txnrecon.plans import reading

    dims = spark.createDataFrame([("account", "paypal_balance", "1")], schema.DIMS)
    accounts = spark.createDataFrame([(1, "USD", 2)], schema.ACCOUNTS)
    rates = spark.createDataFrame(
        [("EUR", "USD", datetime.date(2026, 5, 1), Decimal("1.1"), datetime.datetime(2026, 5, 1))], schema.RATES
    )
    booked = spark.createDataFrame([("K2",)], "external_id string")
    dispositions, records, _ = notifications.decide(messages, reading.read_mail, dims, accounts, rates, booked)
    got = {r.msg_id: r.disposition for r in dispositions.collect()}
    assert got == {"1": "duplicate", "2": "booked", "3": "duplicate", "4": "review"}
    assert records.where("outcome = 'booked'").count() == 1
