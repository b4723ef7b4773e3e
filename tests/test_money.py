"""Gates, rates, routing, keys, payloads and corrections."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txnrecon import schema
from txnrecon.operators import dedup, fx, ledger, routing, validate
from txnrecon.sources import ledger as ledger_source
from txnrecon.sources import mappings
from txnrecon.sources import rates as rate_source

DAY = datetime.date(2026, 5, 15)  # a Friday


def rates(spark, *rows):
    return spark.createDataFrame([(f, t, d, Decimal(r), datetime.datetime(2026, 5, 1)) for f, t, d, r in rows], schema.RATES)


def test_as_of_rates(spark):
    table = rates(
        spark, ("EUR", "USD", DAY, "1.10"), ("EUR", "USD", DAY + datetime.timedelta(3), "1.20"), ("GBP", "USD", DAY, "1.30")
    )
    days = [-1, 0, 1, 2, 3, 400]
    facts = spark.createDataFrame(
        [(i, "eur", "USD", DAY + datetime.timedelta(d)) for i, d in enumerate(days)]
        + [(10, "GBP", "USD", DAY + datetime.timedelta(2)), (11, "USD", "usd", DAY), (12, "XXX", "USD", DAY)],
        "i int, f string, t string, d date",
    )
    got = {r.i: (None if r.rate is None else str(r.rate.normalize()), r.defer_reason is None)
           for r in fx.with_rate(facts, table, "f", "t", "d").collect()}
    assert got == {
        0: (None, False), 1: ("1.1", True), 2: ("1.1", True), 3: ("1.1", True), 4: ("1.2", True), 5: ("1.2", True),
        10: ("1.3", True), 11: ("1", True), 12: (None, False),
    }


def test_peso_table_is_inverted_from_the_peso(spark):
    pesos = spark.createDataFrame([("USD", Decimal("57.40")), ("EUR", Decimal("63"))], schema.PESO_RATES)
    facts = spark.createDataFrame([("DOP", "USD", DAY), ("EUR", "DOP", DAY), ("DOP", "GBP", DAY)], "f string, t string, d date")
    got = [r.rate for r in fx.with_rate(facts, rates(spark, ("EUR", "USD", DAY, "1")), "f", "t", "d", pesos).collect()]
    assert sorted(str(g) for g in got) == ["0.017421602787", "63.000000000000", "None"]


def test_conversion_keeps_the_original_as_foreign_leg(spark):
    rows = [(Decimal("100"), "USD", Decimal("0.333335"), "EUR", 2), (Decimal("2.5"), "EUR", Decimal("1"), "eur", 0),
            (Decimal("5"), "USD", Decimal("0.5"), "JPY", 0)]
    frame = spark.createDataFrame(
        rows, "amount decimal(18,4), currency string, rate decimal(18,6), account_currency string, account_decimals int"
    )
    got = [(str(r.booked_amount.normalize()), r.foreign_amount, r.foreign_currency) for r in fx.convert(frame).collect()]
    assert got == [("33.33", Decimal("100.0000"), "USD"), ("2.5", None, None), ("2", Decimal("5.0000"), "USD")]


def test_cache_freshness(spark):
    now = datetime.datetime(2026, 5, 15, 12, 0)
    rows = [
        (DAY - datetime.timedelta(1), datetime.datetime(2020, 1, 1), True),
        (DAY, now - datetime.timedelta(seconds=899), True),
        (DAY, now - datetime.timedelta(seconds=900), False),
        (DAY + datetime.timedelta(1), datetime.datetime(2026, 5, 14), False),
    ]
    frame = spark.createDataFrame(rows, "d date, f timestamp, want boolean")
    for r in frame.select(fx.is_fresh(F.col("d"), F.col("f"), F.lit(now)).alias("got"), "want").collect():
        assert r.got == r.want


def test_stale_keys_use_the_newest_entry(spark):
    now = datetime.datetime(2026, 5, 15, 12, 0)
    cache = spark.createDataFrame(
        [("eur", "usd", DAY, Decimal(1), now - datetime.timedelta(hours=2)), ("EUR", "USD", DAY, Decimal(2), now)], schema.RATES
    )
    needed = spark.createDataFrame(
        [("EUR", "USD", DAY), ("EUR", "USD", DAY), ("GBP", "USD", DAY), ("USD", "USD", DAY)], "from_ccy string, to_ccy string, rate_date date"
    )
    assert [tuple(r) for r in fx.stale_keys(needed, cache, F.lit(now)).collect()] == [("GBP", "USD", DAY)]
    assert fx.latest_rates(cache).collect()[0].rate == 2


def test_ceiling_is_strict_and_missing_rates_defer(spark):
    table = rates(spark, ("KRW", "USD", DAY, "0.00072"), ("EUR", "USD", DAY, "2"))
    frame = spark.createDataFrame(
        [(1, Decimal("100000"), "KRW", DAY), (2, Decimal("50"), "EUR", DAY), (3, Decimal("50.01"), "EUR", DAY),
         (4, Decimal("1"), "GBP", DAY)],
        "i int, amount decimal(18,4), currency string, txn_date date",
    )
    got = {r.i: (r.ceiling_reason, r.defer_reason) for r in validate.usd_ceiling(frame, table, Decimal(100)).collect()}
    assert got[1] == (None, None) and got[2] == (None, None) and got[4] == (None, "rate unavailable")
    assert got[3][0] == "worth USD 100.02, above 100: routed to review"
    assert validate.usd_ceiling(frame, table, None).where("ceiling_reason is not null").count() == 0


def test_gate_order(spark):
    base = dict(status="paid", direction="out", amount=Decimal(1), currency="USD", merchant="m")
    cases = [
        ({}, None), ({"status": "declined", "direction": "in"}, "status_declined"), ({"status": "odd"}, "status_unclear"),
        ({"direction": "in", "amount": Decimal(0)}, "direction_in"), ({"amount": Decimal(0), "currency": "ZZZ"}, "amount_not_positive"),
        ({"currency": "ZZZ", "merchant": ""}, "currency_unknown"), ({"merchant": " "}, "merchant_empty"),
    ]
    frame = spark.createDataFrame(
        [(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)],
        "i int, status string, direction string, amount decimal(18,4), currency string, merchant string",
    )
    got = {r.i: (r.verdict, r.review_reason) for r in validate.gate(frame).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == ("booked", None) if want is None else (got[i][0] == "review" and want in got[i][1])


def test_funding_hints(spark):
    hints = ["Pay in 4", " PAYPAL CREDIT ", "Balance", None, "", "credit card?"]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(hints)], "i int, h string").orderBy("i")
    assert [r[0] for r in frame.select(routing.is_credit_funded(F.col("h"))).collect()] == [True, True, False, False, False, True]


def dims(spark):
    return spark.createDataFrame(
        [("account", "paypal_credit", "10"), ("paypal_funding_last4", "0130", "11"), ("swift_debtor_last4", "0130", "12"),
         ("creditor_bic", "ABCDUS33", "13")],
        schema.DIMS,
    )


def transfer(key, ccy="USD", source="paypal_funding_last4", last4="0130", dest="paypal_credit", dest_key="paypal_credit", amount="5"):
    return (key, Decimal(amount), ccy, DAY, "d", key, source, last4, dest, dest_key, None)


def test_transfers(spark):
    rows = [
        transfer("ok"), transfer("wire", source="swift_debtor_last4", dest="creditor_bic", dest_key="ABCDUS33"),
        transfer("bic", dest="creditor_bic", dest_key="OTHER", last4="9999"), transfer("last4", last4="9999"),
        transfer("big", amount="1000"), transfer("zero", amount="0"), transfer("ccy", ccy="EUR"),
        transfer("norate", ccy="GBP"),
    ]
    frame = spark.createDataFrame(rows, schema.TRANSFERS + ", parse_error string")
    accounts = spark.createDataFrame([(10, "USD", 2), (11, "USD", 2), (12, "USD", 2), (13, "EUR", None)], schema.ACCOUNTS)
    table = rates(spark, ("EUR", "USD", DAY, "1.1"), ("USD", "EUR", DAY, "0.9"))
    out = {r.msg_id: r for r in ledger.book_transfers(frame, dims(spark), accounts, table, Decimal(900)).collect()}
    assert out["ok"].review_reason is None and out["ok"].foreign_amount is None
    assert out["wire"].review_reason is None
    assert (out["wire"].source_account_id, out["wire"].foreign_amount, out["wire"].foreign_currency) == ("12", Decimal("4.5"), "EUR")
    for key, words in {"bic": "destination", "last4": "source account", "big": "routed to review", "zero": "amount_not_positive",
                       "ccy": "does not match"}.items():
        assert words in out[key].review_reason
    assert out["norate"].defer_reason is not None
    paid = ledger.transfer_payload(
        ledger.book_transfers(frame.where("msg_id = 'wire'"), dims(spark), accounts, table)
    ).collect()[0]
    assert (paid.type, paid.amount, paid.foreign_amount, paid.destination_id) == ("transfer", "5", "4.5", "13")


def test_first_use_books(spark):
    rows = [("k", 2, 0), ("k", 1, 1), ("k", 1, 0), ("z", 9, 9)]
    frame = spark.createDataFrame(rows, "external_id string, msg_seq bigint, rec_idx int")
    got = {(r.external_id, r.msg_seq, r.rec_idx): r.is_duplicate for r in dedup.first_wins(frame).collect()}
    assert got == {("k", 2, 0): True, ("k", 1, 1): True, ("k", 1, 0): False, ("z", 9, 9): False}


@pytest.mark.parametrize(
    ("current", "expected", "billed", "want"),
    [
        ("10", "9", "10", "noop"), ("9.5", "9", "10", "changed since"), ("0", "0", "5", "zero"),
        ("100", "100", "125", "corrected"), ("100", "100", "125.01", "exceeds"), ("100", "100", "75", "corrected"),
    ],
)
def test_correction_decision(value, current, expected, billed, want):
    got = value(lambda a, b, c: ledger.correction_decision(a, b, c, Decimal(25)), *map(Decimal, (current, expected, billed)))
    assert want in got


def test_corrections_tag_and_resolve(spark):
    book = spark.createDataFrame(
        [(1, Decimal("10"), ["t"], None, None, 1), (2, Decimal("10"), ["t"], None, None, 2), (3, Decimal("7"), [], None, None, 1)],
        "journal_id bigint, amount decimal(18,4), tags array<string>, foreign_amount decimal(18,4), foreign_currency string, split_count int",
    )
    asks = spark.createDataFrame(
        [(1, Decimal("10"), Decimal("11")), (2, Decimal("10"), Decimal("11"))], "journal_id bigint, booked decimal(18,4), statement_amount decimal(18,4)"
    )
    decided = ledger.corrections(asks, book, Decimal(25))
    got = {r.journal_id: (r.decision, r.new_amount, r.tags) for r in decided.collect()}
    assert got[1] == ("corrected", Decimal(11), ["t", "bp-estimate:10"])
    assert got[2] == ("review: journal has several splits", Decimal(10), ["t"])
    fixed = ledger.resolve(book, decided.withColumn("decided_at", F.current_timestamp()))
    assert {r.journal_id: r.amount for r in fixed.collect()} == {1: 11, 2: 10, 3: 7}


def test_config_maps(spark):
    def parse(text, **kw):
        frame = spark.createDataFrame([("k", text)], "kind string, text string")
        return {r.key: r.value for r in mappings.parse(frame, **kw).collect()}

    assert parse(" 0130:11 ,, 0140 : 12,0130:13") == {"0130": "13", "0140": "12"}
    assert parse("5411:Groceries: all") == {"5411": "Groceries: all"}
    assert parse("abcdus33:1", upper_key=True, digits_only=True) == {"ABCDUS33": "1"}
    for bad in ("0130", ":11", "0130:"):
        with pytest.raises(Exception, match="entry"):
            parse(bad)
    with pytest.raises(Exception, match="numeric"):
        parse("0130:x", digits_only=True)


def test_rate_bodies(spark):
    bodies = spark.createDataFrame(
        [("usd", DAY, datetime.datetime(2026, 5, 15), '{"amount":1,"rates":{"eur":0.92,"JPY":156.123456789}}')],
        "from_ccy string, rate_date date, fetched_at timestamp, body string",
    )
    parsed = rate_source.parse_rates(bodies)
    assert {r.to_ccy: r.rate for r in parsed.collect()} == {"EUR": Decimal("0.92"), "JPY": Decimal("156.123456789")}
    wanted = spark.createDataFrame([("USD", "EUR", DAY), ("USD", "DOP", DAY)], "from_ccy string, to_ccy string, rate_date date")
    assert {r.to_ccy: r.error is None for r in rate_source.wanted_rates(parsed, wanted).collect()} == {"EUR": True, "DOP": False}


def test_bank_table(spark):
    def parse(body):
        return rate_source.parse_peso_table(spark.createDataFrame([(body,)], "body string")).collect()

    rows = parse('{"monedas":{"moneda":[{"descripcion":"usd ","venta":"57.40"},{"descripcion":"EUR","venta":63},{"descripcion":"X","venta":0}]}}')
    assert [(r.currency, str(r.venta.normalize())) for r in rows] == [("USD", "57.4"), ("EUR", "63")]
    with pytest.raises(Exception, match="no usable rates"):
        parse('{"monedas":{"moneda":[{"descripcion":"X","venta":-1}]}}')


def test_ledger_pages_count_what_they_lose(spark):
    page = """{"data":[{"id":"5","attributes":{"transactions":[
      {"date":"2026-04-21T00:00:00-04:00","amount":"-12.500000","currency_code":"usd","description":" M ","external_id":" ","tags":["t"]},
      {"date":"bad","amount":"1","currency_code":"USD","description":"x","tags":["t"]},
      {"date":"2026-04-21","amount":"1","currency_code":"USD","description":"mine","tags":["other"]}]}}]}"""
    rows = ledger_source.journals(ledger_source.splits(spark.createDataFrame([(page,)], "body string")), "t")
    good = rows.where("is_usable").collect()
    assert [(r.journal_id, r.amount, r.currency, r.merchant, r.external_id, r.split_count) for r in good] == [
        ("5", Decimal("12.5"), "USD", "M", None, 3)
    ]
    assert ledger_source.skipped(rows).collect()[0][0] == 1


def test_labelled_dataset(spark, tmp_path):
    from txnrecon.sources import dataset

    (tmp_path / "01.a.txt").write_text("line one\nline two")
    (tmp_path / "01.a.json").write_text('{\n "from": "<a@b>", "kind": "transaction", "amount": "1.50"}')
    (tmp_path / "02.txt").write_text("unpaired")
    (row,) = dataset.load(spark, str(tmp_path)).collect()
    for stem in ("00", "02.b", "02.a"):
        (tmp_path / f"{stem}.txt").write_text("x")
        (tmp_path / f"{stem}.json").write_text("{}")
    assert [r.example for r in dataset.in_order(dataset.load(spark, str(tmp_path))).collect()] == ["00", "01.a", "02.a", "02.b"]
    assert (row.example, row.text, row.from_hdr, row.amount) == ("01.a", "line one\nline two", "<a@b>", "1.50")


def test_small_rates_and_odd_decimals_lose_nothing(spark):
    rows = [
        ("16000000", "0.0000614275", 2, "982.84"),
        ("1000000", "0.00072413", 2, "724.13"),
        ("12.5", "3", 0, "38"),
        ("1.2345", "0.333333333333", 3, "0.411"),
        ("1.0001", "0.123456789012", 8, "0.12346913"),
        ("1234567890123456.7891", "2.5", 4, "3086419725308641.9728"),
    ]
    frame = spark.createDataFrame(rows, "a string, r string, account_decimals int, want string").selectExpr(
        "cast(a as decimal(20,4)) amount", "cast(r as decimal(28,12)) rate", "account_decimals", "want",
        "'IDR' currency", "'USD' account_currency", "cast(null as string) defer_reason",
    )
    for r in fx.convert(frame).collect():
        assert r.booked_amount == Decimal(r.want) and r.defer_reason is None
    odd = fx.convert(frame.withColumn("account_decimals", F.lit(30))).collect()
    assert all(r.booked_amount is None and r.defer_reason == "unsupported account decimals" for r in odd)


def test_a_json_number_keeps_its_scale(spark):
    from txnrecon.functions import answers, numbers

    doc = F.parse_json(F.lit('{"a": 1.00000000001, "b": 1.50, "c": 12}'))
    got = spark.range(1).select(*[numbers.amount_gate(answers.figure_of(doc, k)).cast("string").alias(k) for k in "abc"]).first()
    assert (got.a, got.b, got.c) == (None, "1.5000", "12.0000")


def test_corrections_keep_each_mismatch(spark):
    """Two statements that hit one journal stay two rows; a vanished journal, one without an id and
    one of unknown splits are refused, not dropped."""
    asks = spark.createDataFrame(
        [(1, "j", Decimal(10), Decimal(11)), (2, "j", Decimal(10), Decimal(12)), (3, "gone", Decimal(10), Decimal(11)),
         (4, None, Decimal(10), Decimal(11)), (5, "odd", Decimal(10), Decimal(11)), (6, "two", Decimal(10), Decimal(11))],
        "stmt_id int, journal_id string, booked decimal(18,4), statement_amount decimal(18,4)",
    )
    held = spark.createDataFrame(
        [("j", 1), ("odd", None), ("two", 2), ("two", 2)], "journal_id string, split_count int"
    ).selectExpr(
        "journal_id", "cast(10 as decimal(18,4)) AS amount", "array('t') AS tags",
        "cast(null as decimal(18,4)) AS foreign_amount", "cast(null as string) AS foreign_currency", "split_count",
    )
    rows = ledger.corrections(asks, held, Decimal(25), ("stmt_id",)).collect()
    assert len(rows) == 6
    got = {r.stmt_id: r.decision for r in rows}
    assert got[1] == got[2] == "corrected"
    assert "not found" in got[3] and "no id" in got[4] and "unknown" in got[5] and "several" in got[6]
