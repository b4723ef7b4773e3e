"""Domain tables derived from the provided ones.

The provided tables hold no mail and no ledger, so accounts, rates, charges, journals,
messages and statements are derived from their columns. Every row of the source table
takes part; the perturbations that make a reconciler work (a missing, shifted, renamed or
repeated booking) follow the order's priority and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Expressions both engines understand.
CURRENCY_OF_ACCOUNT = (
    "CASE account_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'DOP' END"
)
ORDER_CURRENCY = (
    "CASE prio WHEN '1' THEN 'USD' WHEN '2' THEN 'EUR' WHEN '3' THEN 'GBP' WHEN '4' THEN 'JPY' ELSE 'DOP' END"
)
# Value of one unit in millionths of a dollar.
UNIT_VALUES = {"USD": 1_000_000, "EUR": 1_080_000, "GBP": 1_270_000, "JPY": 6_700, "DOP": 17_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that text is rendered from or read out of, dealt to all tasks first: a table of one
    row group is one task however it is split, and adaptive execution sizes the partitions."""
    return rows.hint("rebalance")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, currency, decimals: about sixty customers share an account."""
    customer = table(spark, sf_dir, "customer")
    ids = customer.select((F.col("c_custkey") % account_count(customer)).alias("account_id")).distinct()
    return ids.select(
        "account_id",
        F.expr(CURRENCY_OF_ACCOUNT).alias("currency"),
        F.expr("CASE account_id % 5 WHEN 3 THEN 0 ELSE 2 END").alias("decimals"),
    )


def account_count(customer: DataFrame):
    return customer.agg(F.greatest(F.lit(1).cast("bigint"), F.expr("count(*) div 60"))).scalar()


def orders(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """One purchase per order: account, merchant, amount, date, priority digit and status. Without
    ``deal`` they stay where the join left them: they are written and read again."""
    part = table(spark, sf_dir, "part")
    parts = part.agg(F.count("*")).scalar()
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_custkey") % account_count(table(spark, sf_dir, "customer"))).alias("account_id"),
        F.substring("o_orderpriority", 1, 1).alias("prio"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        (F.col("o_orderkey") % parts).alias("p_partkey"),
    )
    bought = o.join(part.select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    return dealt(bought) if deal else bought


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday rates between the five currencies, with the time they were fetched."""
    days = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderdate").cast("date").alias("rate_date"))
        .distinct()
        .where(F.weekday("rate_date") < 5)
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("from_ccy"), F.lit(t).alias("to_ccy"), F.lit(fv * 1_000_000 // tv).cast("bigint").alias("micro")
            )
            for f, fv in UNIT_VALUES.items()
            for t, tv in UNIT_VALUES.items()
            if f != t
        ]
    )
    return days.select("rate_date", F.inline(pairs)).select(
        "from_ccy",
        "to_ccy",
        "rate_date",
        F.expr(
            "CAST(CAST(micro + micro * (dayofyear(rate_date) % 10) div 1000 AS DECIMAL(12,0))"
            " * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6))"
        ).alias("rate"),
        F.expr(
            "least(CAST(rate_date AS TIMESTAMP), TIMESTAMP '2000-06-30 00:00:00')"
            " - make_dt_interval(0, 0, dayofyear(rate_date) % 30)"
        ).alias("fetched_at"),
    )


def peso_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pesos-per-unit figure of every other currency."""
    newest = rates(spark, sf_dir).where("to_ccy = 'DOP'").groupBy(F.col("from_ccy").alias("currency"))
    return newest.agg(F.max_by("rate", "rate_date").alias("venta"))


def charges(spark: SparkSession, sf_dir: str, paid: DataFrame | None = None) -> DataFrame:
    """Statement charges: one per order, and a second one at half the amount a day later for
    low-priority partial orders, so that several charges claim one journal. ``paid``: the orders
    of ``orders``, where several views read them and they were written."""
    paid = orders(spark, sf_dir) if paid is None else paid
    base = paid.withColumn("currency", F.expr(CURRENCY_OF_ACCOUNT))
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    first = F.struct(
        (F.col("o_orderkey") * 2).alias("charge_id"),
        key.alias("reference"),
        F.col("amount").alias("amount"),
        F.col("order_date").alias("auth_date"),
    )
    second = F.struct(
        (F.col("o_orderkey") * 2 + 1).alias("charge_id"),
        F.concat(F.lit("9"), key).alias("reference"),
        (F.col("amount") * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(18,2)").alias("amount"),
        F.date_add("order_date", 1).alias("auth_date"),
    )
    twice = (F.col("prio") == "5") & (F.col("status") == "P")
    rows = base.select(
        "account_id", "currency", F.col("p_name").alias("merchant"),
        F.inline(F.when(twice, F.array(first, second)).otherwise(F.array(first))),
    )
    return rows.select("account_id", "charge_id", "reference", "merchant", "amount", "currency", "auth_date")


def journals(spark: SparkSession, sf_dir: str, paid: DataFrame | None = None) -> DataFrame:
    """Booked journals: the orders again, perturbed by priority and status."""
    paid = orders(spark, sf_dir) if paid is None else paid
    base = paid.withColumn("currency", F.expr(CURRENCY_OF_ACCOUNT))
    case = F.concat("prio", "status")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    booked = base.where(case != "1F").select(
        "account_id",
        "o_orderkey",
        case.alias("case"),
        F.when(case == "2F", F.date_add("order_date", 3))
        .when(case == "2P", F.date_add("order_date", 9))
        .otherwise(F.col("order_date"))
        .alias("txn_date"),
        F.when(case == "1P", (F.col("amount") * F.lit(1.03).cast("decimal(3,2)")).cast("decimal(18,2)"))
        .otherwise(F.col("amount"))
        .alias("amount"),
        F.when(case == "3P", "CHF").otherwise(F.col("currency")).alias("currency"),
        F.when(case == "2O", F.concat("p_name", F.lit(" ONLINE")))
        .when(case == "3F", F.concat("p_brand", F.lit(" "), "p_type"))
        .otherwise(F.col("p_name"))
        .alias("merchant"),
        F.when(case == "1O", F.concat(F.lit("bpstmt:"), key))
        .when(F.col("prio") == "4", F.concat(F.lit("tx-"), key))
        .alias("external_id"),
    )
    copies = F.when(F.col("case") == "3O", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = booked.withColumn("_copy", F.explode(copies))
    return rows.select(
        "account_id", (F.col("o_orderkey") * 2 + F.col("_copy")).alias("journal_id"),
        "txn_date", "amount", "currency", "merchant", "external_id",
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias rules: every brand name of the part table stands for the plain goods of its type."""
    part = table(spark, sf_dir, "part")
    per_brand = part.groupBy("p_brand").agg(F.min("p_name").alias("canonical"), F.min("p_partkey").alias("pos"))
    return per_brand.select("pos", F.lower("p_brand").alias("trigger"), "canonical")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration rows: logical accounts, funding cards, wire debtors, creditor codes."""
    ids = accounts(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    per_currency = ids.groupBy("currency").agg(F.min("account_id").cast("string").alias("value"))
    logical = (
        ("USD", "banco_popular_usd"), ("EUR", "paypal_credit"), ("GBP", "paypal_balance"),
        ("JPY", "banco_popular_paying_usd"), ("DOP", "banco_popular_dop"),
    )
    names = F.create_map(*[F.lit(x) for pair in logical for x in pair])
    account_rows = per_currency.select(F.lit("account").alias("kind"), names[F.col("currency")].alias("key"), "value")
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    acct = (F.col("c_custkey") % account_count(customer)).alias("_a")
    # Customers of the household segment have configured no card.
    cards = (
        customer.where("c_mktsegment <> 'HOUSEHOLD'").groupBy(last4.alias("key"))
        .agg(F.min(acct).cast("string").alias("value"))
        .select(F.explode(F.array(F.lit("paypal_funding_last4"), F.lit("swift_debtor_last4"))).alias("kind"), "key", "value")
    )
    nation = table(spark, sf_dir, "nation")
    bics = nation.select(
        F.lit("creditor_bic").alias("kind"),
        bic8("n_nationkey").alias("key"),
        F.col("n_nationkey").cast("string").alias("value"),
    ).where("n_regionkey <> 0")
    return account_rows.unionByName(cards).unionByName(bics)


def bic8(column: str):
    return F.concat(F.lit("BANK"), F.lpad(F.col(column).cast("string"), 2, "0"), F.lit("2A"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message outcomes from the event stream."""
    return outcome_columns(table(spark, sf_dir, "events"))


def outcome_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("string").alias("msg_id"),
        F.element_at(
            F.array(*[F.lit(s) for s in ("paypal", "paypal_payment", "banco_popular", "unknown")]),
            (F.col("user_id") % 4 + 1).cast("int"),
        ).alias("source"),
        F.expr(
            "CASE event_type WHEN 'purchase' THEN 'booked' WHEN 'click' THEN 'duplicate'"
            " WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'deferred' ELSE 'review' END"
        ).alias("disposition"),
        "value",
    )


# --- mail ------------------------------------------------------------------------

# What the mail of an order is: priority digit and status. The mail is rendered here and
# read back by the operators; the oracle works from the order's columns alone.
WALLET, ALERT, PAYMENT, WIRE, OTHER = "1", "2", "3", "4", "5"
_FORWARD = (
    "From: Buyer <buyer@example.com>\nSubject: Fwd: notice\nTo: inbox@example.com\n\n"
    "---------- Forwarded message ---------\nFrom: {sender}\nDate: Mon, 11 May 1998, 19:10\n"
    "Subject: {subject}\nTo: buyer@example.com\n\n"
)
WALLET_BODY = (
    "You paid {amount} {ccy} to {merchant}\n\nTransaction date {day} 04:27:09 PM CET\nTransaction ID: W{key}\n"
        "Status: {state}\nPaid with {funding}\n{total}<https://track.example.com/a?b=c>\n\n\n\n"
        "[image: logo]\nHelp & Contact\nSee our site"
)
ALERT_BODY = (
        "Notificación de Consumo\n\nTarjeta terminada en {card}\n\nMonto | Moneda | Fecha | Comercio | Estatus\n"
        "{prefix}{amount} | {name} | {day} | {merchant} | {state}\n\nGracias"
)
PAYMENT_BODY = (
    "You paid ${amount} USD on {day}\n\n{proof}\n\nTransaction Details\n\nTransaction ID\nP{key}\n\n"
        "Our office is closed on December 26, 2001 and opens the day after\n{funding}"
)
WIRE_BODY = (
        "Confirmación\n<Document xmlns=\"urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08\">\n<NbOfTxs>{n}</NbOfTxs>\n"
        "<CdtTrfTxInf>\n<UETR>{key}</UETR>\n<IntrBkSttlmAmt Ccy=\"USD\">\n"
        "3/2/99-1:02:03 SHEETICMACK7 12\n____\n{amount}</IntrBkSttlmAmt>\n"
        "<IntrBkSttlmDt>{day}</IntrBkSttlmDt>\n<InstdAmt Ccy=\"{instructed}\">{amount}</InstdAmt>\n"
        "<Dbtr><Nm>Sender</Nm></Dbtr><DbtrAcct><Id><Othr><Id>XX00BANK0000{card}</Id></Othr></Id></DbtrAcct>\n"
        "<CdtrAgt><FinInstnId><BICFI>{bic}XXX</BICFI></FinInstnId></CdtrAgt>\n<Cdtr>{creditor}</Cdtr>\n"
        "</CdtTrfTxInf>\n</Document>"
)


def _fill(template: str, **values):
    """A text template as a concatenation of its literals and columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def messages(spark: SparkSession, sf_dir: str, paid: DataFrame | None = None) -> DataFrame:
    """One mail per order."""
    o = orders(spark, sf_dir) if paid is None else dealt(paid)
    case = F.concat("prio", "status")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    amount = F.col("amount").cast("string")
    grouped = F.format_number("amount", 2)
    long_date = F.date_format("order_date", "MMMM d, yyyy")
    card = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    merchant = F.col("p_name")
    even = F.col("account_id") % 2 == 0

    def by_status(paid: str, open_: str, other: str):
        return F.when(F.col("status") == "F", paid).when(F.col("status") == "O", open_).otherwise(other)

    usd_total = (F.col("amount") * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(18,2)").cast("string")
    wallet = _fill(
        _FORWARD.format(sender="PayPal <Service@PayPal.com>", subject="You paid {merchant}")
        + WALLET_BODY,
        merchant=merchant, amount=amount, key=key, day=long_date,
        ccy=by_status("EUR", "USD", "GBP"),
        state=by_status("approved", "pending", "successfully refunded"),
        funding=F.when(even, "Pay in 4").otherwise("PayPal balance"),
        total=F.when(
            F.col("status") == "F", F.concat(F.lit("Total amount of this Transaction: $"), usd_total, F.lit(" USD\n"))
        ).otherwise(F.lit("")),
    )
    alert = _fill(
        ALERT_BODY,
        card=card, prefix=by_status("EUR$", "US$", "RD$"), amount=grouped,
        name=by_status("Euro", "Dólar", "Peso dominicano"), day=F.date_format("order_date", "dd/MM/yyyy"),
        merchant=merchant, state=by_status("Aprobada", "Pendiente", "Declinada"),
    )
    payment = _fill(
        _FORWARD.format(sender="customercare@paypal.com", subject="Receipt for your payment to PayPal Credit")
        + PAYMENT_BODY,
        amount=grouped, day=long_date, key=key,
        proof=by_status("PayPal Credit will receive it soon", "PayPal Credit will receive it soon", "About your dispute"),
        funding=F.when(
            F.col("status") != "O", F.concat(F.lit("Paid with\nFIRST BANK fx-99 x-"), card, F.lit("\n\nThank you"))
        ).otherwise(F.lit("Thank you")),
    )
    wire = _fill(
        WIRE_BODY,
        n=by_status("1", "1", "2"), key=key, amount=grouped, day=F.col("order_date").cast("string"),
        instructed=by_status("USD", "DOP", "USD"), card=card,
        bic=F.concat(F.lit("BANK"), F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0"), F.lit("2A")),
        creditor=F.when(even, F.concat(F.lit("<Nm> "), merchant, F.lit(" </Nm>"))).otherwise(F.lit("")),
    )
    shipping = _fill(
        _FORWARD.format(sender="PayPal <service@paypal.com>", subject="Your order is on its way") + "Parcel {key} left us.",
        key=key,
    )
    broken = F.lit("---------- Forwarded message ---------\nDate: Mon, 11 May 1998\n\nFrom: service@paypal.com\n")
    text = (
        F.when(F.col("prio") == WALLET, wallet)
        .when(F.col("prio") == ALERT, alert)
        .when(F.col("prio") == PAYMENT, payment)
        .when(F.col("prio") == WIRE, wire)
        .when(case == "5F", shipping)
        .when((case == "5O") & even, broken)
        .otherwise(F.lit("Hello"))
    )
    from_hdr = (
        F.when(F.col("prio").isin(ALERT, WIRE), "Banco <Notificaciones@popularenlinea.com>")
        .when((case == "5O") & ~even, "news@example.org")
        .otherwise("Buyer <buyer@example.com>")
    )
    pdf = F.struct(
        F.lit("b1").alias("blob_id"), F.lit("application/PDF").alias("content_type"),
        F.lit("file.pdf").alias("name"), F.lit(10).cast("bigint").alias("size"),
    )
    none = F.array().cast("array<struct<blob_id:string,content_type:string,name:string,size:bigint>>")
    return o.select(
        F.col("o_orderkey").cast("string").alias("msg_id"),
        F.col("o_orderkey").alias("msg_seq"),
        F.when(case == "5P", "Estado de Cuenta").otherwise("Fwd: notice").alias("subject"),
        from_hdr.alias("from_hdr"),
        text.alias("text"),
        F.when(case.isin("5P", "1F"), F.array(pdf)).otherwise(none).alias("attachments"),
        F.col("order_date").cast("timestamp").alias("received_at"),
    )


def booked_keys(spark: SparkSession, sf_dir: str, paid: DataFrame | None = None) -> DataFrame:
    """Ledger keys of wallet receipts that were booked before, those of every seventh account."""
    o = orders(spark, sf_dir) if paid is None else paid
    return o.where((F.col("prio") == WALLET) & (F.col("account_id") % 7 == 0)).select(
        F.concat(F.lit("W"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("external_id")
    )


# --- statements --------------------------------------------------------------------


def _cells(*texts):
    return F.array(*[F.struct(F.lit(float(i)).alias("x"), t.alias("text")) for i, t in enumerate(texts)])


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per conversation: a user turn is a transaction with the whole text as
    its merchant, an assistant turn its continuation; every fourth turn closes a section
    with a balance and opens one in the other currency; a system turn repeats the card row."""
    t = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    cut = F.date_add(F.lit("1996-01-15").cast("date"), (conv % 900).cast("int"))
    cut_text = F.date_format(cut, "dd/MM/yyyy")
    day = F.date_format(F.date_sub(cut, (turn * 7).cast("int")), "dd/MM")
    switched = F.floor((turn + 1) / 4)
    currency = F.when((conv + switched) % 2 == 0, "DOP").otherwise("USD")
    next_currency = F.when((conv + switched) % 2 == 0, "DOP").otherwise("USD")
    closes = (F.col("role") == "assistant") & (turn % 4 == 3)
    size = F.length("text")
    money = F.format_number(size.cast("decimal(18,2)") + F.lit(1000.25).cast("decimal(18,2)"), 2)

    def row(k: int, cells):
        return F.struct(F.lit(k).alias("k"), cells.alias("cells"))

    def title(ccy):
        return _cells(F.concat(F.lit("Visa Prestige "), ccy))

    def card(anterior):
        return _cells(
            F.concat(F.lit("****-****-****-"), F.lpad((conv % 10000).cast("string"), 4, "0")),
            F.lit("500,000.00"), cut_text, anterior,
        )

    opening = F.when(
        turn == 0,
        F.array(row(0, title(F.when(conv % 2 == 0, "DOP").otherwise("USD"))), row(1, card(F.format_number((conv * 10).cast("decimal(18,2)"), 2)))),
    ).otherwise(F.array().cast("array<struct<k:int,cells:array<struct<x:double,text:string>>>>"))
    txn = row(
        2,
        _cells(
            day, day, F.lpad((conv * 1000 + turn).cast("string"), 12, "0"), F.col("text"),
            F.concat(F.when(turn % 4 == 2, "-").otherwise(""), money),
        ),
    )
    follow = row(2, _cells(F.lpad((size % 10000).cast("string"), 4, "0"), F.lpad(turn.cast("string"), 6, "0")))
    figure = F.format_number(size.cast("decimal(18,2)"), 2)
    closing = [
        row(3, _cells(F.lit("MONTO VENCIDO"), F.lit("Balance Total"))),
        row(4, _cells(F.lit("0"), F.lit("0.00"), F.lit("50.00"), F.lit("500.00"), figure)),
        row(5, _cells(F.lit("0"), F.lit("0.00"), F.lit("50.00"), F.lit("9.99"))),
        row(6, title(next_currency)),
        row(7, card(F.format_number((turn * 100).cast("decimal(18,2)"), 2))),
    ]
    body = (
        F.when(F.col("role") == "user", F.array(txn))
        .when(closes, F.array(follow, *closing))
        .when(F.col("role") == "assistant", F.array(follow))
        .otherwise(F.array(row(2, card(F.lit("1.00"))), row(3, _cells(F.lit("Aviso"), F.col("text"), F.lit("x")))))
    )
    rows = t.select("conv_id", "turn", F.explode(F.concat(opening, body)).alias("_r"))
    return rows.select(
        conv.alias("stmt_id"),
        ((turn + 1) * 10 + F.col("_r.k")).alias("row_no"),
        (F.lit(0.0) - turn).alias("y"),
        F.col("_r.cells").alias("cells"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text from order lines: a page per supplier and line number."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("stmt_id"),
        F.col("l_linenumber").alias("page"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("run_no"),
        F.col("l_quantity").alias("x"),
        (F.lit(700.0) - F.dayofyear("l_shipdate") * F.lit(1.3)).alias("y"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"),
    )


# --- scoring -------------------------------------------------------------------------


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples from the rated documents; the merchant is the whole text."""
    d = dealt(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id"))
    real = F.col("quality") == 1

    def when_real(value):
        return F.when(real, value)

    currency = F.when(F.col("lang") == "en", "usd").when(F.col("lang") == "de", " EUR").otherwise("DOP")
    return d.select(
        F.col("doc_id").alias("example"),
        F.when(real, "transaction").otherwise("not_a_transaction").alias("kind"),
        when_real(F.concat(F.lit("$"), F.format_number("n_chars", 2))).alias("amount"),
        when_real(currency).alias("currency"),
        when_real(F.when(F.col("toxic") == 1, "in").otherwise("out")).alias("direction"),
        when_real(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))).alias("date"),
        when_real(F.col("text")).alias("merchant"),
        when_real(F.lit("approved")).alias("status"),
        when_real(
            F.when(
                F.col("toxic") == 0,
                F.when(F.col("lang").isin("en", "de"), "banco_popular_usd").otherwise("banco_popular_dop"),
            )
        ).alias("routed_account"),
        "quality", "toxic", "lang", "n_chars",
    )


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three models said about the examples: ``alpha`` is right on transactions and silent
    otherwise, ``beta`` errs with the text's tone and length, ``gamma`` answers everything a day late."""
    base = labels(spark, sf_dir)
    full = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example"), "text")
    rows = base.join(full, "example").withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("alpha", "beta", "gamma")])))
    m = F.col("model")
    rows = rows.where((F.col("quality") == 1) | (m == "gamma"))
    late = F.when(m == "gamma", 1).otherwise(0)
    return rows.select(
        "model",
        "example",
        F.lit(0).alias("rec_idx"),
        F.lit("banco_popular").alias("source"),
        (F.col("n_chars") + F.when((m == "beta") & (F.col("toxic") == 1), 1).otherwise(0)).cast("decimal(18,4)").alias("amount"),
        F.when(F.col("lang") == "en", "USD").when(F.col("lang") == "de", "EUR").otherwise("DOP").alias("currency"),
        F.when(F.col("toxic") == 1, "in").otherwise("out").alias("direction"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("example") % 300).cast("int") + late).alias("txn_date"),
        F.when(m == "beta", F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.col("text")).alias("merchant"),
        F.lit(None).cast("string").alias("account_hint"),
        F.when((m == "beta") & (F.col("n_chars") % 2 == 1), "Declinada").otherwise("Aprobada").alias("status"),
    )
