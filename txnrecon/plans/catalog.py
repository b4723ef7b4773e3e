"""Query catalogue: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.functions import numbers, status, text
from txnrecon.operators import (
    dedup, extract, fx, ledger, monitor, reconcile, router, routing, score, similarity, statement, validate,
)
from txnrecon.plans import notifications, reading, statements, views
from txnrecon.sources import ledger as ledger_source
from txnrecon.sources import ledger_table
from txnrecon.sources import mappings, rate_cache
from txnrecon.sources import rates as rate_source
from txnrecon.stage import materialize, shared_folder
from txnrecon.streaming import alerts, ingest, late, scan

MAX_USD = Decimal("400000")
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def fx_asof_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order in its account's currency at the nearest earlier rate."""
    paid = views.orders(spark, sf_dir).select(
        "o_orderkey", "account_id", F.expr(views.ORDER_CURRENCY).alias("currency"),
        F.col("order_date").alias("txn_date"), "amount",
    )
    known = fx.account_targets(paid, views.accounts(spark, sf_dir))
    rated = fx.with_rate(known, views.rates(spark, sf_dir), "currency", "account_currency", "txn_date")
    return fx.convert(rated).select(
        "o_orderkey",
        "currency",
        "account_currency",
        "txn_date",
        F.col("rate").cast("decimal(18,6)").alias("rate"),
        F.col("booked_amount").cast("decimal(24,2)").alias("booked_amount"),
        F.col("foreign_amount").cast("decimal(18,2)").alias("foreign_amount"),
        "defer_reason",
    )



# --- scalars ---------------------------------------------------------------------


def amount_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices written in seven ways, read strictly, without commas, and loosely."""
    line = views.dealt(views.table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice"))
    plain = F.col("l_extendedprice").cast("decimal(18,2)")
    written = plain.cast("string")
    forms = [
        written,
        F.format_number(plain, 2),
        F.concat(written, F.lit("000")),
        F.concat(F.lit("-"), written),
        F.concat(written, F.lit("e1")),
        F.concat(F.lit("  "), written, F.lit("\n")),
        F.concat(F.lit("$"), written, F.lit(" USD")),
    ]
    raw = F.element_at(F.array(*forms), F.col("l_linenumber"))
    return line.select(
        *LINE_KEY,
        numbers.amount_gate(raw).alias("amount"),
        numbers.amount_gate(text.strip_thousands_commas(raw)).alias("without_commas"),
        numbers.loose_amount(raw).alias("loose"),
        numbers.decimal_text(numbers.amount_gate(raw)).alias("shown"),
    )


# Written statuses, one per priority and order status.
STATUS_TEXTS = {
    "1F": "Approved", "1O": " PENDING ", "1P": "successfully refunded",
    "2F": "completed!", "2O": "en proceso", "2P": "Pre-Paid / unpaid",
    "3F": "payment_sent", "3O": "on hold, paid", "3P": "approved-then-reversed",
    "4F": "Aprobada", "4O": "Pendiente", "4P": "RECHAZADA",
    "5F": "posted", "5O": "", "5P": "prepaid",
}


def _status_text() -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in STATUS_TEXTS.items() for x in pair])
    return mapping[F.concat("prio", "status")]


def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status class of the orders' written statuses and of every whole document."""
    written = views.orders(spark, sf_dir).select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), _status_text().alias("said")
    )
    documents = views.dealt(views.table(spark, sf_dir, "documents")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("said")
    )
    return written.unionByName(documents).select(
        "kind",
        "id",
        status.status_class("said").alias("status_class"),
        F.md5(status.normalize_status("said")).alias("normalized_md5"),
    )


def merchant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form and token count of every whole document."""
    documents = views.table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        F.md5(text.canon_merchant("text")).alias("canon_md5"),
        F.size(text.tokens("text")).alias("n_tokens"),
    )


def noise_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link, caption and footer removal over every whole page."""
    pages = views.dealt(views.table(spark, sf_dir, "pages"))
    body = F.concat(
        F.lit("You paid\n\n\n\n<"), "url", F.lit(">\n[image: logo\nof us]\n\n"), F.replace("html", F.lit("<p>"), F.lit("<https://p>\n\n\n")),
        F.lit("\nHelp & Contact <https://end"),
    )
    whole = F.when(F.contains("url", F.lit("?")), body).otherwise(F.col("html"))
    trimmed = text.trim_noise(whole)
    return pages.select("page_id", F.md5(trimmed).alias("trimmed_md5"), F.length(trimmed).alias("trimmed_chars"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every whole page."""
    plain = text.html_to_text("html")
    return views.dealt(views.table(spark, sf_dir, "pages")).select(
        "page_id", F.md5(plain).alias("text_md5"), F.length(plain).alias("chars")
    )


def win1252_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded as Windows-1252, with letters and digits for the bytes 80 to 9F."""
    documents = views.table(spark, sf_dir, "documents")
    latin = F.regexp_replace("text", "[^\\x00-\\x7F\\u00A0-\\u00FF]", "?")
    high = "".join(chr(code) for code in range(0x80, 0xA0))
    bytes_of = F.encode(F.translate(latin, "abcdefghijklmnopqrstuvwxyz012345", high), "ISO-8859-1")
    decoded = text.decode_windows_1252(bytes_of)
    return documents.select("doc_id", F.md5(decoded).alias("decoded_md5"))


# --- gates -----------------------------------------------------------------------


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical record per order, with a different flaw per case."""
    case = F.concat("prio", "status")
    return views.orders(spark, sf_dir).select(
        "o_orderkey",
        "account_id",
        F.when(F.col("prio").isin("1", "3"), "paypal").otherwise("banco_popular").alias("source"),
        _status_text().alias("status"),
        F.when(case == "2F", "in").otherwise("out").alias("direction"),
        F.when(case == "3F", F.lit(0)).otherwise(F.col("amount")).cast(numbers.AMOUNT).alias("amount"),
        F.when(case == "4F", "XXX").otherwise(F.expr(views.ORDER_CURRENCY)).alias("currency"),
        F.when((case == "5F") & (F.col("account_id") % 2 == 0), " ").otherwise(F.col("p_name")).alias("merchant"),
        F.when(F.col("account_id") % 3 == 0, "Pay in 4").when(F.col("account_id") % 3 == 1, "VISA").alias("account_hint"),
        F.col("order_date").alias("txn_date"),
    )


def validate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.gate(order_records(spark, sf_dir)).select(
        "o_orderkey", "verdict", "review_reason", "review_category"
    )


def transfer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    transfers = order_records(spark, sf_dir).select(
        "o_orderkey", "amount", "currency",
        F.col("merchant").alias("description"),
        F.when(F.col("status") == "", " ").otherwise(F.col("o_orderkey").cast("string")).alias("external_id"),
    )
    return validate.gate_transfers(transfers).select("o_orderkey", "verdict", "review_reason")


REASONS = (
    *(f"case {k}: {words.upper() if k % 2 else words}." for k, (words, _) in enumerate(validate.TRIGGERS)),
    "unreadable",
    validate.INCOMING,
)
HTTP_CODES = (500, 503, 408, 429, 404, 422, None)


def review_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of each event's reason, the split variant, and the fate of its HTTP status."""
    events = views.table(spark, sf_dir, "events")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("user_id") % len(REASONS) + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(c).cast("int") for c in HTTP_CODES]), (F.col("event_id") % len(HTTP_CODES) + 1).cast("int"))
    return events.select(
        "event_id",
        validate.review_category(reason).alias("category"),
        validate.review_category(reason, split_incoming=True).alias("split_category"),
        router.http_failure(code).alias("http_fate"),
    )


def usd_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir)
    checked = validate.usd_ceiling(records, views.rates(spark, sf_dir), MAX_USD)
    return checked.select("o_orderkey", "usd_equivalent", "ceiling_reason", "defer_reason")


def dop_inverse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion into and out of the peso at the bank's selling price."""
    paid = order_records(spark, sf_dir).withColumn(
        "to_ccy", F.when(F.col("currency") == "DOP", "USD").otherwise("DOP")
    )
    rated = fx.with_rate(
        paid, views.rates(spark, sf_dir), "currency", "to_ccy", "txn_date", views.peso_rates(spark, sf_dir)
    )
    return rated.select("o_orderkey", "currency", "to_ccy", F.round("rate", 6).cast("decimal(18,6)").alias("rate"))


def account_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.accounts(order_records(spark, sf_dir).drop("account_id"), views.dims(spark, sf_dir))
    return routed.select("o_orderkey", "routed_account", F.col("account_id").alias("routed_id"), "route_reason")


def transfer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of statement payments, one per order."""
    payments = order_records(spark, sf_dir).select("o_orderkey", "currency", "amount")
    return routing.statement_transfer_accounts(payments, views.dims(spark, sf_dir)).select(
        "o_orderkey", "source_account_id", "dest_account_id", "route_reason"
    )


# --- keys --------------------------------------------------------------------------


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order line; lines of an order share their own identifier."""
    line = views.table(spark, sf_dir, "lineitem")
    own = F.concat(F.lit(" T"), F.col("l_orderkey").cast("string"), F.lit("\t"))
    return line.select(
        *LINE_KEY,
        F.lit("banco_popular").alias("source"),
        F.col("l_shipdate").cast("date").alias("txn_date"),
        F.col("l_extendedprice").cast(numbers.AMOUNT).alias("amount"),
        F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("currency"),
        F.concat(F.lit("  Shop "), F.col("l_suppkey").cast("string")).alias("merchant"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string")).alias("account_hint"),
        F.lit(" Posted").alias("status"),
        F.when(F.col("l_returnflag") == "A", own).when(F.col("l_returnflag") == "N", F.lit(" ")).alias("external_id"),
    )


def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.key(line_records(spark, sf_dir)).select(*LINE_KEY, "external_id")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First use of each order's key books, the rest and those of the ledger are duplicates."""
    records = line_records(spark, sf_dir).select(
        *LINE_KEY,
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("external_id"),
        F.col("l_partkey").alias("msg_seq"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("rec_idx"),
    )
    done = views.orders(spark, sf_dir).where("status = 'F'").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("external_id")
    )
    ranked = dedup.first_wins(records)
    fresh, known = ledger.split_new(ranked, done)
    fresh = fresh.withColumn("outcome", F.when(F.col("is_duplicate"), "duplicate").otherwise("booked"))
    known = known.withColumn("outcome", F.lit("duplicate"))
    return fresh.unionByName(known).select(*LINE_KEY, "outcome")


# --- mail --------------------------------------------------------------------------


def unwrap_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    unwrapped = extract.unwrap(views.messages(spark, sf_dir))
    return unwrapped.select(
        "msg_id", "original_sender", "original_subject", F.md5("body").alias("body_md5")
    )


def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.dispatch(views.messages(spark, sf_dir)).select("msg_id", "adapter", "branch", "branch_reason")


def _fixed_format(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    transfers = extract.deterministic(extract.dispatch(views.messages(spark, sf_dir)))
    return transfers.where(F.col("adapter") == adapter).drop("adapter", "msg_seq")


def receipt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_format(spark, sf_dir, "paypal_payment")


def wire_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_format(spark, sf_dir, "banco_popular")


def model_json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in every shape models give, one per order, read into typed records."""
    o = views.orders(spark, sf_dir)
    case = F.concat("prio", "status")
    amount = F.col("amount").cast("string")
    obj = F.concat(
        F.lit('{"external_id": " E'), F.col("o_orderkey").cast("string"), F.lit('", "amount": "'), amount,
        F.lit('", "currency": "usd", "direction": "IN ", "date": "'), F.date_format("order_date", "MMM d, yyyy"),
        F.lit('", "merchant": "Corner } '), "p_name", F.lit('", "status": "Approved", "account_hint": 7}'),
    )
    numeric = F.concat(
        F.lit('{"amount": '), amount, F.lit(', "currency": "EUR", "date": "'), F.date_format("order_date", "d/M/yyyy"),
        F.lit('", "merchant": "'), "p_name", F.lit('", "status": "Aprobada", "raw_ref": "r"}'),
    )
    grouped = F.concat(
        F.lit('{"amount": "'), F.format_number("amount", 2), F.lit('", "currency": "DOP", "date": "'),
        F.col("order_date").cast("string"), F.lit('", "merchant": "'), "p_name", F.lit('"}'),
    )
    no_merchant = F.lit('{"amount": "1.00", "currency": "USD", "date": "2020-01-01", "merchant": " "}')
    answer = (
        F.when(case == "1F", obj)
        .when(case == "1O", F.concat(F.lit("["), obj, F.lit(", "), obj, F.lit("]")))
        .when(case == "1P", F.concat(F.lit("<think>{no}</think>\n```json\n"), obj, F.lit("\n```\nHope it helps }")))
        .when(case == "2F", numeric)
        .when(case == "2O", F.concat(F.lit('{"transactions": ['), numeric, F.lit(", "), grouped, F.lit("]}")))
        .when(case == "2P", grouped)
        .when(case == "3F", F.lit('{"kind": " Other ", "amount": ""}'))
        .when(case == "3O", F.concat(F.lit("["), obj, F.lit(", "), no_merchant, F.lit("]")))
        .when(case == "3P", F.lit("I could not find a transaction."))
        .when(case == "4F", F.lit('{"transactions": []}'))
        .when(case == "4O", F.lit('"just text"'))
        .when(case == "4P", F.concat(F.lit("["), obj, F.lit(", 5]")))
        .when(case == "5F", F.concat(F.lit("Sure! "), obj))
        .when(case == "5O", F.replace(obj, F.lit('"usd"'), F.lit('"US"')))
        .otherwise(F.replace(obj, amount, F.concat(amount, F.lit("e2"))))
    )
    answered = o.select(
        F.col("o_orderkey").cast("string").alias("msg_id"),
        F.when(F.col("prio") == "2", "banco_popular").otherwise("paypal").alias("adapter"),
        F.when(case == "5F", F.concat(F.lit("x\nTotal amount of this Transaction: $"), amount, F.lit(" USD"))).otherwise(F.lit("")).alias("body"),
        answer.alias("answer"),
    )
    return extract.records(answered).drop("adapter")


def _decided(spark: SparkSession, sf_dir: str):
    paid = materialize(views.orders(spark, sf_dir, deal=False))
    return notifications.decide(
        views.messages(spark, sf_dir, paid),
        reading.read_mail,
        views.dims(spark, sf_dir),
        views.accounts(spark, sf_dir),
        views.rates(spark, sf_dir),
        views.booked_keys(spark, sf_dir, paid),
        views.journals(spark, sf_dir, paid),
        None,
        MAX_USD,
    )


def message_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail from its text to its disposition."""
    dispositions, _, _ = _decided(spark, sf_dir)
    return dispositions.select(
        "msg_id", "source", "disposition", validate.review_category(F.col("reason")).alias("category")
    )


# --- reconciliation ------------------------------------------------------------------


def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's label brought to its canonical merchant by the alias rules."""
    part = views.dealt(views.table(spark, sf_dir, "part"))
    label = F.concat(F.lit("  Order "), "p_brand", F.lit("  "), "p_type")
    other = F.concat(F.upper("p_name"), F.lit("\t"), "p_type")
    named = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, label).otherwise(other).alias("merchant"))
    return similarity.canonical(named, "merchant", views.aliases(spark, sf_dir), "canonical").select(
        "p_partkey", "canonical"
    )


def merchant_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the label of the part seven keys on, the last against the first."""
    part = views.table(spark, sf_dir, "part")
    parts = part.agg(F.count("*")).scalar()
    own = part.select("p_partkey", F.col("p_name").alias("name_a"))
    other = part.select(
        F.pmod(F.col("p_partkey") - 7, parts).alias("p_partkey"),
        F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, F.lower("p_type"))).alias("name_b"),
    )
    pairs = own.join(other, "p_partkey")
    scored = similarity.score_pairs(pairs)
    return pairs.join(scored, ["name_a", "name_b"]).select("p_partkey", F.round("score", 9).alias("score"))


def _asked(spark: SparkSession, sf_dir: str):
    paid = materialize(views.orders(spark, sf_dir, deal=False))
    journals = views.journals(spark, sf_dir, paid)
    asked = reconcile.intents(views.charges(spark, sf_dir, paid), journals)
    # Intents are read several times over when claims are resolved, which looks at no name or score.
    return materialize(asked.drop("merchant", "canon", "auth_date", "best_score", "second_score")), journals


def recon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each charge asks for, with its best and second best journal."""
    paid = materialize(views.orders(spark, sf_dir, deal=False))
    asked = reconcile.intents(views.charges(spark, sf_dir, paid), views.journals(spark, sf_dir, paid))
    return asked.select(
        "account_id", "charge_id", "intent", "n_plausible", "best_journal",
        F.round("best_score", 9).alias("best_score"), F.round("second_score", 9).alias("second_score"),
    )


def recon_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, journals = _asked(spark, sf_dir)
    return reconcile.resolve(asked, journals).select(
        "account_id", "charge_id", "reference", "outcome", "journal_id", "booked", "reason"
    )


def recon_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, journals = _asked(spark, sf_dir)
    left = reconcile.unmatched(journals, reconcile.resolve(asked, journals))
    return left.select("account_id", "journal_id", "txn_date", "amount", "currency", "merchant")


def double_book_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement booking near every order's purchase, if any."""
    records = views.orders(spark, sf_dir).select(
        "o_orderkey", "account_id", F.col("order_date").alias("txn_date"), F.upper("p_name").alias("merchant")
    )
    probed = ledger.double_book(records, views.journals(spark, sf_dir))
    return probed.select("o_orderkey", "statement_journal_id")


def amount_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every journal whose amount differs from its charge's, against a ledger in
    which some journals moved since."""
    journals = views.journals(spark, sf_dir)
    charges = views.charges(spark, sf_dir).select(
        "account_id", F.col("charge_id").alias("journal_id"), F.col("amount").alias("statement_amount")
    )
    moved = F.col("account_id") % 5 == 1
    pct = F.when(F.col("account_id") % 5 == 2, F.lit(1.30)).otherwise(F.lit(1.00)).cast("decimal(3,2)")
    mismatches = (
        journals.join(charges, ["account_id", "journal_id"])
        .select("journal_id", "account_id", F.col("amount").alias("booked"), "statement_amount")
        .withColumn("statement_amount", (F.col("statement_amount") * pct).cast("decimal(18,2)"))
    )
    fresh = journals.select(
        "journal_id",
        F.when(moved, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"),
        F.array(F.lit("txnrecon")).alias("tags"),
        F.lit(None).cast("decimal(18,4)").alias("foreign_amount"),
        F.lit(None).cast("string").alias("foreign_currency"),
        F.when(F.col("account_id") % 5 == 3, 2).otherwise(1).alias("split_count"),
    )
    decided = ledger.corrections(mismatches, fresh, Decimal("25"))
    return decided.select(
        "journal_id", "decision", F.col("new_amount").cast("decimal(18,2)").alias("new_amount"),
        F.array_join("tags", ",").alias("tags"),
    )


def ledger_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the ledger takes it."""
    records = order_records(spark, sf_dir).withColumn(
        "external_id", F.col("o_orderkey").cast("string")
    ).withColumn("mcc", F.lpad((F.col("account_id") % 10000).cast("string"), 4, "0"))
    codes = views.table(spark, sf_dir, "nation").select(
        F.lit("mcc_category").alias("kind"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("key"),
        F.col("n_name").alias("value"),
    ).where("n_regionkey <> 1")
    known = fx.account_targets(routing.categories(records, codes), views.accounts(spark, sf_dir))
    rated = fx.with_rate(known, views.rates(spark, sf_dir), "currency", "account_currency", "txn_date")
    return ledger.payload(fx.convert(rated)).withColumn("tags", F.array_join("tags", ","))


def transfer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a transfer from its account to the next one: the source leg as it is, the
    other leg estimated where the next account has another currency."""
    accounts = views.accounts(spark, sf_dir)
    following = (F.col("account_id") + 1) % accounts.agg(F.count("*")).scalar()
    moved = views.orders(spark, sf_dir).select(
        F.col("account_id").alias("source_account_id"), following.alias("account_id"),
        F.expr(views.CURRENCY_OF_ACCOUNT).alias("currency"), F.col("order_date").alias("txn_date"), "amount",
        F.col("p_name").alias("description"), F.col("o_orderkey").cast("string").alias("external_id"),
    )
    known = fx.account_targets(moved, accounts)
    legs = fx.convert(fx.with_rate(known, views.rates(spark, sf_dir), "currency", "account_currency", "txn_date"))
    differs = F.col("foreign_currency").isNotNull()
    estimated = legs.withColumns(
        {
            "foreign_amount": F.when(differs, F.col("booked_amount")),
            "foreign_currency": F.when(differs, F.col("account_currency")),
            "dest_account_id": F.col("account_id"),
        }
    )
    return ledger.transfer_payload(estimated).withColumn("tags", F.array_join("tags", ","))


# --- loose input -----------------------------------------------------------------------


def stale_rate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate keys the orders need and no fresh cache entry serves."""
    known = fx.account_targets(
        views.orders(spark, sf_dir).withColumn("from_ccy", F.expr(views.ORDER_CURRENCY)), views.accounts(spark, sf_dir)
    )
    needed = known.select("from_ccy", F.col("account_currency").alias("to_ccy"), F.col("order_date").alias("rate_date"))
    now = F.lit("2000-06-30 00:10:00").cast("timestamp")
    return fx.stale_keys(needed, views.rates(spark, sf_dir), now)


def rates_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate bodies, one per source currency and day, read back into rate rows."""
    rates = views.rates(spark, sf_dir)
    pairs = F.collect_list(F.struct(F.lower("to_ccy").alias("k"), F.col("rate").cast("string").alias("v")))
    bodies = rates.groupBy("from_ccy", "rate_date").agg(F.map_from_entries(F.sort_array(pairs)).alias("m"))
    body = F.concat(F.lit('{"amount":1.0,"rates":'), F.regexp_replace(F.to_json("m"), r'"([0-9.]+)"', "$1"), F.lit("}"))
    sent = bodies.select("from_ccy", "rate_date", F.current_timestamp().alias("fetched_at"), body.alias("body"))
    return rate_source.parse_rates(sent).select("from_ccy", "to_ccy", "rate_date", F.col("rate").cast("decimal(18,6)").alias("rate"))


def peso_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bank tables with numeric, textual and zero prices, read into rows."""
    day = views.rates(spark, sf_dir).where("to_ccy = 'DOP'").groupBy("rate_date").agg(
        F.max(F.when(F.col("from_ccy") == "USD", F.col("rate"))).alias("usd"),
        F.max(F.when(F.col("from_ccy") == "EUR", F.col("rate"))).alias("eur"),
    )
    body = F.concat(
        F.lit('{"monedas":{"moneda":[{"descripcion":" usd ","compra":1,"venta":'), F.col("usd").cast("string"),
        F.lit('},{"descripcion":"EUR","compra":1,"venta":"'), F.col("eur").cast("string"),
        F.lit('"},{"descripcion":"GBP","compra":0,"venta":0}]}}'),
    )
    parsed = rate_source.parse_peso_table(day.select("rate_date", body.alias("body")))
    return parsed.withColumn("venta", F.col("venta").cast("decimal(18,6)"))


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of at most a hundred journals read back into journals; amounts are
    signed, dates carry zones, and rows of other tags must not survive."""
    j = views.journals(spark, sf_dir)
    split = F.struct(
        F.col("journal_id").cast("string").alias("transaction_journal_id"),
        F.concat(F.col("txn_date").cast("string"), F.lit("T23:30:00-04:00")).alias("date"),
        F.concat(F.lit("-"), F.col("amount").cast("string"), F.lit("0000000000")).alias("amount"),
        F.when(F.col("currency") == "CHF", "CHFX").otherwise(F.lower("currency")).alias("currency_code"),
        F.concat(F.lit(" "), "merchant").alias("description"),
        F.coalesce("external_id", F.lit(" ")).alias("external_id"),
        F.when(F.col("account_id") % 4 == 3, F.array(F.lit("manual"))).otherwise(
            F.array(F.lit("x"), F.lit("txnrecon"))
        ).alias("tags"),
    )
    group = F.struct(
        F.col("journal_id").cast("string").alias("id"), F.struct(F.array(split).alias("transactions")).alias("attributes")
    )
    page_no = F.floor(F.col("journal_id") / 100).alias("page_no")
    pages = j.groupBy("account_id", page_no).agg(F.collect_list(group).alias("data"))
    bodies = pages.select("account_id", F.to_json(F.struct("data")).alias("body"))
    return ledger_source.journals(ledger_source.splits(bodies), "txnrecon").select(
        "account_id", F.col("journal_id").cast("bigint").alias("journal_id"), "split_count", "txn_date", "amount",
        "currency", "merchant", "external_id", "is_usable",
    )


def ledger_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of every account's last thirty days, from a ledger kept by month."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}/ledger"
    journals = views.journals(spark, sf_dir)
    ledger_table.write(journals, path)
    newest = views.orders(spark, sf_dir).groupBy("account_id").agg(F.max("order_date").alias("until"))
    asked = materialize(newest.select("account_id", F.date_sub("until", 30).alias("since"), "until"))
    return ledger_table.within(ledger_table.read(spark, path, journals.schema), asked)


def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule listings, one page per brand, read into alias rows."""
    part = views.table(spark, sf_dir, "part")
    rule = F.struct(
        F.struct(
            F.array(
                F.struct(F.lit("amount_more").alias("type"), F.lit("1").alias("value")),
                F.struct(F.lit("description_contains").alias("type"), F.concat(F.lit(" "), F.upper("p_name")).alias("value")),
                F.struct(F.lit("description_is").alias("type"), F.lit("no").alias("value")),
            ).alias("triggers"),
            F.array(
                F.struct(
                    F.when(F.col("p_size") > 40, "set_category").otherwise("set_destination_account").alias("type"),
                    F.when(F.col("p_size") < 5, " ").otherwise(F.col("p_type")).alias("value"),
                )
            ).alias("actions"),
        ).alias("attributes")
    )
    pages = part.select(F.col("p_partkey").alias("page_no"), F.to_json(F.struct(F.array(rule).alias("data"))).alias("body"))
    rules = ledger_source.alias_rules(pages)
    return rules.select((F.col("pos") / (1 << 32)).cast("bigint").alias("p_partkey"), "trigger", "canonical")


def kv_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration text, one per fifty customers, read into dimension rows. A repeated key
    keeps its last value."""
    entry = F.concat(F.lit(" "), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"), F.lit(" : "), "c_name")
    ordered = F.sort_array(F.collect_list(F.struct("c_custkey", entry.alias("e"))))
    fifty = F.floor(F.col("c_custkey") / 50).cast("string").alias("kind")
    texts = views.table(spark, sf_dir, "customer").groupBy(fifty).agg(
        F.array_join(F.transform(ordered, lambda r: r["e"]), ",, ").alias("text")
    )
    return mappings.parse(texts)


# --- statements ----------------------------------------------------------------------


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.contextual(views.statement_rows(spark, sf_dir))


def statement_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of every statement with their section, inferred dates and codes."""
    txns = statement.transactions(_context(spark, sf_dir))
    return txns.withColumn("merchant_md5", F.md5("merchant")).drop("merchant")


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every statement with their closing-balance check."""
    context = _context(spark, sf_dir)
    return statement.balance(statement.sections(context), statement.transactions(context))


def row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed rows of every page."""
    rows = statement.group_rows(views.runs(spark, sf_dir))
    return rows.select(
        "stmt_id", "page", "row_no", F.round("y", 6).alias("y"), F.size("cells").alias("n_cells"),
        F.md5(text.join_cells(F.col("cells"))).alias("text_md5"),
    )


def statement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement reconciled against the ledger of its card accounts."""
    return statements.report(
        views.statement_rows(spark, sf_dir),
        views.dims(spark, sf_dir),
        views.journals(spark, sf_dir),
        views.rates(spark, sf_dir),
        max_usd=MAX_USD,
        autocorrect_pct=Decimal("25"),
    )


# --- scoring ---------------------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = views.produced(spark, sf_dir)
    models = made.select("model").distinct()
    projected = score.project(score.project_labels(views.labels(spark, sf_dir)), models, score.project_records(made))
    return score.fields(projected)


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = score.matrix(score.tally(_scores(spark, sf_dir)))
    return matrix.select("model", *[F.round(c, 9).alias(c.lower()) for c in matrix.columns[1:]])


# --- monitoring --------------------------------------------------------------------------


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome events with the free-form reason left out."""
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("msg_id").cast("bigint") % len(REASONS) + 1).cast("int"))
    sent = monitor.events(views.outcomes(spark, sf_dir).withColumn("reason", reason))
    return sent.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema]
    )


def outcome_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(monitor.rates(views.outcomes(spark, sf_dir)))


def review_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of the last hour at every five minutes."""
    reviews = monitor.rates(views.outcomes(spark, sf_dir)).where("disposition = 'review'")
    return _ntz(monitor.sliding_sum(reviews, []))


def last_value_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest value per source in the last three hours, every five minutes."""
    samples = views.outcomes(spark, sf_dir).withColumn("event_id", F.col("msg_id").cast("bigint"))
    return _ntz(monitor.last_value(samples, "value", ["source"], tie="event_id"))


def last_value_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest value per source in the last twelve hours, every five minutes."""
    return _held(spark, sf_dir, "12 hours")


def last_value_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest value per source in the last fourteen days, every five minutes."""
    return _held(spark, sf_dir, "14 days")


def _held(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    samples = views.outcomes(spark, sf_dir).withColumn("event_id", F.col("msg_id").cast("bigint"))
    return _ntz(monitor.held_value(samples, "value", ["source"], window, tie="event_id"))


def sustained_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least six hours with more than five reviews in every two hours."""
    per_step = monitor.review_rate(monitor.rates(views.outcomes(spark, sf_dir), "2 hours"))
    hot = F.col("n") > monitor.REVIEW_RATE_LIMIT
    return _ntz(monitor.sustained(per_step, hot, hold="6 hours", step="2 hours"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one run over all outcomes and statements."""
    turns = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stmt_id"),
        F.when(F.col("role") == "user", "booked_new").when(F.col("role") == "assistant", "reconciled")
        .otherwise("unmatched_booked").alias("outcome"),
    )
    context = _context(spark, sf_dir)
    balances = statement.balance(statement.sections(context), statement.transactions(context))
    return monitor.run_summary(views.outcomes(spark, sf_dir), statement.report(turns, balances))


# --- streams -----------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table as a stream that ends when it has been read."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def outcome_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rates computed by the streaming plan; the newest count of a window is its count."""
    root = f"{shared_folder(spark)}/{uuid.uuid4()}"
    events = views.outcome_columns(_stream(spark, sf_dir, "events"))
    query = (
        alerts.outcome_rates(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/_checkpoint")
        .foreachBatch(lambda batch, epoch: ingest.write_epoch(batch, f"{root}/rates", epoch))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counts = spark.read.parquet(f"{root}/rates").groupBy("window_start", "source", "disposition")
    return _ntz(counts.agg(F.max("n").alias("n")))


def book_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a message of its order's key, booked by the streaming ingest."""
    root = f"{shared_folder(spark)}/{uuid.uuid4()}"
    line = _stream(spark, sf_dir, "lineitem")
    message = line.select(
        F.concat_ws("/", *LINE_KEY).alias("msg_id"),
        F.col("l_partkey").alias("msg_seq"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("rec_idx"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("external_id"),
        F.col("l_returnflag").alias("flag"),
    )

    def decide(messages: DataFrame) -> DataFrame:
        outcome = F.when(F.col("flag") == "R", "review").otherwise("open")
        reason = F.when(F.col("flag") == "R", "returned")
        return messages.select(
            "msg_id", "msg_seq", "rec_idx", "external_id", outcome.alias("outcome"), reason.alias("reason")
        )

    fields = "msg_id STRING, msg_seq BIGINT, rec_idx BIGINT, external_id STRING, flag STRING"
    ingest.run(message, root, decide, fields).awaitTermination()
    return spark.read.parquet(f"{root}/outcomes").select("msg_id", "external_id", "outcome", "reason")


def inbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs over a mailbox whose changes are the events, users being the messages: a clean
    one, a dry one, one that defers sign-ups, and one that settles the rest."""
    root = f"{shared_folder(spark)}/{uuid.uuid4()}"
    changes = views.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("msg_id"), F.col("event_id").cast("bigint").alias("seq"),
        (F.col("event_type") != "view").alias("in_inbox"), F.col("event_type").alias("kind"),
    )
    top = changes.agg(F.max("seq")).first()[0] or 0
    fields = "msg_id STRING, seq BIGINT, in_inbox BOOLEAN, kind STRING"

    def decide(messages: DataFrame, waiting: bool) -> DataFrame:
        signup, bought = F.col("kind") == "signup", F.col("kind") == "purchase"
        outcome = F.when(F.lit(waiting) & signup, "deferred").when(bought, "booked").otherwise("skipped")
        return messages.select("msg_id", "seq", outcome.alias("outcome"), F.when(outcome == "deferred", "no rate").alias("reason"))

    logged = -1
    for quarters, waiting, dry in ((1, False, False), (2, False, True), (2, True, False), (4, False, False)):
        upto = top * quarters // 4
        if upto > logged:
            scan.append(changes.where((F.col("seq") > logged) & (F.col("seq") <= upto)), f"{root}/log", top // 8 + 1)
            logged = upto
        handle = lambda messages, waiting=waiting: decide(messages, waiting)
        scan.run(spark, root, f"{root}/log", fields, handle, dry, top // 8 + 1)
    outcomes = ingest.read_table(spark, f"{root}/outcomes", scan.OUTCOMES)
    saved = ingest.read_table(spark, f"{root}/cursor", scan.CURSOR)
    return outcomes.join(saved, "epoch", "left").select(F.col("epoch").alias("run"), "msg_id", "seq", "outcome", "reason", "last_seq")


def late_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as bank alerts, in several files that come after the statements were booked."""
    root = f"{shared_folder(spark)}/{uuid.uuid4()}"
    paid = materialize(views.orders(spark, sf_dir, deal=False))
    journals = views.journals(spark, sf_dir, paid)
    ledger_table.write(journals, f"{root}/ledger")
    alert = paid.where("prio = '1'").select(
        "o_orderkey", "account_id", F.col("order_date").alias("txn_date"), F.upper("p_name").alias("merchant")
    )
    alert.repartition(3, "o_orderkey").write.parquet(f"{root}/alerts")
    fields = "o_orderkey BIGINT, account_id BIGINT, txn_date DATE, merchant STRING"
    arriving = ingest.read_new(spark, f"{root}/alerts", fields, max_files=1)
    late.run(arriving, ledger_table.read(spark, f"{root}/ledger", journals.schema), root).awaitTermination()
    found = ingest.read_table(spark, f"{root}/late", f"{fields}, statement_journal_id BIGINT, epoch BIGINT")
    return found.select("o_orderkey", "statement_journal_id")


def rate_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs, twenty minutes apart, fetch for the same orders with one cache: all there is,
    then only rates of days that have not passed."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}/rates"
    known = views.rates(spark, sf_dir).select("from_ccy", "to_ccy", "rate_date", "rate")
    needed = materialize(
        fx.account_targets(
            views.orders(spark, sf_dir).select(
                "account_id", F.expr(views.ORDER_CURRENCY).alias("from_ccy"), F.col("order_date").alias("rate_date")
            ),
            views.accounts(spark, sf_dir),
        ).select("from_ccy", F.col("account_currency").alias("to_ccy"), "rate_date").distinct()
    )
    fetch = lambda keys: keys.join(known, ["from_ccy", "to_ccy", "rate_date"])
    for run, minute in ((0, "00"), (1, "20")):
        rate_cache.refresh(spark, path, needed, fetch, F.lit(f"1998-06-30 09:{minute}:00").cast("timestamp"), run)
    return rate_cache.read(spark, path).select(F.col("epoch").alias("run"), "from_ccy", "to_ccy", "rate_date", "rate")


QUERIES = {
    "fx_asof_convert": fx_asof_convert,
    "amount_gate": amount_gate,
    "status_class": status_class,
    "merchant_text": merchant_text,
    "noise_trim": noise_trim,
    "html_text": html_text,
    "win1252_text": win1252_text,
    "validate_gates": validate_gates,
    "transfer_gates": transfer_gates,
    "review_category": review_category,
    "usd_ceiling": usd_ceiling,
    "dop_inverse_rate": dop_inverse_rate,
    "account_route": account_route,
    "transfer_route": transfer_route,
    "dedup_key": dedup_key,
    "dedup_first_wins": dedup_first_wins,
    "unwrap_sender": unwrap_sender,
    "source_dispatch": source_dispatch,
    "receipt_parse": receipt_parse,
    "wire_parse": wire_parse,
    "model_json_normalise": model_json_normalise,
    "message_disposition": message_disposition,
    "alias_canonical": alias_canonical,
    "merchant_similarity": merchant_similarity,
    "recon_candidates": recon_candidates,
    "recon_outcomes": recon_outcomes,
    "recon_unmatched": recon_unmatched,
    "double_book_probe": double_book_probe,
    "amount_correction": amount_correction,
    "ledger_payload": ledger_payload,
    "transfer_payload": transfer_payload,
    "stale_rate_keys": stale_rate_keys,
    "rates_parse": rates_parse,
    "peso_table_parse": peso_table_parse,
    "ledger_scan": ledger_scan,
    "ledger_window": ledger_window,
    "inbox_scan": inbox_scan,
    "last_value_12h": last_value_12h,
    "last_value_14d": last_value_14d,
    "late_alert_stream": late_alert_stream,
    "rate_cache_runs": rate_cache_runs,
    "alias_rules": alias_rules,
    "kv_map": kv_map,
    "statement_fold": statement_fold,
    "balance_check": balance_check,
    "row_grouping": row_grouping,
    "statement_report": statement_report,
    "field_scores": field_scores,
    "accuracy_matrix": accuracy_matrix,
    "outcome_events": outcome_events,
    "outcome_rate_5m": outcome_rate_5m,
    "review_1h": review_1h,
    "last_value_3h": last_value_3h,
    "sustained_alert": sustained_alert,
    "run_summary": run_summary,
    "outcome_rate_stream": outcome_rate_stream,
    "book_once_stream": book_once_stream,
}
