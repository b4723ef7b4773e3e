"""Fixed-format bodies: payment receipts and the USD line of cross-currency receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.dates import payment_date
from txnrecon.functions.keys import PAYMENT_PREFIX, prefixed
from txnrecon.functions.numbers import amount_gate, currency_gate, first_decimal
from txnrecon.functions.text import (
    ascii_lower, block_after_label, contains_any, extract, first_where, label_value, let, lines,
    strip_thousands_commas,
)

# Phrases that tell receipts from other mail.
RECEIPT_MARKERS = ("transaction id", "you paid")
INSTALLMENT_MARKERS = (
    "payment for your pay in 4 plan",
    "payment for your pay-in-4 plan",
    "pay in 4 payment went through",
    "pay-in-4 payment went through",
)
PAYMENT_MARKERS = ("paypal credit will receive", "receipt for your payment to paypal credit")
USD_TOTAL_LABEL = "total amount of this transaction"
PAYMENT_DESCRIPTION = "Payment to PayPal Credit"


def is_purchase(body: Column) -> Column:
    """A receipt marker is present and no installment phrase vetoes it."""
    return let(
        ascii_lower(body), lambda low: ~contains_any(low, INSTALLMENT_MARKERS) & contains_any(low, RECEIPT_MARKERS)
    )


def is_payment_receipt(body: Column) -> Column:
    """The user-paid phrase together with a marker only confirmations carry."""
    return let(
        ascii_lower(body), lambda low: contains_any(low, ("you paid",)) & contains_any(low, PAYMENT_MARKERS)
    )


def usd_transaction_total(body: Column) -> Column:
    """First usable amount after the USD total label, one candidate per line."""
    tails = F.regexp_extract_all(body, F.lit(rf"(?i){USD_TOTAL_LABEL}([^\n]*)"), 1)
    amounts = F.transform(tails, lambda t: amount_gate(first_decimal(t)))
    return first_where(amounts, lambda a: a.isNotNull())


def paid_tokens(body: Column) -> Column:
    """Words after the first ``$`` of the first "you paid" line that has one."""
    line = first_where(
        lines(body), lambda l: F.contains(ascii_lower(l), F.lit("you paid")) & F.contains(l, F.lit("$"))
    )
    tail = extract(line, r"(?s)\$(.*)")
    return F.filter(F.split(tail, r"(?U)\s+"), lambda t: t != "")


def funding_last4(body: Column) -> Column:
    """Four digits after a word-boundary ``x-`` in the block under "Paid with"."""
    block = block_after_label(body, "paid with")
    return extract(block, r"(?i)(?:^|[^A-Za-z0-9])x-([0-9]{4})(?![0-9])")


def payment_fields(body: Column) -> Column:
    """Transfer struct of a payment receipt, with ``parse_error`` naming the first gap."""

    def read(text: Column) -> Column:
        return F.struct(
            paid_tokens(text).alias("words"),
            payment_date(text).alias("day"),
            label_value(text, "transaction id").alias("txn_id"),
            funding_last4(text).alias("last4"),
        )

    def typed(r: Column) -> Column:
        amount = amount_gate(strip_thousands_commas(F.get(r["words"], 0)))
        currency = currency_gate(F.get(r["words"], 1))
        error = (
            F.when(F.coalesce(F.size(r["words"]), F.lit(0)) < 2, "no amount and currency after `you paid $`")
            .when(amount.isNull(), "payment amount rejected")
            .when(currency.isNull(), "payment currency rejected")
            .when(r["day"].isNull(), "no parseable payment date")
            .when(r["txn_id"].isNull(), "no transaction id value")
            .when(r["last4"].isNull(), "no funding last-4 under paid with")
        )
        return F.struct(
            amount.alias("amount"),
            currency.alias("currency"),
            r["day"].alias("txn_date"),
            F.lit(PAYMENT_DESCRIPTION).alias("description"),
            prefixed(PAYMENT_PREFIX, r["txn_id"]).alias("external_id"),
            F.lit("paypal_funding_last4").alias("source_kind"),
            r["last4"].alias("source_key"),
            F.lit("paypal_credit").alias("dest_kind"),
            F.lit("paypal_credit").alias("dest_key"),
            error.alias("parse_error"),
        )

    return let(body, lambda text: let(read(text), typed))
