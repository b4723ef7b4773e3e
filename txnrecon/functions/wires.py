"""Outbound wire confirmations: tagged text inside a mail body.

The text is not well-formed XML (page breaks and rules cut through it), so fields
are read tag by tag after the interrupting lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.dates import iso_date
from txnrecon.functions.keys import WIRE_PREFIX, prefixed
from txnrecon.functions.numbers import amount_gate, currency_gate
from txnrecon.functions.text import (
    ascii_lower, ascii_upper, contains_any, extract, let, lines, nonblank, strip_thousands_commas, utrim,
)

# Message-type tokens and the settlement tag of a wire confirmation.
WIRE_MARKERS = ("pacs.008.001", "fitoficstmrcdttrf", "fitoficustomercredittransfer")
SETTLEMENT_MARKER = "<intrbksttlmamt"

_PAGE_BREAK = (
    r"(?i)^\s*[0-9]+/[0-9]+/[0-9]+-[0-9]+:[0-9]+:[0-9]+\s+\S*ICMACK\S*\s+[0-9]+\s*\z"
)
_RULE = r"^\s*_+\s*\z"


def is_wire(body: Column) -> Column:
    return let(
        ascii_lower(body), lambda low: contains_any(low, WIRE_MARKERS) & F.contains(low, F.lit(SETTLEMENT_MARKER))
    )


def drop_interruptions(body: Column) -> Column:
    """Body without page-break and underscore lines."""
    return F.array_join(F.filter(lines(body), lambda l: ~l.rlike(_PAGE_BREAK) & ~l.rlike(_RULE)), "\n")


def tag_text(body: Column, tag: str) -> Column:
    """Text of the first attribute-free ``<tag>``."""
    return extract(body, rf"(?s)<{tag}>(.*?)</{tag}>")


def element_text(body: Column, tag: str) -> Column:
    """Text of the first ``<tag …>``; a longer tag name with the same start does not match."""
    return extract(body, rf"(?s)<{tag}(?=[\s>])[^>]*>(.*?)</{tag}>")


def element_attr(body: Column, tag: str, name: str) -> Column:
    """Attribute of the first complete ``<tag …>`` element."""
    attrs = extract(body, rf"(?s)<{tag}(?=[\s>])([^>]*)>.*?</{tag}>")
    return extract(attrs, rf'{name}="([^"]*)"')


def innermost_id(fragment: Column) -> Column:
    return nonblank(F.regexp_extract(fragment, r"(?s).*<Id>(.*?)</Id>", 1))


def normalize_bic(col: Column) -> Column:
    """Upper case; the default branch ``XXX`` of an 11-character code is dropped."""
    return let(
        ascii_upper(utrim(col)),
        lambda code: F.when(
            (F.length(code) == 11) & code.endswith("XXX"), F.substring(code, 1, 8)
        ).otherwise(code),
    )


def wire_description(name: Column, bic: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("SWIFT wire to "), nonblank(name)),
        F.concat(F.lit("International transfer ("), bic, F.lit(")")),
    )


def wire_fields(raw_body: Column) -> Column:
    """Transfer struct of a wire; ``parse_error`` names the first failing guard or field."""

    def read(body: Column) -> Column:
        debtor_id = F.regexp_replace(innermost_id(element_text(body, "DbtrAcct")), "[^A-Za-z0-9]", "")
        return F.struct(
            F.greatest(
                F.coalesce(utrim(tag_text(body, "NbOfTxs")).try_cast("bigint"), F.lit(0)),
                F.size(F.split(body, "<CdtTrfTxInf")) - 1,
            ).alias("transactions"),
            amount_gate(strip_thousands_commas(element_text(body, "IntrBkSttlmAmt"))).alias("amount"),
            currency_gate(element_attr(body, "IntrBkSttlmAmt", "Ccy")).alias("currency"),
            ascii_upper(utrim(element_attr(body, "InstdAmt", "Ccy"))).alias("instructed"),
            iso_date(tag_text(body, "IntrBkSttlmDt")).alias("day"),
            let(debtor_id, lambda i: F.when(F.length(i) >= 4, F.right(i, F.lit(4)))).alias("debtor"),
            normalize_bic(tag_text(element_text(body, "CdtrAgt"), "BICFI")).alias("bic"),
            nonblank(tag_text(body, "UETR")).alias("uetr"),
            tag_text(element_text(body, "Cdtr"), "Nm").alias("creditor"),
        )

    def typed(r: Column) -> Column:
        error = (
            F.when(r["transactions"] > 1, "multi-transaction wire not supported")
            .when(r["amount"].isNull() | r["currency"].isNull(), "settlement amount rejected")
            .when(r["instructed"].isNotNull() & (r["instructed"] != r["currency"]), "cross-currency wire not supported")
            .when(r["day"].isNull(), "no settlement date")
            .when(r["debtor"].isNull(), "no debtor account")
            .when(r["bic"].isNull(), "no creditor agent code")
            .when(r["uetr"].isNull(), "no wire identifier")
        )
        return F.struct(
            r["amount"].alias("amount"),
            r["currency"].alias("currency"),
            r["day"].alias("txn_date"),
            wire_description(r["creditor"], r["bic"]).alias("description"),
            prefixed(WIRE_PREFIX, r["uetr"]).alias("external_id"),
            F.lit("swift_debtor_last4").alias("source_kind"),
            r["debtor"].alias("source_key"),
            F.lit("creditor_bic").alias("dest_kind"),
            r["bic"].alias("dest_key"),
            error.alias("parse_error"),
        )

    return let(drop_interruptions(raw_body), lambda body: let(read(body), typed))
