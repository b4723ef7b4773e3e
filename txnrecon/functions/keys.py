"""Deduplication keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.numbers import decimal_text
from txnrecon.functions.text import ascii_lower, nonblank, utrim

# Key prefixes of sources that carry their own identifier.
PAYMENT_PREFIX = "pp-payment:"
WIRE_PREFIX = "swift:"
STATEMENT_PREFIX = "bpstmt:"


def composite_hash() -> Column:
    """sha256 over the fields that tell two records apart, in fixed order.

    ``concat_ws`` skips nulls, which would shift the fields, so each is coalesced first.
    """
    parts = [
        F.col("source"),
        F.col("txn_date").cast("string"),
        decimal_text("amount"),
        F.col("currency"),
        utrim("merchant"),
        utrim("account_hint"),
        ascii_lower(utrim("status")),
    ]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def dedup_key() -> Column:
    """The record's own identifier when it has one, else the composite hash."""
    return F.coalesce(nonblank("external_id"), composite_hash())


def prefixed(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), col)
