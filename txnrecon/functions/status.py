"""Status words and currency codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.text import _c, ascii_lower, let, utrim

# Whole-word tokens of each status class.
APPROVE_TOKENS = [
    "approved", "completed", "complete", "success", "successful", "paid", "sent", "posted",
    "settled", "aprobada", "aprobado", "completada", "completado",
]
REJECT_TOKENS = [
    "declined", "declinada", "declinado", "failed", "failure", "refused", "denied", "rechazada",
    "rechazado", "incomplete", "void", "voided", "cancelled", "canceled", "cancelada", "cancelado",
    "refund", "refunded", "reembolsado", "reembolso", "reversal", "reversed", "contracargo",
    "chargeback", "disputa", "dispute", "disputed", "devuelto", "unpaid",
]
IN_FLIGHT_TOKENS = [
    "pending", "pendiente", "processing", "procesando", "hold", "review", "expired", "expirada",
]

# The currencies that may be booked.
KNOWN_CURRENCIES = [
    "USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "CNY", "HKD", "SGD", "SEK", "NOK",
    "DKK", "PLN", "CZK", "HUF", "MXN", "BRL", "ARS", "CLP", "COP", "PEN", "DOP", "ZAR", "INR",
    "KRW", "TWD", "THB", "MYR", "IDR", "PHP", "TRY", "ILS", "AED", "SAR",
]


def normalize_status(col: Column | str) -> Column:
    """ASCII lower case, every other run of characters one space."""
    return F.trim(F.regexp_replace(ascii_lower(_c(col)), "[^a-z0-9]+", " "))


def status_class(col: Column | str) -> Column:
    """approved / declined / other, by whole tokens: reject beats in-flight beats approve."""

    def classify(words: Column) -> Column:
        def any_of(vocabulary: list[str]) -> Column:
            return F.arrays_overlap(words, F.array(*[F.lit(t) for t in vocabulary]))

        return (
            F.when(any_of(REJECT_TOKENS), "declined")
            .when(any_of(IN_FLIGHT_TOKENS), "other")
            .when(any_of(APPROVE_TOKENS), "approved")
            .otherwise("other")
        )

    return let(F.split(normalize_status(col), " "), classify)


def is_known_currency(col: Column | str) -> Column:
    return F.upper(utrim(col)).isin(KNOWN_CURRENCIES)
