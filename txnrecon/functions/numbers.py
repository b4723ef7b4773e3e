"""Decimal scalars. Amounts are DECIMAL(20,4), rates keep 12 places; nothing passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.text import _c, extract, let, strip_thousands_commas, utrim

AMOUNT = "decimal(20,4)"
RATE = "decimal(28,12)"
#: A converted and rounded amount, at any account's number of places.
MONEY = "decimal(36,12)"
PLACES = tuple(range(13))


def times(amount: Column, rate: Column) -> Column:
    """Exact amount x rate, below 1e20: a product of both types at once would lose places."""
    whole = F.floor(rate).cast("decimal(16,0)")
    part = (rate.cast(RATE) - whole).cast("decimal(12,12)")
    held = (amount.cast(AMOUNT) * whole).try_cast("decimal(24,4)")
    return (held + (amount.cast(AMOUNT) * part).cast("decimal(33,16)")).cast("decimal(37,16)")


def amount_gate(col: Column | str) -> Column:
    """A plain non-negative decimal with at most four fraction digits *as written*, else null.

    Signs, exponents, separators and symbols are refused before any cast; ``\\z`` is
    needed because ``$`` would let a trailing newline through.
    """
    return let(utrim(col), lambda text: F.when(text.rlike(r"^[0-9]+(\.[0-9]{1,4})?\z"), text.try_cast(AMOUNT)))


def currency_gate(col: Column | str) -> Column:
    """Exactly three ASCII letters after trimming, upper-cased, else null."""
    return let(utrim(col), lambda text: F.when(text.rlike(r"^[A-Za-z]{3}\z"), F.upper(text)))


def first_decimal(col: Column | str) -> Column:
    """First run of digits and dots."""
    return extract(col, r"([0-9.]+)")


def decimal_text(col: Column | str) -> Column:
    """Canonical text of a decimal: no trailing zeros, no bare point."""
    text = _c(col).cast("string")
    short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), short).otherwise(text)


def statement_decimal(col: Column | str) -> Column:
    """Comma-grouped, optionally negative statement figure, else null."""
    text = utrim(col)
    plain = strip_thousands_commas(text)
    return F.when(plain.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), plain.try_cast(AMOUNT))


def loose_amount(col: Column | str) -> Column:
    """Digits, dots and minus signs of a label or answer, as a decimal; for scoring only."""
    kept = F.regexp_replace(_c(col), r"[^0-9.\-]", "")
    return F.when(kept.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), kept.try_cast(AMOUNT))


def magnitude(col: Column | str) -> Column:
    """Absolute value of a ledger figure, null when it is no decimal or has over four digits."""
    text = utrim(col)
    plain = F.regexp_replace(text, r"^[-+]", "")
    trimmed = F.regexp_replace(plain, r"(\.[0-9]*?)0+\z", "$1")
    shaped = text.rlike(r"^[-+]?[0-9]+(?:\.[0-9]*)?\z") & trimmed.rlike(r"^[0-9]+(?:\.[0-9]{0,4})?\z")
    return F.when(shaped, plain.try_cast(AMOUNT))


def round_half_even(value: Column, decimals: Column, places: tuple[int, ...] = PLACES) -> Column:
    """Banker's rounding to a per-row number of places (``bround`` wants a literal one)."""
    out = F.lit(None).cast(MONEY)
    for n in places:
        out = F.when(decimals == n, F.bround(value, n).cast(MONEY)).otherwise(out)
    return out


def ratio(correct: Column, applicable: Column) -> Column:
    """Share as a double, null when nothing applied."""
    return F.when(applicable > 0, correct.cast("double") / applicable.cast("double"))


def digits(col: Column | str, shape: str) -> Column:
    """Trimmed ASCII digits whose count matches ``shape`` (``{4}``, ``{10,}``, ``+``), else null."""
    text = utrim(col)
    return F.when(text.rlike(rf"^[0-9]{shape}\z"), text)


def reference_number(col: Column | str) -> Column:
    return digits(col, "{10,}")


def last4(col: Column | str) -> Column:
    return digits(col, "{4}")


def merchant_code(col: Column | str) -> Column:
    return digits(col, "{4}")


def auth_code(col: Column | str) -> Column:
    return digits(col, "+")
