"""Date scalars. Text is checked by shape, turned into ISO text and ``try_cast``: an
impossible date gives null instead of failing the job under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions.text import (
    _c, ascii_lower, contains_any, extract, first_where, label_value, let, lines, utrim,
)

MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|"
    "aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_KEY = "janfebmaraprmayjunjulaugsepoctnovdec"


def _assemble(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def iso_date(col: Column | str) -> Column:
    shape = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
    return let(utrim(col), lambda text: F.when(text.rlike(shape), text.try_cast("date")))


def _numeric(col: Column | str, day_group: int, month_group: int) -> Column:
    shape = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
    return let(
        utrim(col),
        lambda text: F.when(
            text.rlike(shape),
            _assemble(*(F.regexp_extract(text, shape, g) for g in (3, month_group, day_group))),
        ),
    )


def day_first_date(col: Column | str) -> Column:
    """``dd/MM/yyyy``."""
    return _numeric(col, day_group=1, month_group=2)


def month_first_date(col: Column | str) -> Column:
    """``MM/dd/yyyy``."""
    return _numeric(col, day_group=2, month_group=1)


def english_date(col: Column | str) -> Column:
    """``May 11, 2026``, full or three-letter month, any case and spacing."""
    shape = rf"(?i)^({MONTH})\s*([0-9]{{1,2}}),\s*([0-9]{{4}})\z"

    def read(text: Column) -> Column:
        month = ascii_lower(F.substring(F.regexp_extract(text, shape, 1), 1, 3))
        number = ((F.instr(F.lit(_MONTH_KEY), month) + 2) / 3).cast("int").cast("string")
        return F.when(
            text.rlike(shape), _assemble(F.regexp_extract(text, shape, 3), number, F.regexp_extract(text, shape, 2))
        )

    return let(utrim(col), read)


def wallet_date(col: Column | str) -> Column:
    """ISO, then English month names, then US order."""
    return F.coalesce(iso_date(col), english_date(col), month_first_date(col))


def bank_date(col: Column | str) -> Column:
    """ISO, then day first."""
    return F.coalesce(iso_date(col), day_first_date(col))


def ledger_date(col: Column | str) -> Column:
    """Calendar date as written in an RFC 3339 stamp or in the leading ten characters."""
    return iso_date(F.substring(utrim(col), 1, 10))


def payment_date(body: Column) -> Column:
    """Value under the ``Date`` label, else ``on <Month d, yyyy>`` on a "you paid" line."""
    phrase = rf"(?i)(?:^|\s)on\s+((?:{MONTH})\s+[0-9]{{1,2}},\s+[0-9]{{4}})(?=\s|\z)"
    headline = F.filter(lines(body), lambda l: contains_any(ascii_lower(l), ("you paid",)))
    dated = F.transform(headline, lambda l: english_date(extract(l, phrase)))
    return F.coalesce(english_date(label_value(body, "date")), first_where(dated, lambda d: d.isNotNull()))


def is_day_month(col: Column | str) -> Column:
    """``DD/MM``, five characters."""
    return utrim(col).rlike(r"^[0-9]{2}/[0-9]{2}\z")


def infer_year(day_month: Column, cut: Column) -> Column:
    """Full date of a year-less ``DD/MM``: a month after the cut month is last year's."""
    text = utrim(day_month)
    day, month = F.substring(text, 1, 2), F.substring(text, 4, 2)
    year = F.year(cut) - (month.try_cast("int") > F.month(cut)).cast("int")
    return F.when(is_day_month(day_month), _assemble(year.cast("string"), month, day))


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(_c(a), _c(b))) <= days
