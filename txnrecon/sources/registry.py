"""Mail sources as bundles of column expressions.

Adding a source means adding an entry; the dispatch composes all entries into one
CASE, so no Python runs per message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrecon.functions import receipts, wires
from txnrecon.functions.dates import bank_date, wallet_date
from txnrecon.functions.text import strip_thousands_commas, trim_noise


@dataclass(frozen=True)
class Source:
    """What one sender's mail means.

    sender          substring of the lower-cased sender address
    record_source   value of ``source`` on the records it yields
    is_transaction  cheap test run before anything else
    is_fixed        bodies of a rigid format, parsed without a model
    fixed_fields    transfer fields of such a body
    model_body      the text handed to the model stage
    amount_text     clean-up of an amount before the gate
    parse_date      date formats, in order
    wallet_rules    own ids, direction, kind=other skips and the USD total override
    """

    name: str
    sender: str
    record_source: str
    is_transaction: Callable[[Column], Column]
    is_fixed: Callable[[Column], Column]
    fixed_fields: Callable[[Column], Column] | None
    model_body: Callable[[Column], Column] | None
    amount_text: Callable[[Column], Column] = lambda c: c
    parse_date: Callable[[Column], Column] = wallet_date
    wallet_rules: bool = False


def _always(_: Column) -> Column:
    return F.lit(True)


def _never(_: Column) -> Column:
    return F.lit(False)


# Sender substrings and source names, in matching order.
SOURCES: tuple[Source, ...] = (
    Source(
        name="paypal_payment",
        sender="customercare@paypal.com",
        record_source="paypal",
        is_transaction=receipts.is_payment_receipt,
        is_fixed=_always,
        fixed_fields=receipts.payment_fields,
        model_body=None,
    ),
    Source(
        name="paypal",
        sender="service@paypal.com",
        record_source="paypal",
        is_transaction=receipts.is_purchase,
        is_fixed=_never,
        fixed_fields=None,
        model_body=trim_noise,
        wallet_rules=True,
    ),
    Source(
        name="banco_popular",
        sender="popularenlinea.com",
        record_source="banco_popular",
        is_transaction=_always,
        is_fixed=wires.is_wire,
        fixed_fields=wires.wire_fields,
        model_body=lambda body: body,
        amount_text=strip_thousands_commas,
        parse_date=bank_date,
    ),
)


def per_source(sources: tuple[Source, ...], value: Callable[[Source], Column], key: Column | None = None) -> Column:
    """``value`` of the row's source, as one CASE over ``adapter``."""
    name = F.col("adapter") if key is None else key
    out = F.when(name == sources[0].name, value(sources[0]))
    for source in sources[1:]:
        out = out.when(name == source.name, value(source))
    return out


def match_sender(sender: Column, sources: tuple[Source, ...] = SOURCES) -> Column:
    """Name of the first source whose substring the sender holds."""
    out = F.when(F.contains(sender, F.lit(sources[0].sender)), sources[0].name)
    for source in sources[1:]:
        out = out.when(F.contains(sender, F.lit(source.sender)), source.name)
    return out
