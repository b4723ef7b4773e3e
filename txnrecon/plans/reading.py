"""A deterministic stand-in for the extraction model, used by the catalogue and the tests.

It answers in the shapes models answer in: plain objects, a list that restates its record,
reasoning before a fenced block.
"""

from __future__ import annotations

import json
import re

import pandas as pd

_PAID = re.compile(r"You paid (\S+) ([A-Z]{3}) to (.+)")
_ROW = re.compile(r"^\s*(\S+?)\$(\S+) \| .* \| (\S+) \| (.+) \| (\S+)\s*$", re.MULTILINE)
_PREFIX = {"US": "USD", "RD": "DOP"}


def _wallet(body: str) -> str:
    paid = _PAID.search(body)
    if paid is None:
        return json.dumps({"kind": "other"})

    def after(label: str) -> str:
        found = re.search(rf"{label}:? (.+)", body)
        return "" if found is None else found.group(1).strip()

    record = {
        "kind": "transaction",
        "external_id": after("Transaction ID"),
        "amount": paid.group(1),
        "currency": paid.group(2),
        "direction": "out",
        "date": re.sub(r" \d\d:.*", "", after("Transaction date")),
        "merchant": paid.group(3).strip(),
        "account_hint": after("Paid with"),
        "status": after("Status"),
        "raw_ref": "",
    }
    if record["status"] == "approved":
        return json.dumps({"transactions": [record, record]})
    if record["status"] == "pending":
        return "<think>is {this} paid?</think>```json\n" + json.dumps(record) + "\n``` done"
    return json.dumps(record)


def _alert(body: str) -> str:
    row = _ROW.search(body)
    if row is None:
        return "no table found"
    prefix, amount, day, merchant, state = row.groups()
    card = re.search(r"terminada en (\d{4})", body)
    return json.dumps(
        {
            "amount": amount,
            "currency": _PREFIX.get(prefix, prefix),
            "direction": "out",
            "date": day,
            "merchant": merchant,
            "account_hint": "" if card is None else card.group(1),
            "status": state,
            "raw_ref": "",
        },
        ensure_ascii=False,
    )


def read_mail(batch: pd.DataFrame) -> pd.Series:
    """One answer per message of a batch with ``adapter`` and ``prompt_body``."""
    readers = {"paypal": _wallet, "banco_popular": _alert}
    return pd.Series([readers[a](b) for a, b in zip(batch["adapter"], batch["prompt_body"])], index=batch.index, dtype=object)
