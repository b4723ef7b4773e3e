"""Ledger and rule JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.dates import ledger_date
from txnrecon.functions.numbers import currency_gate, magnitude
from txnrecon.functions.text import nonblank, utrim

SPLIT = (
    "STRUCT<transaction_journal_id: STRING, type: STRING, date: STRING, amount: STRING, "
    "currency_code: STRING, description: STRING, external_id: STRING, tags: ARRAY<STRING>, "
    "foreign_amount: STRING, foreign_currency_code: STRING>"
)
PAGE = f"data ARRAY<STRUCT<id: STRING, attributes: STRUCT<transactions: ARRAY<{SPLIT}>>>>"
RULES = (
    "data ARRAY<STRUCT<attributes: STRUCT<triggers: ARRAY<STRUCT<type: STRING, value: STRING>>, "
    "actions: ARRAY<STRUCT<type: STRING, value: STRING>>>>>"
)


def splits(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per split of every group on every page, with the group's split count."""
    doc = F.from_json(body, PAGE)
    carried = [c for c in pages.columns if c != body]
    groups = pages.select(*carried, F.explode(doc["data"]).alias("_g"))
    return groups.select(
        *carried,
        F.col("_g.id").alias("journal_id"),
        F.size("_g.attributes.transactions").alias("split_count"),
        F.explode("_g.attributes.transactions").alias("_s"),
    ).select(*carried, "journal_id", "split_count", "_s.*")


def journals(split_rows: DataFrame, tag: str) -> DataFrame:
    """Splits carrying ``tag`` as journals; ``is_usable`` is false where the date, amount or
    currency does not parse, so the loss can be counted instead of passing unseen."""
    own = split_rows.where(F.array_contains("tags", tag))
    carried = [c for c in split_rows.columns if c not in _SPLIT_FIELDS]
    parsed = own.select(
        *carried,
        ledger_date("date").alias("txn_date"),
        magnitude("amount").alias("amount"),
        currency_gate("currency_code").alias("currency"),
        utrim("description").alias("merchant"),
        F.when(nonblank("external_id").isNotNull(), F.col("external_id")).alias("external_id"),
        "tags",
        magnitude("foreign_amount").alias("foreign_amount"),
        F.col("foreign_currency_code").alias("foreign_currency"),
    )
    usable = F.col("txn_date").isNotNull() & F.col("amount").isNotNull() & F.col("currency").isNotNull()
    return parsed.withColumn("is_usable", usable)


_SPLIT_FIELDS = {
    "transaction_journal_id", "type", "date", "amount", "currency_code", "description", "external_id",
    "tags", "foreign_amount", "foreign_currency_code",
}


def skipped(journal_rows: DataFrame) -> DataFrame:
    """How many tagged splits were unusable."""
    return journal_rows.agg(F.count_if(~F.col("is_usable")).alias("skipped"))


def alias_rules(pages: DataFrame, body: str = "body", page_no: str = "page_no") -> DataFrame:
    """Alias rows (pos, trigger, canonical) of a rule listing, in rule order: the first
    description trigger, lower-cased, and the first destination action; blanks are dropped."""
    doc = F.from_json(body, RULES)
    rules = pages.select(page_no, F.posexplode(doc["data"]).alias("_i", "_r"))
    trigger = F.get(F.filter("_r.attributes.triggers", lambda t: t["type"].startswith("description_")), 0)
    action = F.get(F.filter("_r.attributes.actions", lambda a: a["type"] == "set_destination_account"), 0)
    return rules.select(
        (F.col(page_no).cast("bigint") * (1 << 32) + F.col("_i")).alias("pos"),
        F.lower(nonblank(trigger["value"])).alias("trigger"),
        nonblank(action["value"]).alias("canonical"),
    ).where(F.col("trigger").isNotNull() & F.col("canonical").isNotNull())
