"""Account routing by source, funding and currency, and the lookups behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.text import ascii_lower, contains_any, utrim

# Funding hints that name a credit product.
CREDIT_HINTS = ("paypal credit", "pay later", "pay in 4", "pay in4", "pay monthly", "credit")

# Names of the logical accounts.
WALLET_CREDIT, WALLET_BALANCE = "paypal_credit", "paypal_balance"
BANK_PESO, BANK_DOLLAR = "banco_popular_dop", "banco_popular_usd"
PAYING_PESO, PAYING_DOLLAR = "banco_popular_paying_dop", "banco_popular_paying_usd"


def is_credit_funded(hint: Column) -> Column:
    return F.coalesce(contains_any(ascii_lower(utrim(hint)), CREDIT_HINTS), F.lit(False))


def logical_account() -> Column:
    """Where a record books, before configuration maps it to an account id."""
    return (
        F.when(
            F.col("source") == "paypal",
            F.when(is_credit_funded(F.col("account_hint")), WALLET_CREDIT).otherwise(WALLET_BALANCE),
        )
        .when((F.col("source") == "banco_popular") & (F.col("currency") == "DOP"), BANK_PESO)
        .when(F.col("source") == "banco_popular", BANK_DOLLAR)
    )


def lookup(df: DataFrame, dims: DataFrame, kind: Column, key: Column, out: str) -> DataFrame:
    """Left join to the (kind, key, value) dimension; the kind is part of the key so two
    namespaces with equal keys never mix."""
    dim = dims.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("value").alias(out))
    return df.join(dim, (kind == F.col("_kind")) & (key == F.col("_key")), "left").drop("_kind", "_key")


def accounts(records: DataFrame, dims: DataFrame) -> DataFrame:
    """Add ``routed_account``, ``account_id`` and ``route_reason`` when none is configured."""
    routed = records.withColumn("routed_account", logical_account())
    found = lookup(routed, dims, F.lit("account"), F.col("routed_account"), "account_id")
    return found.withColumn(
        "route_reason",
        F.when(F.col("account_id").isNull(), F.concat(F.lit("no account is set for "), "routed_account")),
    )


def statement_transfer_accounts(transfers: DataFrame, dims: DataFrame) -> DataFrame:
    """Legs of a statement payment by its currency: paying account to card account."""
    peso = F.col("currency") == "DOP"
    out = lookup(
        transfers, dims, F.lit("account"), F.when(peso, PAYING_PESO).otherwise(PAYING_DOLLAR), "source_account_id"
    )
    out = lookup(out, dims, F.lit("account"), F.when(peso, BANK_PESO).otherwise(BANK_DOLLAR), "dest_account_id")
    return out.withColumn(
        "route_reason",
        F.when(F.col("source_account_id").isNull(), "no paying account configured").when(
            F.col("dest_account_id").isNull(), "no card account configured"
        ),
    )


def transfer_accounts(transfers: DataFrame, dims: DataFrame) -> DataFrame:
    """Legs of a payment or wire from the keys its body carries; destination is checked first."""
    dest_kind = F.when(F.col("dest_kind") == "paypal_credit", "account").otherwise(F.col("dest_kind"))
    out = lookup(transfers, dims, dest_kind, F.upper("dest_key"), "_dest_upper")
    out = lookup(out, dims, dest_kind, F.col("dest_key"), "_dest_exact")
    out = out.withColumn("dest_account_id", F.coalesce("_dest_upper", "_dest_exact")).drop("_dest_upper", "_dest_exact")
    out = lookup(out, dims, F.col("source_kind"), F.col("source_key"), "source_account_id")
    return out.withColumn(
        "route_reason",
        F.when(
            F.col("dest_account_id").isNull(),
            F.concat(F.lit("no destination account configured for "), "dest_key"),
        ).when(
            F.col("source_account_id").isNull(),
            F.concat(F.lit("no source account configured for last-4 "), "source_key"),
        ),
    )


def source_currency_mismatch(currency: Column, account_currency: Column) -> Column:
    """Reason when a transfer's currency is not its source account's, else null."""
    return F.when(
        F.upper(currency) != F.upper(account_currency),
        F.concat(
            F.lit("transfer currency "), currency, F.lit(" does not match source account currency "), account_currency
        ),
    )


def section_accounts(sections: DataFrame, dims: DataFrame) -> DataFrame:
    """Card account of each statement section."""
    key = F.when(F.col("currency") == "DOP", BANK_PESO).otherwise(BANK_DOLLAR)
    return lookup(sections, dims, F.lit("account"), key, "account_id")


def categories(df: DataFrame, dims: DataFrame) -> DataFrame:
    """Add ``category`` by merchant code; unmatched stays null."""
    return lookup(df, dims, F.lit("mcc_category"), F.col("mcc"), "category")
