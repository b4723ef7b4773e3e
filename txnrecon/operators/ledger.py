"""The ledger side: duplicates, payloads, corrections, transfers and the double-book probe."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.dates import within_days
from txnrecon.functions.keys import STATEMENT_PREFIX
from txnrecon.functions.numbers import decimal_text
from txnrecon.operators import fx, routing, validate
from txnrecon.operators.params import ReconcileParams
from txnrecon.operators.similarity import bucket_of, buckets_near, canonical, similar_names

IMPORT_TAG = "txnrecon"
CORRECTION_TAG = "bp-estimate:"


def split_new(records: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose key the ledger does not hold, and those it does. Exact equality."""
    booked = ledger.select("external_id").where(F.col("external_id").isNotNull())
    return (
        records.join(booked, "external_id", "left_anti"),
        records.join(booked, "external_id", "left_semi"),
    )


def payload(df: DataFrame) -> DataFrame:
    """Withdrawal or deposit rows as the ledger takes them.

    Needs the columns of :func:`fx.convert` and ``category``. A converted row books the
    account-currency figure and carries the original as its foreign leg.
    """
    return df.select(
        F.when(F.col("direction") == "out", "withdrawal").otherwise("deposit").alias("type"),
        F.col("txn_date").alias("date"),
        decimal_text("booked_amount").alias("amount"),
        F.col("account_currency").alias("currency_code"),
        F.col("merchant").alias("description"),
        "external_id",
        F.array(F.lit(IMPORT_TAG)).alias("tags"),
        F.col("account_id").alias("source_id"),
        F.col("merchant").alias("destination_name"),
        F.lit(None).cast("string").alias("destination_id"),
        F.when(F.col("foreign_amount").isNotNull(), decimal_text("foreign_amount")).alias("foreign_amount"),
        F.col("foreign_currency").alias("foreign_currency_code"),
        F.col("category").alias("category_name"),
    )


def transfer_payload(df: DataFrame) -> DataFrame:
    """Transfer rows: the source leg is exact, the foreign leg an estimate when the
    destination account has another currency."""
    return df.select(
        F.lit("transfer").alias("type"),
        F.col("txn_date").alias("date"),
        decimal_text("amount").alias("amount"),
        F.col("currency").alias("currency_code"),
        "description",
        "external_id",
        F.array(F.lit(IMPORT_TAG)).alias("tags"),
        F.col("source_account_id").alias("source_id"),
        F.lit(None).cast("string").alias("destination_name"),
        F.col("dest_account_id").alias("destination_id"),
        F.when(F.col("foreign_amount").isNotNull(), decimal_text("foreign_amount")).alias("foreign_amount"),
        F.col("foreign_currency").alias("foreign_currency_code"),
        F.lit(None).cast("string").alias("category_name"),
    )


def book_transfers(
    transfers: DataFrame,
    dims: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    max_usd: Decimal | None = None,
    dop_rates: DataFrame | None = None,
) -> DataFrame:
    """Decide payments and wires. Destination, source, ceiling, gate, source currency:
    the first that fails is the reason. A missing rate defers."""
    routed = routing.transfer_accounts(transfers, dims)
    screened = validate.usd_ceiling(routed, rates, max_usd, dop_rates).withColumnRenamed("defer_reason", "_defer")
    legs = accounts.select(F.col("account_id").cast("string").alias("_id"), F.col("currency").alias("_ccy"), "decimals")
    out = screened.join(
        legs.select(F.col("_id").alias("source_account_id"), F.col("_ccy").alias("source_currency")),
        "source_account_id",
        "left",
    ).join(
        legs.select(
            F.col("_id").alias("dest_account_id"),
            F.col("_ccy").alias("account_currency"),
            F.coalesce("decimals", F.lit(fx.DEFAULT_DECIMALS)).alias("account_decimals"),
        ),
        "dest_account_id",
        "left",
    )
    rated = fx.with_rate(out, rates, "currency", "account_currency", "txn_date", dop_rates)
    converted = fx.convert(rated)
    reason = F.coalesce(
        "parse_error",
        "route_reason",
        "ceiling_reason",
        validate.transfer_reason(),
        routing.source_currency_mismatch(F.col("currency"), F.col("source_currency")),
    )
    waits = F.col("parse_error").isNull() & F.col("route_reason").isNull()
    return (
        converted.withColumn("review_reason", reason)
        .withColumn("defer_reason", F.when(waits, F.coalesce("_defer", "defer_reason")))
        .withColumn("foreign_amount", F.when(F.col("foreign_amount").isNotNull(), F.col("booked_amount")))
        .withColumn(
            "foreign_currency", F.when(F.col("foreign_currency").isNotNull(), F.col("account_currency"))
        )
        .drop("_defer")
    )


def correction_decision(current: Column, expected: Column, billed: Column, max_pct: Decimal) -> Column:
    """noop, corrected, or the reason for review.

    A journal that moved since it was matched is never overwritten, and the change is
    bounded in percent of the booked estimate.
    """
    share = F.abs(billed - expected) * 100
    return (
        F.when(current == billed, "noop")
        .when(current != expected, "review: journal amount changed since reconcile")
        .when(expected == 0, "review: booked estimate is zero")
        .when(share > F.lit(max_pct) * F.abs(expected), "review: correction exceeds the bound")
        .otherwise("corrected")
    )


def corrections(
    mismatches: DataFrame, ledger: DataFrame, max_pct: Decimal, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decide each amount mismatch against a fresh ledger read.

    ``mismatches``: journal_id, booked, statement_amount and the columns named in ``keep``, which
    tell apart mismatches of one journal. ``ledger`` has one row per split with a ``split_count``;
    groups of several splits, or of an unknown number, are refused, and so are journals without an
    id and those that the ledger no longer holds. Each mismatch gives one row.
    """
    fresh = ledger.groupBy("journal_id").agg(
        F.min("amount").alias("current"), F.min("tags").alias("tags"), F.min("foreign_amount").alias("foreign_amount"),
        F.min("foreign_currency").alias("foreign_currency"),
        F.greatest(F.max(F.coalesce("split_count", F.lit(0))), F.count("*")).alias("split_count"),
        F.min(F.coalesce("split_count", F.lit(0))).alias("_least"),
    )
    decision = (
        F.when(F.col("journal_id").isNull(), "review: journal has no id")
        .when(F.col("split_count").isNull(), "review: journal not found")
        .when(F.col("_least") < 1, "review: number of splits unknown")
        .when(F.col("split_count") != 1, "review: journal has several splits")
        .otherwise(correction_decision(F.col("current"), F.col("booked"), F.col("statement_amount"), max_pct))
    )
    audit = F.array(F.concat(F.lit(CORRECTION_TAG), decimal_text("booked")))
    decided = mismatches.join(fresh, "journal_id", "left").withColumn("decision", decision)
    applied = F.col("decision") == "corrected"
    return decided.select(
        *keep,
        "journal_id",
        "booked",
        "statement_amount",
        "current",
        "decision",
        F.when(applied, F.col("statement_amount")).otherwise(F.col("current")).alias("new_amount"),
        F.when(applied, F.array_union("tags", audit)).otherwise(F.col("tags")).alias("tags"),
        "foreign_amount",
        "foreign_currency",
    )


def resolve(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """The ledger as corrected: an append-only table of changes applied when read."""
    newest = (
        deltas.where(F.col("decision") == "corrected")
        .groupBy("journal_id")
        .agg(F.max_by(F.struct("new_amount", "tags"), "decided_at").alias("_new"))
    )
    joined = ledger.join(newest, "journal_id", "left")
    return joined.select(
        *[
            F.coalesce("_new.new_amount", "amount").alias("amount")
            if c == "amount"
            else F.coalesce("_new.tags", F.col("tags")).alias("tags")
            if c == "tags"
            else F.col(c)
            for c in ledger.columns
        ]
    )


def double_book(
    records: DataFrame,
    journals: DataFrame,
    aliases: DataFrame | None = None,
    params: ReconcileParams | None = None,
    asks: Column | None = None,
) -> DataFrame:
    """Add ``statement_journal_id``: the first statement booking on the record's account
    that is near in date and similar in name. Amount and currency are not compared.
    With ``asks`` only the records that fulfil it are compared, and others have none.

    Records are reduced to (account, day, name) cells and bookings to the smallest id of
    a cell, so the join works on distinct names rather than on rows.
    """
    p = params or ReconcileParams()
    cells = ["account_id", "txn_date", "_canon"]
    recs = canonical(records, "merchant", aliases, "_canon")
    booked = canonical(
        journals.where(F.col("external_id").startswith(STATEMENT_PREFIX)), "merchant", aliases, "_canon"
    )
    asking = recs if asks is None else recs.where(asks)
    left = asking.select(*cells).distinct().withColumn(
        "_bucket", F.explode(buckets_near(F.col("txn_date"), p.date_window_days))
    )
    right = (
        booked.groupBy(*cells)
        .agg(F.min("journal_id").alias("_journal"))
        .withColumn("_bucket", bucket_of(F.col("txn_date"), p.date_window_days))
    )
    keys = ["account_id", "_bucket"]
    pairs = similar_names(
        left.select(*keys, F.col("_canon").alias("name")),
        right.select(*keys, F.col("_canon").alias("name")),
        keys,
        p.merchant_gray,
    )
    hits = (
        left.withColumnRenamed("_canon", "name_a")
        .join(pairs, [*keys, "name_a"])
        .join(
            right.select(*keys, F.col("_canon").alias("name_b"), F.col("txn_date").alias("_booked_on"), "_journal"),
            [*keys, "name_b"],
        )
        .where(within_days("txn_date", "_booked_on", p.date_window_days))
        .groupBy("account_id", "txn_date", F.col("name_a").alias("_canon"))
        .agg(F.min("_journal").alias("statement_journal_id"))
    )
    found = F.col("statement_journal_id")
    found = found if asks is None else F.when(asks, found).alias("statement_journal_id")
    return recs.join(hits, cells, "left").select(*records.columns, found)
