"""From notification mail to one decision per message."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.operators import dedup, extract, fx, ledger, routing, router, validate
from txnrecon.stage import materialize


def decide_records(
    records: DataFrame,
    dims: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    booked: DataFrame,
    journals: DataFrame | None = None,
    aliases: DataFrame | None = None,
    max_usd: Decimal | None = None,
    dop_rates: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every extracted record, with its booking columns.

    Gates, ceiling and probe come first; only records that pass them compete for a key.
    ``booked`` holds the keys of the ledger; with ``journals`` the double-book probe runs
    for bank alerts.
    """
    gated = validate.gate(records)
    screened = validate.usd_ceiling(gated, rates, max_usd, dop_rates).withColumnRenamed("defer_reason", "ceiling_defer")
    placed = routing.accounts(screened, dims).withColumn("account_id", F.col("account_id").cast("bigint"))
    if journals is not None:
        # Only bank alerts that pass the gate are probed. The ceiling is left out: it would need the rates here, too.
        asks = (F.col("source") == "banco_popular") & F.col("review_reason").isNull()
        placed = ledger.double_book(placed, journals, aliases, asks=asks)
    else:
        placed = placed.withColumn("statement_journal_id", F.lit(None).cast("bigint"))
    known = fx.account_targets(placed, accounts)
    rated = fx.with_rate(known, rates, "currency", "account_currency", "txn_date", dop_rates)
    double = (F.col("source") == "banco_popular") & F.col("statement_journal_id").isNotNull()
    reason = F.coalesce(
        "review_reason", "ceiling_reason", F.when(double, validate.DOUBLE_BOOK), "route_reason"
    )
    passed_gate = F.col("review_reason").isNull()
    waits = passed_gate & (
        F.col("ceiling_defer").isNotNull()
        | (F.col("ceiling_reason").isNull() & ~double & F.col("route_reason").isNull() & F.col("defer_reason").isNotNull())
    )
    # Judged once, then read three times: to find first uses, to mark them, and for the rest.
    judged = materialize(
        dedup.key(fx.convert(rated).withColumn("_waits", waits).withColumn("_reason", F.when(~waits, reason)))
    )
    open_, closed = (
        judged.where(F.col("_reason").isNull() & ~F.col("_waits")),
        judged.where(F.col("_reason").isNotNull() | F.col("_waits")),
    )
    ranked = dedup.first_wins(open_)
    held = booked.select("external_id", F.lit(True).alias("_held")).distinct()
    ranked = ranked.join(held, "external_id", "left")
    repeated = F.col("is_duplicate") | F.coalesce("_held", F.lit(False))
    settled = ranked.withColumn("outcome", F.when(repeated, "duplicate").otherwise("booked")).drop("_held", "is_duplicate")
    rest = closed.withColumn("outcome", F.when(F.col("_waits"), "deferred").otherwise("review"))
    out = settled.unionByName(rest)
    return out.withColumn("reason", F.col("_reason")).drop("_waits", "_reason")


def decide_transfers(
    transfers: DataFrame,
    dims: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    booked: DataFrame,
    max_usd: Decimal | None = None,
    dop_rates: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every payment receipt and wire. ``transfers`` need msg_seq."""
    decided = ledger.book_transfers(transfers, dims, accounts, rates, max_usd, dop_rates)
    decided = materialize(decided.withColumn("rec_idx", F.lit(0)))
    waits = F.col("defer_reason").isNotNull() & F.col("review_reason").isNull()
    open_ = dedup.first_wins(decided.where(F.col("review_reason").isNull() & ~waits))
    held = booked.select("external_id", F.lit(True).alias("_held")).distinct()
    repeated = F.col("is_duplicate") | F.coalesce("_held", F.lit(False))
    settled = (
        open_.join(held, "external_id", "left")
        .withColumn("outcome", F.when(repeated, "duplicate").otherwise("booked"))
        .drop("_held", "is_duplicate")
    )
    rest = decided.where(F.col("review_reason").isNotNull() | waits).withColumn(
        "outcome", F.when(waits, "deferred").otherwise("review")
    )
    return settled.unionByName(rest).withColumnRenamed("review_reason", "reason")


def decide(
    messages: DataFrame,
    answer_fn: Callable[[pd.DataFrame], pd.Series],
    dims: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    booked: DataFrame,
    journals: DataFrame | None = None,
    aliases: DataFrame | None = None,
    max_usd: Decimal | None = None,
    dop_rates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dispositions (one row per message that is no statement), decided records, decided transfers."""
    # Written once, without what no branch reads again: every branch would unwrap all mail anew.
    body = F.when(F.col("branch").isin("model", "deterministic"), F.col("body"))
    sent = materialize(
        extract.dispatch(messages).select("msg_id", "msg_seq", "adapter", "branch", "branch_reason", body.alias("body"))
    )
    # The model stage is the expensive one and feeds several branches: what it yields is
    # written once, so neither a branch nor a lost executor asks the model again.
    extracted = materialize(extract.records(extract.model(sent, answer_fn)))
    settings = (dims, accounts, rates, booked)
    records = decide_records(
        extract.usable_records(extracted), *settings, journals, aliases, max_usd, dop_rates
    )
    transfers = decide_transfers(extract.deterministic(sent), *settings, max_usd, dop_rates)
    seen = ["msg_id", "adapter", "rec_idx", "outcome", "reason"]
    failed = extracted.where((F.col("message_error").isNotNull() | F.col("skip_reason").isNotNull()) & (F.col("rec_idx") == 0))
    unread = failed.withColumn(
        "outcome", F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("review")
    ).withColumn("reason", F.col("message_error"))
    plain = (
        sent.where(F.col("branch").isin("skip", "review"))
        .withColumn("rec_idx", F.lit(0))
        .withColumn("outcome", F.when(F.col("branch") == "skip", "skipped").otherwise("review"))
        .withColumn("reason", F.when(F.col("branch") == "review", F.col("branch_reason")))
    )
    rows = plain.select(seen)
    for part in (unread, records, transfers):
        rows = rows.unionByName(part.select(seen))
    sourced = rows.withColumn("source", F.coalesce("adapter", F.lit("unknown")))
    return router.dispositions(sourced), records, transfers
