"""From statement rows to a report per statement."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.keys import STATEMENT_PREFIX
from txnrecon.operators import ledger, reconcile, routing, statement, validate
from txnrecon.operators.params import ReconcileParams
from txnrecon.stage import materialize

SCOPE = ("stmt_id", "section_no")


def decide(
    rows: DataFrame,
    dims: DataFrame,
    journals: DataFrame,
    rates: DataFrame,
    aliases: DataFrame | None = None,
    max_usd: Decimal | None = None,
    autocorrect_pct: Decimal | None = None,
    fresh_ledger: DataFrame | None = None,
    params: ReconcileParams | None = None,
    dop_rates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outcome rows (stmt_id, section_no, reference, outcome, reason) and balances per section.

    Charges are reconciled within their section against the journals of its account around
    the cut date. Without ``autocorrect_pct`` every amount mismatch is a finding; with it,
    corrections are decided against ``fresh_ledger`` (or modelled as unchanged in a dry run).
    Statements that do not parse are one review each. A charge or payment whose key the ledger
    already holds, at any date, is reconciled and not booked again.
    """
    context = materialize(statement.contextual(rows))
    broken = statement.statement_errors(context)
    parsed = context.join(broken, "stmt_id", "left_anti")
    sections = routing.section_accounts(statement.sections(parsed), dims)
    txns = statement.transactions(parsed)
    keyed = [*SCOPE]

    placed = txns.join(sections.select(*keyed, "account_id", "last4"), keyed)
    unrouted = placed.where(F.col("account_id").isNull()).select(
        *keyed, "reference", F.lit("review").alias("outcome"), F.lit("no card account configured").alias("reason")
    )
    routed = placed.where(F.col("account_id").isNotNull())

    charges = routed.where("direction = 'out'").select(
        *keyed, F.col("txn_no").alias("charge_id"), "reference", "merchant", "amount", "currency", "auth_date", "mcc"
    )
    window = statement.journal_window(
        sections.where(F.col("account_id").isNotNull()), journals.withColumn("account_id", F.col("account_id").cast("string"))
    )
    asked = materialize(reconcile.intents(charges, window, aliases, params, SCOPE))
    found = materialize(reconcile.resolve(asked, window, params, SCOPE))

    settled = found.where("outcome = 'confirmed'").select(
        *keyed, "reference", F.lit("reconciled").alias("outcome"), F.lit(None).cast("string").alias("reason")
    )
    reviewed = found.where("outcome = 'review'").select(*keyed, "reference", "outcome", "reason")
    mismatched = _mismatches(found.where("outcome = 'mismatch'"), window, autocorrect_pct, fresh_ledger)
    unmatched = reconcile.unmatched(window, found, SCOPE).select(
        *keyed,
        F.col("journal_id").cast("string").alias("reference"),
        F.lit("unmatched_booked").alias("outcome"),
        F.lit(None).cast("string").alias("reason"),
    )
    new = charges.join(found.where("outcome = 'book_new'").select(*keyed, F.col("charge_id")), [*keyed, "charge_id"])
    payments = _book_payments(routed.where("direction = 'in'"), rates, dims, max_usd, dop_rates)
    booked = _book_once(materialize(_book_charges(new, rates, max_usd, dop_rates).unionByName(payments)), journals)
    failed = broken.select(
        "stmt_id", F.lit(0).cast("bigint").alias("section_no"), F.lit(None).cast("string").alias("reference"),
        F.lit("review").alias("outcome"), F.col("parse_error").alias("reason"),
    )
    out = settled
    for part in (reviewed, mismatched, unmatched, booked, unrouted, failed):
        out = out.unionByName(part)
    balances = statement.balance(sections.where(F.col("account_id").isNotNull()), txns)
    return out, balances


def _mismatches(
    found: DataFrame, window: DataFrame, autocorrect_pct: Decimal | None, fresh_ledger: DataFrame | None
) -> DataFrame:
    keyed = [*SCOPE]
    if autocorrect_pct is None:
        return found.select(
            *keyed, "reference", F.lit("amount_mismatch").alias("outcome"), F.lit(None).cast("string").alias("reason")
        )
    if fresh_ledger is None:
        # Dry run: the journal is taken to be as it was read.
        decision = ledger.correction_decision(F.col("booked"), F.col("booked"), F.col("amount"), autocorrect_pct)
        decided = found.withColumn("decision", decision)
    else:
        asks = found.select(*keyed, "reference", "journal_id", "booked", F.col("amount").alias("statement_amount"))
        decided = ledger.corrections(asks, fresh_ledger, autocorrect_pct, (*SCOPE, "reference"))
    fixed = F.col("decision").isin("noop", "corrected")
    return decided.select(
        *keyed,
        "reference",
        F.when(fixed, "corrected").otherwise("amount_mismatch").alias("outcome"),
        F.when(~fixed, F.col("decision")).alias("reason"),
    )


def _book_charges(new: DataFrame, rates: DataFrame, max_usd: Decimal | None, dop_rates: DataFrame | None) -> DataFrame:
    records = statement.as_records(new.withColumn("direction", F.lit("out")))
    checked = validate.usd_ceiling(validate.gate(records), rates, max_usd, dop_rates)
    reason = F.coalesce("review_reason", "ceiling_reason")
    waits = F.col("review_reason").isNull() & F.col("defer_reason").isNotNull()
    return checked.select(
        *SCOPE,
        F.col("charge_id").alias("txn_no"),
        "reference",
        "external_id",
        F.when(waits, "deferred").when(reason.isNotNull(), "review").otherwise("booked_new").alias("outcome"),
        F.when(~waits, reason).alias("reason"),
    )


def _book_payments(
    payments: DataFrame, rates: DataFrame, dims: DataFrame, max_usd: Decimal | None, dop_rates: DataFrame | None
) -> DataFrame:
    """Payments become transfers: ceiling, gate, then the two accounts."""
    records = statement.as_records(payments).withColumn("description", F.col("merchant"))
    checked = validate.usd_ceiling(records, rates, max_usd, dop_rates)
    routed = routing.statement_transfer_accounts(checked, dims)
    reason = F.coalesce("ceiling_reason", validate.transfer_reason(), "route_reason")
    waits = F.col("defer_reason").isNotNull()
    return routed.select(
        *SCOPE,
        "txn_no",
        "reference",
        "external_id",
        F.when(waits, "deferred").when(reason.isNotNull(), "review").otherwise("payments_booked").alias("outcome"),
        F.when(~waits, reason).alias("reason"),
    )


def _book_once(decided: DataFrame, journals: DataFrame) -> DataFrame:
    """Bookings whose key the ledger holds become reconciled, and so does all but the first of those
    that share a key in this run; other outcomes stay."""
    held = (
        journals.where(F.col("external_id").startswith(STATEMENT_PREFIX))
        .select("external_id", F.lit(True).alias("_held"))
        .distinct()
    )
    books = F.col("outcome").isin("booked_new", "payments_booked")
    place = F.struct(*SCOPE, "txn_no")
    first = decided.where(books).groupBy("external_id").agg(F.min(place).alias("_first"))
    again = books & (F.coalesce("_held", F.lit(False)) | (place > F.col("_first")))
    outcome = F.when(again, "reconciled").otherwise(F.col("outcome"))
    met = decided.join(held, "external_id", "left").join(first, "external_id", "left")
    return met.select(*SCOPE, "reference", outcome.alias("outcome"), "reason")


def report(
    rows: DataFrame,
    dims: DataFrame,
    journals: DataFrame,
    rates: DataFrame,
    **options,
) -> DataFrame:
    """One row per statement with its counters, balance check and ``is_clean``."""
    outcomes, balances = decide(rows, dims, journals, rates, **options)
    return statement.report(outcomes, balances)
