"""Alerts that come after a statement has booked their charge.

A micro-batch of alerts is probed against the ledger by month: it reads the months around its own
dates, on its own accounts, however long the ledger is. Results of an epoch replace what an earlier
attempt of it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.keys import STATEMENT_PREFIX
from txnrecon.operators import ledger as ledger_ops
from txnrecon.operators.params import ReconcileParams
from txnrecon.sources import ledger_table
from txnrecon.stage import materialize
from txnrecon.streaming import ingest


def probe(alerts: DataFrame, ledger: DataFrame, aliases: DataFrame | None = None, params: ReconcileParams | None = None) -> DataFrame:
    """Add ``statement_journal_id`` to alerts (account_id, txn_date, merchant and others): the
    statement booking near it, or null. An alert without account or date has none."""
    days = (params or ReconcileParams()).date_window_days
    asked = alerts.select(
        "account_id", F.date_sub("txn_date", days).alias("since"), F.date_add("txn_date", days).alias("until")
    )
    statements = ledger.where(F.col("external_id").startswith(STATEMENT_PREFIX))
    # Few of the ledger's rows, read for the names, the blocks and the join back.
    near = materialize(ledger_table.within(statements, asked.distinct()))
    return ledger_ops.double_book(alerts, near, aliases, params)


def run(
    alerts: DataFrame,
    ledger: DataFrame,
    root: str,
    aliases: DataFrame | None = None,
    params: ReconcileParams | None = None,
    available_now: bool = True,
):
    """Start the stream; its results are written under ``root``/late by epoch."""

    def settle(batch: DataFrame, epoch: int) -> None:
        ingest.write_epoch(probe(materialize(batch), ledger, aliases, params), f"{root}/late", epoch)

    writer = alerts.writeStream.option("checkpointLocation", f"{root}/_late").foreachBatch(settle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
