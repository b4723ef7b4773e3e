"""One disposition per message, and where the message goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.operators.validate import NOTHING_BOOKED


def dispositions(records: DataFrame) -> DataFrame:
    """Fold record outcomes into one row per message.

    ``records``: msg_id, source, rec_idx, outcome (booked/duplicate/skipped/review/deferred),
    reason. A deferral holds the whole message; otherwise any booked record beats any
    duplicate, a skip is clean, and a review carries the *first* reason.
    """

    def any_of(outcome: str) -> Column:
        return F.coalesce(F.bool_or(F.col("outcome") == outcome), F.lit(False))

    reviewed = (F.col("outcome") == "review") & F.col("reason").isNotNull()
    folded = records.groupBy("msg_id").agg(
        F.max("source").alias("source"),
        any_of("deferred").alias("_deferred"),
        any_of("booked").alias("_booked"),
        any_of("duplicate").alias("_duplicate"),
        any_of("skipped").alias("_skipped"),
        F.min_by("reason", F.when(reviewed, F.col("rec_idx"))).alias("_reason"),
    )
    disposition = (
        F.when(F.col("_deferred"), "deferred")
        .when(F.col("_booked"), "booked")
        .when(F.col("_duplicate"), "duplicate")
        .when(F.col("_skipped"), "skipped")
        .otherwise("review")
    )
    return folded.select(
        "msg_id",
        "source",
        disposition.alias("disposition"),
        F.when(disposition == "review", F.coalesce("_reason", F.lit(NOTHING_BOOKED))).alias("reason"),
    )


def routed(dispositions_df: DataFrame) -> DataFrame:
    """Add the folder a message moves to; deferred messages stay."""
    route = (
        F.when(F.col("disposition") == "deferred", "deferred")
        .when(F.col("disposition") == "review", "review")
        .otherwise("processed")
    )
    return dispositions_df.withColumn("route", route)


def write_routed(dispositions_df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Append messages to the table of their route; a dry run only returns the plan."""
    plan = routed(dispositions_df)
    if not dry_run:
        plan.write.mode("append").partitionBy("route").parquet(path)
    return plan


def http_failure(status: Column) -> Column:
    """Whether a failed call is worth retrying: server errors, 408, 429 or no answer at all."""
    transient = status.isNull() | status.between(500, 599) | status.isin(408, 429)
    return F.when(transient, "defer").otherwise("review")
