"""Fetched rates kept from run to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.operators import fx
from txnrecon.stage import materialize
from txnrecon.streaming import ingest

ENTRY = "from_ccy STRING, to_ccy STRING, rate_date DATE, rate DECIMAL(28,12), fetched_at TIMESTAMP, epoch BIGINT"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries; a cache that was never written is empty."""
    return ingest.read_table(spark, path, ENTRY)


def refresh(
    spark: SparkSession, path: str, needed: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, run: int
) -> DataFrame:
    """Fetch the keys that no fresh entry serves, and keep what came; the entries of this run.

    ``needed``: from_ccy, to_ccy, rate_date. ``fetch`` maps such keys to rows with ``rate``; a key
    it has no rate for is not kept and is asked again by the next run. A run repeated under its
    number replaces its own entries.
    """
    earlier = read(spark, path).where(F.col("epoch") != run)
    keys = materialize(fx.stale_keys(needed, earlier, now))
    rate = F.col("rate").cast("decimal(28,12)")
    found = fetch(keys).where(rate.isNotNull()).select("from_ccy", "to_ccy", "rate_date", rate.alias("rate"), now.cast("timestamp").alias("fetched_at"))
    kept = materialize(found)
    ingest.write_epoch(kept, path, run)
    return kept


def compacted(entries: DataFrame, now: Column) -> DataFrame:
    """The newest entry of each key, without those that have expired: a smaller cache of the same use."""
    return fx.latest_rates(entries).where(fx.is_fresh(F.col("rate_date"), F.col("fetched_at"), now))
