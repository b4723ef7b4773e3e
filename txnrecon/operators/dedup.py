"""Stable keys and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.keys import dedup_key


def key(records: DataFrame) -> DataFrame:
    """Replace ``external_id`` by the key the ledger is asked for."""
    return records.withColumn("external_id", dedup_key())


def first_wins(records: DataFrame) -> DataFrame:
    """Add ``is_duplicate``: every use of a key after the first one in (msg_seq, rec_idx).

    The first use is an aggregate, combined before the shuffle, and joined back: a key
    that a third of all rows share is one row on one side of the join and split by the
    skew-join rule on the other, where a window would sort it in a single task.
    """
    position = F.struct("msg_seq", "rec_idx")
    first = records.groupBy("external_id").agg(F.min(position).alias("_first"))
    return records.join(first, "external_id").select(
        *records.columns, (position != F.col("_first")).alias("is_duplicate")
    )
