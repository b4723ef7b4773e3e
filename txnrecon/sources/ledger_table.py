"""The ledger as a table by month: date windows read their months and skip the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files that a month's accounts are dealt to.
FILES = 16
#: Days asked for that may be broadcast.
FEW_DAYS = 100_000


def write(journals: DataFrame, path: str, files: int = FILES, mode: str = "append") -> None:
    """Write journals (account_id, txn_date and others) by month, accounts together in a month.

    Rows are dealt by month and account hash; an account that holds much of a month is split
    by adaptive execution, as the rebalance hint allows. Journals without a date have a
    partition of their own, which no window reads.
    """
    dealt = journals.withColumn("month", F.trunc("txn_date", "MM")).withColumn(
        "_file", F.pmod(F.xxhash64("account_id"), F.lit(files))
    )
    sorted_ = dealt.hint("rebalance", "month", "_file").drop("_file").sortWithinPartitions("month", "account_id", "txn_date")
    sorted_.write.mode(mode).partitionBy("month").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table; ``schema`` is that of the journals written."""
    return spark.read.schema(StructType(list(schema.fields)).add("month", "date")).parquet(path)


def within(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """Journals of the accounts and dates asked for, each once.

    ``asked``: account_id, since, until (inclusive); several windows of an account may overlap.
    The first and last month are subqueries on the partition column, so they are known before
    files are listed for reading.
    """
    first = asked.agg(F.trunc(F.min("since"), "MM")).scalar()
    last = asked.agg(F.max("until")).scalar()
    # Days instead of ranges: an account with many windows and journals meets them by equality.
    days = asked.where(F.col("since") <= F.col("until")).select(
        "account_id", F.explode(F.sequence("since", "until")).alias("txn_date")
    )
    days = days.distinct()
    # Spark takes the days to be as large as the windows they are spread from, and would send any
    # number of them through the driver.
    if days.limit(FEW_DAYS + 1).count() > FEW_DAYS:
        days = days.hint("merge")
    near = ledger.where(F.col("month").between(first, last))
    return near.join(days, ["account_id", "txn_date"], "left_semi").select(*ledger.columns).drop("month")
