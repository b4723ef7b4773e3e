"""Incremental scan of a mailbox: messages created or changed since a cursor, still in the inbox.

The mailbox is a log of changes (msg_id, seq, in_inbox and the message's columns), cut into
partitions by stretches of ``seq``, so a scan reads the stretches after its cursor only, however
long the log is. Numbers are handed out in the order in which changes reach the log.

The cursor moves only after a clean run: a dry run writes nothing, and a run that had to defer a
message writes its outcomes but leaves the cursor, so the message is met again. What such a run
did settle is not decided twice: its outcomes are taken out of the next scan by message and
number. A run writes its outcomes first and its cursor last, each in a partition of its own, so
one that is killed in between repeats nothing and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.stage import materialize
from txnrecon.streaming import ingest

#: Numbers in one partition of the log.
STRETCH = 1_000_000
OUTCOMES = "msg_id STRING, seq BIGINT, outcome STRING, reason STRING, epoch BIGINT"
CURSOR = "last_seq BIGINT, epoch BIGINT"


def append(changes: DataFrame, log: str, stretch: int = STRETCH) -> None:
    """Add changes to a log. Rows that a retry adds again are harmless: of equal rows one counts."""
    cut = changes.withColumn("stretch", F.floor(F.col("seq") / stretch))
    cut.write.mode("append").partitionBy("stretch").parquet(log)


def cursor(spark: SparkSession, root: str) -> tuple[int, int | None]:
    """The newest clean run and the last number that it handled; -1 and None before the first. A run
    killed while it wrote its cursor has left no row."""
    saved = ingest.read_table(spark, f"{root}/cursor", CURSOR)
    newest = saved.agg(F.max(F.struct("epoch", "last_seq")).alias("s")).first()["s"]
    return (-1, None) if newest is None else (newest["epoch"], newest["last_seq"])


def since(spark: SparkSession, log: str, schema: str, after: int | None, stretch: int = STRETCH) -> DataFrame:
    """Changes after the cursor; partitions that end before it are not listed for reading."""
    changes = ingest.read_table(spark, log, f"{schema}, stretch BIGINT")
    if after is not None:
        changes = changes.where((F.col("stretch") >= after // stretch) & (F.col("seq") > after))
    return changes.drop("stretch")


def pending(changes: DataFrame, settled: DataFrame) -> DataFrame:
    """The newest change of every message that is in the inbox by it and was not settled at it.

    A message that left the inbox after it came is not handed out. ``settled``: msg_id, seq.
    """
    rows = changes.groupBy("msg_id").agg(F.max_by(F.struct("*"), F.struct("seq", "in_inbox")).alias("m"))
    return rows.select("m.*").where("in_inbox").join(settled, ["msg_id", "seq"], "left_anti")


def run(
    spark: SparkSession,
    root: str,
    log: str,
    schema: str,
    decide: Callable[[DataFrame], DataFrame],
    dry_run: bool = False,
    stretch: int = STRETCH,
) -> DataFrame:
    """One run over what is pending; its outcomes (msg_id, seq, outcome, reason).

    ``decide`` maps the messages to those columns, one row each; ``deferred`` is the outcome of
    a message that has to be met again. An empty or absent log gives no rows and no cursor.
    """
    clean, after = cursor(spark, root)
    new = since(spark, log, schema, after, stretch)
    # Fixed once: changes that arrive while the run works are the next run's.
    last = new.agg(F.max("seq")).first()[0]
    known = ingest.read_table(spark, f"{root}/outcomes", OUTCOMES)
    unsaved = known.where((F.col("epoch") > clean) & (F.col("outcome") != "deferred"))
    batch = pending(new.where(F.col("seq") <= F.lit(last)), unsaved.select("msg_id", "seq").distinct())
    decided = materialize(decide(batch).select("msg_id", "seq", "outcome", F.col("reason").cast("string").alias("reason")))
    if dry_run or last is None:
        return decided
    number = max([clean, *ingest.epochs(spark, f"{root}/outcomes")]) + 1
    ingest.write_epoch(decided, f"{root}/outcomes", number)
    if decided.where("outcome = 'deferred'").isEmpty():
        ingest.write_epoch(spark.range(1).select(F.lit(last).cast("bigint").alias("last_seq")), f"{root}/cursor", number)
    return decided
