"""Incremental booking: each message is decided at least once and booked once.

A micro-batch is joined with the messages deferred before it, decided by the same plan as
a batch run, and written. Offsets are kept by the checkpoint; a row that has to wait is
kept in the ``deferred`` table, so it holds back nothing else. Booking is idempotent: keys
already in the ledger are duplicates, and every write of an epoch replaces that epoch's own
partition, so a repeated epoch leaves the tables as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.operators import dedup
from txnrecon.stage import materialize

LEDGER_COLUMNS = "external_id STRING, msg_id STRING, epoch BIGINT"


def read_new(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Messages from a folder of Parquet files, new files only."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


# Stream epochs are spaced so that retries between two of them get numbers of their own.
SPACING = 1_000_000


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs written under ``path``, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Write the rows of an epoch, replacing what an earlier attempt of it left."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def book_once(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``outcome``: booked for the first use of a key the ledger does not hold, else duplicate.

    ``records``: msg_id, msg_seq, rec_idx, external_id.
    """
    held = ledger.select("external_id", F.lit(True).alias("_held")).distinct()
    ranked = dedup.first_wins(records).join(held, "external_id", "left")
    repeated = F.col("is_duplicate") | F.coalesce("_held", F.lit(False))
    return ranked.withColumn("outcome", F.when(repeated, "duplicate").otherwise("booked")).drop("_held", "is_duplicate")


def newest(versions: DataFrame) -> DataFrame:
    """Of several versions of a message the newest, of equally new ones the one just come (``_come``).

    The order goes before the message's other columns, so each is moved once.
    """
    columns = [c for c in versions.columns if c != "_come"]
    rest = [c for c in columns if c not in ("msg_id", "msg_seq")]
    tie = F.xxhash64(F.struct(*columns)).alias("_tie")
    best = versions.groupBy("msg_id").agg(F.max(F.struct("msg_seq", "_come", tie, *rest)).alias("_m"))
    return best.select("msg_id", "_m.*").select(*columns)


def settle_epoch(
    batch: DataFrame,
    epoch: int,
    root: str,
    decide: Callable[[DataFrame], DataFrame],
    message_schema: str,
) -> None:
    """Decide one micro-batch and write its tables under ``root``.

    ``decide`` maps messages to record rows: msg_id, msg_seq, rec_idx, external_id, outcome
    (open, review, skipped or deferred) and reason. Open rows are booked or found duplicate.
    """
    spark = batch.sparkSession
    earlier = [e for e in epochs(spark, f"{root}/deferred") if e < epoch]
    waiting = read_table(spark, f"{root}/deferred", f"{message_schema}, epoch BIGINT").where(
        F.col("epoch") == (earlier[-1] if earlier else -1)
    )
    booked_before = read_table(spark, f"{root}/ledger", LEDGER_COLUMNS).where(F.col("epoch") < epoch)
    versions = batch.withColumn("_come", F.lit(1)).unionByName(waiting.select(*batch.columns, F.lit(0).alias("_come")))
    decided = materialize(decide(newest(versions)))
    # Written first: few messages wait as a rule, and a small table is met without moving the others.
    held = materialize(decided.where(F.col("outcome") == "deferred").select("msg_id").distinct())
    waits = decided.join(held.withColumn("_waits", F.lit(True)), "msg_id", "left")
    marked = waits.withColumn("outcome", F.when(F.col("_waits"), "deferred").otherwise(F.col("outcome"))).drop("_waits")
    open_rows = book_once(marked.where(F.col("outcome") == "open").drop("outcome"), booked_before)
    # What follows is read from the outcomes as written.
    outcomes = open_rows.unionByName(marked.where(F.col("outcome") != "open"))
    write_epoch(outcomes, f"{root}/outcomes", epoch)
    settled = spark.read.schema(outcomes.schema).parquet(f"{root}/outcomes/epoch={epoch}")
    write_epoch(settled.where(F.col("outcome") == "booked").select("external_id", "msg_id"), f"{root}/ledger", epoch)
    write_epoch(newest(versions.join(held, "msg_id", "left_semi")), f"{root}/deferred", epoch)


def run(
    source: DataFrame,
    root: str,
    decide: Callable[[DataFrame], DataFrame],
    message_schema: str,
    available_now: bool = True,
):
    """Start the stream; with ``available_now`` it handles what is there and ends."""
    writer = (
        source.writeStream.option("checkpointLocation", f"{root}/_checkpoint")
        .foreachBatch(lambda batch, epoch: settle_epoch(batch, epoch * SPACING, root, decide, message_schema))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def retry_deferred(
    spark: SparkSession, root: str, decide: Callable[[DataFrame], DataFrame], message_schema: str
) -> None:
    """Decide the waiting messages again, for a run that found nothing new."""
    known = epochs(spark, f"{root}/deferred")
    if known:
        settle_epoch(spark.createDataFrame([], message_schema), known[-1] + 1, root, decide, message_schema)


def bounded_dedup(records: DataFrame, ts: str = "received_at", horizon: str = "3 days") -> DataFrame:
    """Drop repeats of a key within a bounded time; the ledger check covers older ones."""
    return records.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["external_id"])
