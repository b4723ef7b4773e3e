"""One key holding a third of all rows: results stay whole and no task gets the pairs."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from txnrecon import schema
from txnrecon.operators import dedup, ordered, reconcile, router

DAY = datetime.date(2026, 4, 20)
N = 30_000


def hot(spark, n=N):
    """ids 0..n-1; every third belongs to account 0, the rest to accounts of their own."""
    i = F.col("id")
    return spark.range(n).withColumn("account_id", F.when(i % 3 == 0, 0).otherwise(i)).withColumn("day", F.lit(DAY))


def test_hot_cell_of_equal_charges_and_journals(spark):
    """Ten thousand equal charges meet ten thousand equal journals: one cell each, not 10^8 pairs."""
    base = hot(spark)
    charges = base.select(
        "account_id", F.col("id").alias("charge_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("reference"),
        F.lit("Corner Shop").alias("merchant"), F.lit(10).cast("decimal(18,4)").alias("amount"), F.lit("USD").alias("currency"),
        F.col("day").alias("auth_date"),
    )
    journals = base.select(
        "account_id", F.col("id").alias("journal_id"), F.col("day").alias("txn_date"), F.lit(10).cast("decimal(18,4)").alias("amount"),
        F.lit("USD").alias("currency"), F.lit("corner  shop").alias("merchant"), F.lit(None).cast("string").alias("external_id"),
    )
    asked = reconcile.intents(charges, journals)
    got = {(r.hot, r.intent): (r.n, r.p) for r in asked.groupBy((F.col("account_id") == 0).alias("hot"), "intent")
           .agg(F.count("*").alias("n"), F.max("n_plausible").alias("p")).collect()}
    assert got == {(True, "review_ambiguous"): (N // 3, N // 3), (False, "claim"): (N - N // 3, 1)}


def test_hot_journal_claimed_by_a_third_of_all_charges(spark):
    base = hot(spark)
    charges = base.select(
        "account_id", F.col("id").alias("charge_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("reference"),
        F.lit("Corner Shop").alias("merchant"), (F.col("id") * 10 + 10).cast("decimal(18,4)").alias("amount"),
        F.lit("USD").alias("currency"), F.col("day").alias("auth_date"),
    )
    journals = spark.createDataFrame([(0, 1, DAY, Decimal("10.5"), "USD", "Corner Shop", None)], schema.JOURNALS)
    decided = reconcile.outcomes(charges, journals)
    got = {r.outcome: r.n for r in decided.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"mismatch": 1, "book_new": N - 1}
    assert decided.where("journal_id is not null").collect()[0].charge_id == 0


def test_hot_key_books_once(spark):
    records = hot(spark).select(
        F.when(F.col("account_id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("external_id"),
        (F.lit(N) - F.col("id")).alias("msg_seq"), F.lit(0).alias("rec_idx"),
    )
    ranked = dedup.first_wins(records)
    assert ranked.count() == N and ranked.where("is_duplicate").count() == N // 3 - 1
    assert ranked.where("external_id = 'hot' and not is_duplicate").collect()[0].msg_seq == 3


def test_hot_group_is_numbered_in_chunks(spark):
    got = ordered.ordinal(hot(spark).where("account_id = 0"), ["account_id"], "id", "n", width=1000)
    assert got.where(F.col("n") != F.col("id") / 3 + 1).count() == 0 and got.count() == N // 3


def test_hot_message(spark):
    rows = hot(spark).select(
        F.when(F.col("account_id") == 0, "m").otherwise(F.col("id").cast("string")).alias("msg_id"),
        F.lit("s").alias("source"), F.col("id").alias("rec_idx"), F.lit("review").alias("outcome"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("reason"),
    )
    assert router.dispositions(rows).where("msg_id = 'm'").collect()[0].reason == "r0"
