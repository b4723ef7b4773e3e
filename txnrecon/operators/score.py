"""Field-by-field accuracy of extraction models against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.numbers import loose_amount, ratio
from txnrecon.functions.status import status_class
from txnrecon.functions.text import canon_merchant, utrim
from txnrecon.operators.routing import logical_account

FIELDS = ("kind", "amount", "currency", "direction", "date", "merchant", "status", "account")
TRANSACTION = "transaction"


def project_labels(labels: DataFrame) -> DataFrame:
    """Labels in the comparable shape."""
    return labels.select(
        "example",
        F.col("kind"),
        loose_amount("amount").alias("amount"),
        F.upper(utrim("currency")).alias("currency"),
        "direction",
        F.col("date").cast("date").alias("date"),
        canon_merchant("merchant").alias("merchant"),
        "status",
        F.col("routed_account").alias("account"),
    )


def project_records(records: DataFrame) -> DataFrame:
    """The first record a model gave per example, in the comparable shape: status reduced to
    its class and the account derived by the booking rules."""
    shaped = records.select(
        "model",
        "example",
        "rec_idx",
        F.lit(TRANSACTION).alias("kind"),
        F.col("amount").cast("decimal(20,4)").alias("amount"),
        F.upper(utrim("currency")).alias("currency"),
        "direction",
        F.col("txn_date").alias("date"),
        canon_merchant("merchant").alias("merchant"),
        status_class("status").alias("status"),
        logical_account().alias("account"),
    )
    return shaped.groupBy("model", "example").agg(
        F.min_by(F.struct(*FIELDS), "rec_idx").alias("_r")
    ).select("model", "example", "_r.*")


def project(expected: DataFrame, models: DataFrame, produced: DataFrame) -> DataFrame:
    """Every label against every model. An example a model gave nothing for counts as "not
    a transaction". ``models`` is the configured list; each label row fans out over it."""
    names = models.agg(F.collect_set("model")).scalar()
    wanted = expected.select(
        F.explode(names).alias("model"), "example", *[F.col(f).alias(f"exp_{f}") for f in FIELDS]
    )
    got = produced.select("model", "example", *[F.col(f).alias(f"got_{f}") for f in FIELDS])
    joined = wanted.join(got, ["model", "example"], "left")
    return joined.withColumn("got_kind", F.coalesce("got_kind", F.lit("not_a_transaction")))


def field_score(expected: Column, produced: Column) -> Column:
    """na without an expected value, else correct or wrong; a missing answer is wrong."""
    return F.when(expected.isNull(), "na").when(expected.eqNullSafe(produced), "correct").otherwise("wrong")


def fields(projected: DataFrame) -> DataFrame:
    """model, example, field, score. Only ``kind`` applies to labels that are no transaction."""
    is_txn = F.col("exp_kind") == TRANSACTION
    scores = []
    for f in FIELDS:
        score = field_score(F.col(f"exp_{f}"), F.col(f"got_{f}"))
        if f != "kind":
            score = F.when(is_txn, score).otherwise("na")
        scores.append(F.struct(F.lit(f).alias("field"), score.alias("score")))
    return projected.select("model", "example", F.inline(F.array(*scores)))


def tally(scores: DataFrame) -> DataFrame:
    """Correct, applicable and accuracy per model and field; the OVERALL row sums the fields."""
    counted = scores.rollup("model", "field").agg(
        F.count_if(F.col("score") == "correct").alias("correct"),
        F.count_if(F.col("score") != "na").alias("applicable"),
    )
    return counted.where(F.col("model").isNotNull()).select(
        "model",
        F.coalesce("field", F.lit("OVERALL")).alias("field"),
        "correct",
        "applicable",
        ratio(F.col("correct"), F.col("applicable")).alias("accuracy"),
    )


def matrix(tallied: DataFrame) -> DataFrame:
    """One row per model, one accuracy column per field and OVERALL."""
    return tallied.groupBy("model").pivot("field", [*FIELDS, "OVERALL"]).agg(F.max("accuracy"))
