"""Labelled examples: ``<stem>.txt`` with its ``<stem>.json`` label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = (
    "`from` STRING, kind STRING, amount STRING, currency STRING, direction STRING, date STRING, "
    "merchant STRING, status STRING, routed_account STRING"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """example, text and the label fields of every pair under ``path``."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*\z", 1)
    texts = (
        spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        .select(stem.alias("example"), F.col("value").alias("text"))
    )
    labels = (
        spark.read.option("pathGlobFilter", "*.json").schema(LABEL).json(path, multiLine=True)
        .select(stem.alias("example"), "*")
        .withColumnRenamed("from", "from_hdr")
    )
    return texts.join(labels, "example")


def in_order(examples: DataFrame) -> DataFrame:
    """Examples by name, for output; scores need no order."""
    return examples.orderBy("example")
