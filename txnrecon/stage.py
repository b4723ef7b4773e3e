"""Stage boundaries: results that several branches read are computed once and written to
storage every executor can reach."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it. Only where none is named
    (a local session) a local one is used."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder")
    import tempfile

    folder = os.path.join(tempfile.gettempdir(), f"txnrecon-{spark.sparkContext.applicationId}")
    return f"file://{folder}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute a stage once, as Parquet in the shared folder, where it outlives executors. Readers
    take the columns they need and the sizes that were written; the folder may be deleted once a
    job has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
