"""Helpers the operators share: reading tables, written stages, row keys, guarded broadcasts."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.plans import session
from txnrecon.stage import shared_folder

#: Most rows a side may have to be broadcast; the rows broadcast here are a few numbers wide.
BROADCAST_ROWS = 200_000
#: Rows handed to Python at once: whole texts are carried, so fewer than Spark's default.
BATCH_ROWS = 1_000
#: Bytes of such a batch; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session settings the operators rely on."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute a stage once, as Parquet in the shared folder, and read it back: later steps
    neither repeat it nor depend on the executors that computed it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a (written) side for broadcast if it has at most ``rows`` rows; larger sides are
    left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: str = "text") -> Column:
    """Hash of the text: with doc_id it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; made on the driver and sent with a function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def per_worker(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks, until another
    operator's is asked for: a worker that goes on to the next stage keeps nothing of the last."""
    kept = vars(sys).setdefault("_txnrecon_llm", {})
    if name not in kept:
        import pyarrow as pa

        kept.clear()
        pa.default_memory_pool().release_unused()
    return kept.setdefault(name, {})


def columns_like(df: DataFrame, *names: str) -> list[str]:
    """The names given, as the frame spells them, refusing absent ones."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return list(names)


class Pool:
    """Arrays of many words in a row."""

    def __init__(self):
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        begin = len(self.flat) + np.cumsum(size) - size
        self.begin, self.size = np.append(self.begin, begin), np.append(self.size, size)
        self.flat = np.append(self.flat, flat.astype(np.int32))

    def of(self, words: np.ndarray) -> Pool:
        """A pool of the words given."""
        kept = Pool()
        kept.add(self.take(words), self.size[words])
        return kept

    def take(self, words: np.ndarray) -> np.ndarray:
        """The arrays of the words given, one after the other."""
        size = self.size[words]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[words] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at]
