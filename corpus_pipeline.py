"""A corpus from documents: without toxic texts, near-copies and benchmark passages, mixed to
target weights, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``docs``
may have further columns, of any name, which all but the last stage hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrecon.llm import common, decontaminate, mix, queries, simhash, token_store, toxicity

TOXIC_FROM = 0.3
#: The result can't be expressed in SQL: a trained network decides in the first stage.
ORACLE_SQL = None


def _key(text_key: Column) -> Column:
    """A row's identity: its id, which may be null, and the hash of its text."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), text_key)


def _packed(docs: DataFrame) -> DataFrame:
    """key, row: rows as one struct, so that no column of theirs can clash."""
    return docs.select(_key(common.text_key()).alias("key"), F.struct("*").alias("row"))


def _keys(found: DataFrame) -> DataFrame:
    return common.written(found.select(_key(F.col("text_key")).alias("key")).distinct(), "keys")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below 0.3."""
    common.ready(spark)
    learn = common.crc_mod("doc_id", 4) != 2
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), learn)
    return toxicity.scored(docs, net).where(F.col("score") < TOXIC_FROM).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, one row of those that repeat it."""
    common.ready(spark)
    kept = _keys(simhash.near_duplicates(docs).where("kept"))
    once = Window.partitionBy("key").orderBy(F.xxhash64("row.text"))
    chosen = _packed(docs).join(kept, "key", "left_semi")
    return chosen.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    common.ready(spark)
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    hit = common.narrow(_keys(found.where("n_hit > 0")))
    return _packed(docs).join(hit, "key", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per time the mix takes a document; one taken in part is cut after the words taken,
    which are then parted by single spaces."""
    common.ready(spark)
    known, placements = mix.mix(docs)
    source = [F.coalesce(F.col("source"), F.lit("")).alias("of"), F.col("source").isNull().alias("of_none")]
    keyed = lambda found, *more: found.select(F.struct(_key(F.col("text_key")).alias("row"), *source).alias("key"), *more)
    turn = Window.partitionBy("key", "pass").orderBy("begin")
    taken = keyed(placements, "pass", "begin", "words")
    taken = common.written(taken.withColumn("nth", F.row_number().over(turn)).drop("begin"), "taken")
    # Rows of a source that repeat one another have one key: all of those are numbered, however often
    # the mix takes them, to meet their own turns.
    often = keyed(known.where("size > 0")).groupBy("key").count().where("count > 1")
    repeated = common.narrow(common.written(often.select("key"), "repeated"))
    rows = docs.select(F.struct(_key(common.text_key()).alias("row"), *source).alias("key"), F.struct("*").alias("row"))
    single = rows.join(repeated, "key", "left_anti").withColumn("nth", F.lit(1))
    again = Window.partitionBy("key").orderBy(F.xxhash64("row.text"))
    several = rows.join(repeated, "key", "left_semi").withColumn("nth", F.row_number().over(again))
    met = single.unionByName(several).join(taken, ["key", "nth"])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(mix.WORD), F.lit(0))
    whole = mix.word_count(F.col("row.text")) <= F.col("words")
    cut = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    parts = {"text": cut}
    if "n_chars" in docs.columns:
        parts["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return met.select(*[parts.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: read back from a token store of all documents."""
    common.ready(spark)
    path = common.new_folder(spark, "tokens")
    token_store.write(docs, path, queries.public_tokenizer("byte_bpe_50k.json"), end_id=2)
    store = token_store.read(spark, path)
    return token_store.starts(store).select("doc_id", "start", "n_tokens", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = common.table(common.ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
