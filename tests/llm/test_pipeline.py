"""The pipeline's stages on rows with planted cases, and the registered queries with SQL."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tools import check
from txnrecon.llm import common, mix, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, sf, name):
    frame = contract.queries()[name](spark, sf)
    rel = check.connect(sf).sql(queries.ORACLE[name])
    assert check.rows_of(frame.columns, frame.collect()) == check.rows_of(rel.columns, rel.fetchall())


def test_every_operator_is_registered():
    names = contract.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and "pipeline" in names


def test_stages_hand_on_columns(spark, sf):
    common.ready(spark)
    base = common.table(spark, sf, "documents").limit(60)
    rows = base.withColumn("row", F.lit("a")).withColumn("key", F.lit(1)).withColumn("score", F.lit("s"))
    rows = common.written(rows.unionAll(rows.limit(10)).unionAll(rows.limit(5).withColumn("doc_id", F.lit(None).cast("long"))), "rows")
    docs, before = rows, 75
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == rows.columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    found = corpus_pipeline.tokens(spark, docs, sf)
    assert found.count() == docs.count() and found.columns == ["doc_id", "start", "n_tokens", "ids"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_stages_on_no_rows(spark, sf, stage):
    none = common.table(spark, sf, "documents").limit(0)
    assert stage(spark, none, sf).count() == 0


def test_repeated_rows_are_mixed_one_by_one(spark, sf):
    rows = [(1, "a b c", "s", 5)] * 3 + [(2, "d e", "s", 3), (3, None, "s", 0), (4, " ", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.mixed(spark, docs, sf).collect()
    assert sum(len(r.text.split()) for r in got) == 11


def test_a_corpus_without_labels_is_kept(spark, sf):
    docs = common.table(spark, sf, "documents").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    assert corpus_pipeline.without_toxic(spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize(
    "again",
    [
        [(5, "x y z " * 14, "c")] * 3,  # the quota of c ends within the first copy
        [(None, "x y z " * 14, "c"), (None, "x y z " * 14, "a"), (None, "x y z " * 14, None)],
    ],
)
def test_copies_meet_their_own_turns(spark, sf, again):
    rows = [(1, "k " * 50, "a"), (2, "l " * 50, "b"), *again]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known, _ = mix.mix(docs)
    want = {r.source: math.floor(r.target) for r in known.select("source", "target").distinct().collect()}
    got = collections.Counter()
    for r in corpus_pipeline.mixed(spark, docs, sf).collect():
        got[r.source] += len(r.text.split())
    assert {s: got[s] for s in want} == want
