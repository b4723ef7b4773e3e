"""Queries over the given tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrecon.llm import (
    align, common, conversations, decontaminate, exact_dedup, interpolate, language, mix, quality, simhash, token_store, topk, toxicity, viterbi,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(common.ready(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the package that has it is found where the query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, placements = mix.mix(common.table(spark, sf_dir, "documents"))
    return mix.taken_words(rows, placements)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "tokens")
    docs = common.table(spark, sf_dir, "documents")
    token_store.write(docs, path, public_tokenizer("byte_bpe_50k.json"), end_id=2)
    store = token_store.read(spark, path)
    stored = token_store.starts(token_store.digests(store), store)
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op5_decontaminate"] = """
WITH patterns AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS p,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), p) AS w FROM documents, patterns),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), p) AS w FROM benchmark, patterns),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, w[s : s + m - 1] AS x
    FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM sized)),
places AS (SELECT doc_id, m, s, w[s : s + m - 1] AS x
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
          FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)),
met AS (SELECT p.doc_id, p.s, p.m, v.item_id FROM places p JOIN windows v ON p.m = v.m AND p.x = v.x),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + m)) AS spot FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.written(topk.integer_vectors(common.table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


ORACLE["op8_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_mod("doc_id", 4) == 2
    models = language.fit(docs, ~held_out)
    found = language.identify(docs, models, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.crc_mod("doc_id", 5) == 0
    model = quality.fit(docs, labels, ~held_out)
    found = quality.score(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.crc_mod("doc_id", 4) == 2
    net = toxicity.fit(docs, labels, ~held_out)
    found = toxicity.score(docs, net, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return interpolate.score(docs, common.crc_mod("doc_id", 5) != 1)


@query
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = align.Alignment(docs, public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
    rows = align.digests(found.documents).join(found.scores(), ["chunk", "nth"], "left")
    # Tokens are never empty, so one of each kind ends at a shared offset: a group has one link.
    return rows.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256",
    )


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(common.table(spark, sf_dir, "documents"))


ORACLE["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return conversations.repaired(rows, conversations.damage(rows))
