"""Benchmark decontamination over a distributed positional inverted index.

The index stores a posting (term, row, position) for every occurrence of a benchmark term in
the training documents, sorted by term, and one closing posting per document (term "") whose
position is the document's number of words. A phrase is looked up from its rarest term: that
term's postings, each shifted by the term's offset, give candidate places; they are intersected
with the shifted postings of the second-rarest term, and what is left with those of all others.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.llm import common

WINDOW = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of a document's closing posting; no word is empty.
END = ""


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, item_id, length, at, term: the words of every item with at least one word."""
    rows = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")
    )
    listed = rows.select("item", "item_id", F.size("w").alias("length"), F.posexplode("w").alias("at", "term"))
    return common.written(listed, "items")


def vocabulary(terms: DataFrame) -> DataFrame:
    """term, tid: a number for each distinct term, and one for the closing posting."""
    end = terms.sparkSession.createDataFrame([(END,)], "term string")
    return common.written(
        terms.select("term").unionAll(end).distinct().withColumn("tid", F.monotonically_increasing_id()), "terms"
    )


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """tid, row, pos, doc_id, text_key: the postings of ``terms`` (term, tid), in the shared folder.

    ``row`` numbers the rows of ``docs``; the closing posting alone carries the document's id and
    the hash of its text. Whole texts are read once; only postings of known terms are kept.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        common.text_key(text).alias("text_key"),
        F.concat(words(F.col(text)), F.array(F.lit(END))).alias("w"),
    )
    listed = rows.select("row", "doc_id", "text_key", F.posexplode("w").alias("pos", "term"))
    known = listed.join(common.narrow(terms), "term")
    closing = F.col("term") == END
    postings = known.select(
        "tid", "row", "pos", F.when(closing, F.col("doc_id")).alias("doc_id"), F.when(closing, F.col("text_key")).alias("text_key")
    )
    return common.written(postings.sortWithinPartitions("tid", "row", "pos"), "postings")


def closings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """row, doc_id, text_key, n_words: the documents of an index."""
    end = terms.where(F.col("term") == END).select("tid")
    return postings.join(F.broadcast(end), "tid").select("row", "doc_id", "text_key", F.col("pos").alias("n_words"))


def _rarest(placed: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """item, at1, tid1, at2, tid2: the two rarest words of each window of an item's words.

    Windows with a word that no document has can't occur and are left out.
    """
    starts = F.explode(
        F.sequence(
            F.greatest(F.lit(0), F.col("at") - (window - 1)),
            F.least(F.col("at"), F.greatest(F.lit(0), F.col("length") - window)),
        )
    )
    seen = placed.join(common.narrow(frequency), "tid", "left")
    rows = seen.select("item", "length", "at", "tid", "n", starts.alias("start"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "at", "tid")))
    per = rows.groupBy("item", "start").agg(F.count("n").alias("found"), F.count("*").alias("all"), ordered.alias("by"))
    first, second = F.element_at("by", 1), F.element_at("by", F.least(F.lit(2), F.size("by")))
    return (
        per.where(F.col("found") == F.col("all"))
        .select(
            "item",
            first["at"].alias("at1"),
            first["tid"].alias("tid1"),
            second["at"].alias("at2"),
            second["tid"].alias("tid2"),
        )
        .distinct()
    )


def occurrences(postings: DataFrame, terms: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, item_id, first, last: stretches of document words that are covered by
    occurrences of windows of one item, at one alignment.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window.
    """
    placed = common.written(items.join(common.narrow(terms), "term").select("item", "item_id", "length", "at", "tid"), "placed")
    frequency = common.written(postings.groupBy("tid").agg(F.count("*").alias("n")), "frequency")
    rare = common.written(_rarest(placed, frequency, window), "rare")

    # Postings of the rarest words, shifted to where the item would begin.
    first = postings.select("tid", "row", "pos").join(common.narrow(rare), F.col("tid") == F.col("tid1"))
    begun = first.select("row", "item", (F.col("pos") - F.col("at1")).alias("shift"), "at2", "tid2").distinct()
    wanted = begun.select("row", "item", "shift", F.col("tid2").alias("tid"), (F.col("shift") + F.col("at2")).alias("pos"))
    second = postings.select("tid", "row", "pos").join(
        common.narrow(rare.select(F.col("tid2").alias("tid")).distinct()), "tid", "left_semi"
    )
    both = common.written(wanted.join(second, ["tid", "row", "pos"]).select("row", "item", "shift").distinct(), "candidates")

    # All words of the item at that alignment.
    rows = common.written(both.select("row").distinct(), "rows")
    near = postings.select("tid", "row", "pos").join(common.narrow(rows), "row", "left_semi")
    expected = both.join(common.narrow(placed), "item").select(
        "row", "item", "item_id", "length", "shift", "at", "tid", (F.col("shift") + F.col("at")).alias("pos")
    )
    met = expected.join(near, ["tid", "row", "pos"])
    turn = Window.partitionBy("row", "item", "shift").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(turn))
    return (
        runs.groupBy("row", "item", "shift", "run")
        .agg(
            F.first("item_id").alias("item_id"),
            F.first("length").alias("length"),
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
        )
        .where(F.col("last") - F.col("first") + 1 >= F.least(F.col("length"), F.lit(window)))
        .select("row", "item", "item_id", "first", "last")
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, item_ids (sorted strings): one row per row of ``docs``.

    A null, empty or wordless text has no words and no hits; an item without words is no window;
    items that share an id count once, a null id counts as an empty string. Rows that repeat one
    another are separate documents. Empty tables give no rows, or rows without hits.
    """
    listed = item_words(items, item_id, item_text)
    terms = vocabulary(listed)
    postings = index(docs, terms, doc_id, text)
    found = common.written(occurrences(postings, terms, listed, window), "occurrences")
    covered = found.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    hits = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name")).distinct()
    names = named.groupBy("row").agg(F.array_sort(F.collect_list("name")).alias("item_ids"))
    marked = hits.join(names, "row")
    return closings(postings, terms).join(marked, "row", "left").select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def proximity(postings: DataFrame, terms: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """query, row, pos: occurrences of a query's rarest term that have every other term of the
    query (query, term) at most ``within`` words away. Repeated terms count once; a query with a
    term that no document has matches nothing."""
    asked = queries.select("query", "term").distinct().join(common.narrow(terms), "term", "left")
    frequency = postings.groupBy("tid").agg(F.count("*").alias("n"))
    counted = asked.join(frequency, "tid", "left")
    per = counted.groupBy("query").agg(
        F.count("n").alias("found"), F.count("*").alias("all"), F.min(F.struct("n", "tid")).alias("least"),
        F.collect_list("tid").alias("tids"),
    )
    per = common.written(per.where("found = all").select("query", "all", F.col("least.tid").alias("tid"), "tids"), "queries")
    begun = postings.join(common.narrow(per), "tid").select("query", "row", "pos", "all", "tids", "tid")
    others = begun.where("all > 1").select(
        "query", "row", "pos", "all", F.explode(F.array_except("tids", F.array("tid"))).alias("tid")
    )
    spread = others.withColumn("at", F.explode(F.sequence(F.col("pos") - within, F.col("pos") + within)))
    wanted = common.written(per.select(F.explode("tids").alias("tid")).distinct(), "wanted")
    near = postings.select("tid", "row", F.col("pos").alias("at")).join(common.narrow(wanted), "tid", "left_semi")
    met = spread.join(near, ["tid", "row", "at"]).select("query", "row", "pos", "all", "tid").distinct()
    full = met.groupBy("query", "row", "pos", "all").agg(F.count("*").alias("n")).where(F.col("n") == F.col("all") - 1)
    return begun.where("all = 1").select("query", "row", "pos").unionAll(full.select("query", "row", "pos"))
