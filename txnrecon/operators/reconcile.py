"""Match statement charges to booked journals.

Charges and the journals near them meet in a bucket of days and are compared there. Where a key
is crowded, rows are reduced to cells before anything is compared: all charges of a scope, currency,
day and name ask the same question, and all journals of such a cell give the same score.
What a charge needs from its candidates is the best free journal, the runner-up's score
and whether anything else is plausible, and those are aggregates over cells. So a busy
account costs distinct names, not charges times journals.

Claims are resolved in one pass over the whole set, never charge by charge: a charge can
not become "new" because another one took its match first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.functions.dates import within_days
from txnrecon.functions.keys import STATEMENT_PREFIX, prefixed
from txnrecon.operators.ordered import ordinal
from txnrecon.operators.params import ReconcileParams
from txnrecon.operators.similarity import best_near, bucket_of, buckets_near, canonical, similar_names, wide_tokens
from txnrecon.stage import materialize

SCOPE = ("account_id",)
# Charges, or journals near them, of a scope, currency and bucket that are compared in one go.
FEW = 2048


def exact_matches(charges: DataFrame, journals: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Charges whose reference a journal already carries; currency and date do not matter.

    The n-th charge of a reference takes the n-th journal of it, so the match is one to
    one even where a reference repeats. Returns scope, charge_id, journal_id, journal_amount.
    """
    keys = [*scope, "_ref"]
    wants = charges.select(*scope, "charge_id", prefixed(STATEMENT_PREFIX, F.col("reference")).alias("_ref"))
    holds = journals.where(F.col("external_id").startswith(STATEMENT_PREFIX)).select(
        *scope, "journal_id", F.col("amount").alias("journal_amount"), F.col("external_id").alias("_ref")
    )
    # Few journals carry one, and few charges have such a journal; numbering reads both twice.
    holds = materialize(holds)
    wants = ordinal(materialize(wants.join(holds.select(*keys), keys, "left_semi")), keys, "charge_id", "_nth")
    holds = ordinal(holds, keys, "journal_id", "_nth")
    return wants.join(holds, [*keys, "_nth"]).drop("_ref", "_nth")


def candidate_cells(
    charges: DataFrame, journals: DataFrame, params: ReconcileParams, scope: tuple[str, ...] = SCOPE
) -> DataFrame:
    """Similar journal cells of each charge cell.

    ``charges`` need ``canon``; ``journals`` need ``canon`` and ``is_free``. Returns the
    charge cell (scope, currency, auth_date, canon), the score, and of the journal cell the
    number of journals, the number still free and the first free id.
    """
    days = params.date_window_days
    c_cells = (
        charges.select(*scope, "currency", "auth_date", "canon")
        .distinct()
        .withColumn("_bucket", F.explode(buckets_near(F.col("auth_date"), days)))
    )
    # Both sides feed the measuring, the blocks and the join back.
    c_cells = materialize(c_cells)
    j_cells = (
        journals.groupBy(*scope, "currency", "txn_date", "canon")
        .agg(
            F.count("*").alias("n_all"),
            F.count_if("is_free").alias("n_free"),
            F.min(F.when(F.col("is_free"), F.col("journal_id"))).alias("first_free"),
        )
        .withColumn("_bucket", bucket_of(F.col("txn_date"), days))
    )
    j_cells = materialize(j_cells)
    keys = [*scope, "currency", "_bucket"]
    pairs = similar_names(
        c_cells.select(*keys, F.col("canon").alias("name")),
        j_cells.select(*keys, F.col("canon").alias("name")),
        keys,
        params.merchant_gray,
    )
    return (
        c_cells.withColumnRenamed("canon", "name_a")
        .join(pairs, [*keys, "name_a"])
        .join(j_cells.withColumnRenamed("canon", "name_b"), [*keys, "name_b"])
        .where(within_days("auth_date", "txn_date", days))
        .select(
            *scope, "currency", "auth_date", F.col("name_a").alias("canon"),
            "txn_date", F.col("name_b").alias("journal_canon"), "score", "n_all", "n_free", "first_free",
        )
    )


def _rank_candidates(cells: DataFrame, cell: list[str]) -> DataFrame:
    """Best free journal, runner-up score and plausible count of each charge cell.

    The window spans the similar journal cells of one charge cell. A best cell with two
    free journals is its own runner-up.
    """
    order = Window.partitionBy(*cell).orderBy(
        (F.col("n_free") > 0).desc(), F.col("score").desc(), F.col("first_free")
    )
    whole = Window.partitionBy(*cell)
    ranked = cells.select(
        *cell,
        "score",
        "n_free",
        "first_free",
        F.row_number().over(order).alias("_rank"),
        F.lead("score").over(order).alias("_next_score"),
        F.lead("n_free").over(order).alias("_next_free"),
        F.sum("n_all").over(whole).alias("n_plausible"),
    ).where(F.col("_rank") == 1)
    free = F.col("n_free") > 0
    second = F.when(F.col("n_free") > 1, F.col("score")).when(F.col("_next_free") > 0, F.col("_next_score"))
    return ranked.select(
        *cell,
        "n_plausible",
        F.when(free, F.col("score")).alias("best_score"),
        F.when(free, F.col("first_free")).alias("best_journal"),
        F.when(free, second).alias("second_score"),
    )


def _crowded(charges: DataFrame, journals: DataFrame, keys: list[str], days: int) -> DataFrame | None:
    """Keys (scope, currency, bucket of the charge) with more than ``FEW`` charges or journals near
    them, or with a journal that has no id; None if there are none. Buckets are counted only
    where the scope as a whole has so many."""
    whole = keys[:-1]
    charged = charges.select(*whole, F.array(bucket_of(F.col("auth_date"), days)).alias("_near"), F.lit(False).alias("_bare"))
    booked = journals.select(*whole, buckets_near(F.col("txn_date"), days).alias("_near"), F.col("journal_id").isNull().alias("_bare"))
    many = (F.col("count") > FEW) | F.col("_any")
    count = [F.count("*").alias("count"), F.bool_or("_bare").alias("_any")]
    busy = [side.groupBy(*whole).agg(*count).where(many).select(*whole) for side in (charged, booked)]
    busy = materialize(busy[0].unionByName(busy[1]).distinct())
    if busy.isEmpty():
        return None
    found = [
        side.join(busy, whole, "left_semi").withColumn(keys[-1], F.explode("_near")).groupBy(*keys).agg(*count).where(many).select(*keys)
        for side in (charged, booked)
    ]
    crowded = materialize(found[0].unionByName(found[1]).dropna().distinct())
    return None if crowded.isEmpty() else crowded


def _asking(
    charges: DataFrame, journals: DataFrame, crowded: DataFrame | None, params: ReconcileParams, scope: tuple[str, ...]
) -> DataFrame:
    """Charges with the best free journal, its score, the runner-up's and the plausible count.

    A charge lies in one bucket and the journals near it are dealt to that bucket too, so
    both move once and are compared where they arrive. Keys too crowded for that are left to
    blocks of names. ``charges`` with a journal already ask for none.
    """
    days = params.date_window_days
    keys = [*scope, "currency", "_bucket"]
    cell = [*scope, "currency", "auth_date", "canon"]
    # What is missing matches nothing.
    asks = F.col("journal_id").isNull()
    for x in cell:
        asks = asks & F.col(x).isNotNull()
    j = journals.dropna(subset=[*scope, "currency", "txn_date", "canon"])
    c = charges.withColumn("_bucket", bucket_of(F.col("auth_date"), days))
    near = j.select(
        *scope, "currency", "txn_date", "canon", "is_free", "journal_id",
        F.explode(buckets_near(F.col("txn_date"), days)).alias("_bucket"),
    )
    few_c, few_j = (x if crowded is None else x.join(crowded, keys, "left_anti") for x in (c, near))
    name, toks = F.col("canon").alias("name"), wide_tokens(F.col("canon")).alias("toks")
    kept = [x for x in charges.columns if x not in cell]
    rows = few_c.select(
        *scope, "currency", F.when(asks, F.col("_bucket")).otherwise(F.xxhash64("charge_id")).alias("_bucket"),
        F.when(asks, 0).otherwise(-1).alias("_side"), F.unix_date("auth_date").alias("day"), name, toks, *kept,
    ).unionByName(
        few_j.select(
            *scope, "currency", "_bucket", F.lit(1).alias("_side"), F.unix_date("txn_date").alias("day"), name, toks,
            F.col("journal_id").alias("_id"), F.col("is_free").alias("_free"),
        ),
        allowMissingColumns=True,
    )
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_side", "_id")
    added = {"n_plausible": "long", "best_score": "double", "best_journal": rows.schema["_id"].dataType, "second_score": "double"}
    schema = rows.select(*keys, "day", "name", *kept).schema
    for x, kind in added.items():
        schema = schema.add(x, kind)
    asked = dealt.mapInArrow(best_near(params.merchant_gray, days, keys, kept), schema)
    asked = asked.withColumns({"auth_date": F.date_from_unix_date("day"), "canon": F.col("name")}).select(*charges.columns, *added)
    if crowded is None:
        return asked
    around = crowded.withColumn("_bucket", F.explode(F.sequence(F.col("_bucket") - 1, F.col("_bucket") + 1))).distinct()
    many_c = c.join(crowded, keys, "left_semi").drop("_bucket")
    many_j = j.withColumn("_bucket", bucket_of(F.col("txn_date"), days)).join(around, keys, "left_semi")
    ranked = _rank_candidates(candidate_cells(many_c.where(F.col("journal_id").isNull()), many_j, params, scope), cell)
    return asked.unionByName(many_c.join(ranked, cell, "left"))


def intents(
    charges: DataFrame,
    journals: DataFrame,
    aliases: DataFrame | None = None,
    params: ReconcileParams | None = None,
    scope: tuple[str, ...] = SCOPE,
) -> DataFrame:
    """What each charge asks for before conflicts: exact, claim, review or book.

    Adds best_journal, best_score, second_score, n_plausible, intent and, for an exact
    match, journal_id and journal_amount.
    """
    p = params or ReconcileParams()
    on = list(scope)
    # Few rows, read for the charges twice and for the journals once.
    exact = materialize(exact_matches(charges, journals, scope))
    taken = exact.select(*on, "journal_id", F.lit(False).alias("_free"))
    j = canonical(journals, "merchant", aliases, "canon").join(taken, [*on, "journal_id"], "left")
    j = j.withColumn("is_free", F.coalesce("_free", F.lit(True))).drop("_free")
    c = canonical(charges, "merchant", aliases, "canon").join(exact, [*on, "charge_id"], "left")
    crowded = _crowded(charges, journals, [*on, "currency", "_bucket"], p.date_window_days)
    # Read more than once only where some keys are crowded.
    c, j = (c, j) if crowded is None else (materialize(c), materialize(j))
    close = (F.col("second_score") >= p.merchant_threshold) & (
        F.col("best_score") - F.col("second_score") < p.score_epsilon
    )
    intent = (
        F.when(F.col("journal_id").isNotNull(), "exact")
        .when(F.col("best_score").isNull(), "book")
        .when(F.col("best_score") < p.merchant_threshold, "review_gray")
        .when(close, "review_ambiguous")
        .otherwise("claim")
    )
    asked = _asking(c, j, crowded, p, scope).withColumn("intent", intent)
    found = ["n_plausible", "best_score", "best_journal", "second_score"]
    return asked.select(
        *[F.when(F.col("intent") != "exact", F.col(x)).alias(x) if x in found else F.col(x) for x in asked.columns]
    )


def resolve(asked: DataFrame, journals: DataFrame, params: ReconcileParams | None = None, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Final outcome per charge: confirmed, mismatch, book_new or review, with journal and reason.

    Of several claimants of a journal the one nearest in amount wins if it is clearly
    nearest and close enough; the others are new unless something else is plausible.
    """
    p = params or ReconcileParams()
    on = list(scope)
    amounts = journals.select(*on, F.col("journal_id").alias("best_journal"), F.col("amount").alias("_jamt"))
    claims = asked.where(F.col("intent") == "claim").join(amounts, [*on, "best_journal"])
    claims = claims.withColumn("_dist", F.abs(F.col("amount") - F.col("_jamt")))
    nearest = Window.partitionBy(*on, "best_journal").orderBy("_dist", "charge_id")
    # Only two rows per journal are kept, and the limit is applied before the shuffle too.
    top = (
        claims.select(*on, "best_journal", "charge_id", "_dist")
        .withColumn("_rank", F.row_number().over(nearest))
        .where(F.col("_rank") <= 2)
        .groupBy(*on, "best_journal")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("charge_id"))).alias("_near"),
            F.max(F.when(F.col("_rank") == 1, F.col("_dist"))).alias("_near_dist"),
            F.max(F.when(F.col("_rank") == 2, F.col("_dist"))).alias("_second_dist"),
        )
    )
    claimed = claims.join(top, [*on, "best_journal"])
    clear = (F.col("_near_dist") * 2 < F.col("_second_dist")) & (F.col("_jamt") > 0) & (
        F.col("_near_dist") * 100 <= F.col("_jamt") * 15
    )
    is_near = F.col("charge_id") == F.col("_near")
    fate = (
        F.when(F.col("_second_dist").isNull() | (clear & is_near), "winner")
        .when(~clear, "review_contended")
        .when(F.col("n_plausible") > 1, "review_cluster")
        .otherwise("book")
    )
    decided = asked.where(F.col("intent") != "claim").select(
        *asked.columns, F.col("intent").alias("fate"), F.col("journal_amount").alias("_booked")
    ).unionByName(
        claimed.withColumn("fate", fate)
        .withColumn("journal_id", F.when(F.col("fate") == "winner", F.col("best_journal")))
        .select(*asked.columns, "fate", F.col("_jamt").alias("_booked"))
    )
    matched = F.col("fate").isin("exact", "winner")
    same = F.abs(F.col("amount") - F.col("_booked")) <= F.lit(p.amount_tolerance)
    outcome = (
        F.when(matched & same, "confirmed")
        .when(matched, "mismatch")
        .when(F.col("fate") == "book", "book_new")
        .otherwise("review")
    )
    return decided.select(
        *on,
        "charge_id",
        "reference",
        "currency",
        "amount",
        outcome.alias("outcome"),
        F.when(matched, F.col("journal_id")).alias("journal_id"),
        F.when(matched, F.col("_booked")).alias("booked"),
        _reason(F.col("fate")).alias("reason"),
    )


def _reason(fate: Column) -> Column:
    """Bounded reason of a review; ids and scores stay in their own columns."""
    return (
        F.when(fate == "review_gray", "possible duplicate in the gray zone")
        .when(fate == "review_ambiguous", "several journals match equally well")
        .when(fate == "review_contended", "several charges contend for one journal")
        .when(fate == "review_cluster", "cluster loser with another plausible journal")
    )


def outcomes(
    charges: DataFrame,
    journals: DataFrame,
    aliases: DataFrame | None = None,
    params: ReconcileParams | None = None,
    scope: tuple[str, ...] = SCOPE,
) -> DataFrame:
    return resolve(intents(charges, journals, aliases, params, scope), journals, params, scope)


def unmatched(journals: DataFrame, decided: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Journals no charge was matched to."""
    used = decided.where(F.col("journal_id").isNotNull()).select(*scope, "journal_id")
    return journals.join(used, [*scope, "journal_id"], "left_anti")
