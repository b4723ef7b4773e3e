"""Outcome events, their windowed rates, last values and sustained alerts.

Windows are built in two steps: events are first reduced to one row per step and label
set, and only those rows are copied into the sliding windows they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.operators.validate import review_category

# Alert thresholds.
REVIEW_RATE_LIMIT = 5
DELTA_LIMIT = "0.01"
NO_PROGRESS_SECONDS = 3 * 3600


def events(dispositions: DataFrame, log_pii: bool = False, split_incoming: bool = False) -> DataFrame:
    """Message outcomes fit for a log: labels and a bounded category.

    The free-form reason may name people, amounts and accounts, so it leaves the job only
    with ``log_pii`` set.
    """
    category = F.when(F.col("disposition") == "review", review_category(F.col("reason"), split_incoming))
    safe = ["msg_id", "source", "disposition", category.alias("review_reason_category")]
    return dispositions.select(*(c for c in ("ts",) if c in dispositions.columns), *safe, *(["reason"] if log_pii else []))


def run_summary(dispositions: DataFrame, statements: DataFrame) -> DataFrame:
    """One-row summary of a run over messages and statement reports.

    A statement's review count adds its amount mismatches and unmatched journals;
    ``balance_mismatch`` blocks a clean statement but is not part of ``review``, so it is
    shown on its own.
    """
    states = ("booked", "duplicate", "review", "skipped", "deferred")
    m = dispositions.agg(
        F.count("*").alias("messages"),
        *[F.count_if(F.col("disposition") == s).alias(f"m_{s}") for s in states],
    )

    def total(expr: Column) -> Column:
        return F.coalesce(F.sum(expr), F.lit(0))

    c = F.col
    s = statements.agg(
        F.count("*").alias("statements"),
        total(c("booked_new") + c("payments_booked")).alias("s_booked"),
        total(c("reconciled")).alias("s_duplicates"),
        total(c("review") + c("amount_mismatch") + c("unmatched_booked")).alias("s_review"),
        total(c("corrected")).alias("corrected"),
        total((c("deferred") > 0).cast("bigint")).alias("s_deferred"),
        total(c("balance_mismatch")).alias("balance_mismatch"),
    )
    both = m.select(F.lit(1).alias("_one"), "*").join(s.select(F.lit(1).alias("_one"), "*"), "_one")
    return both.select(
        (c("messages") + c("statements")).alias("processed"),
        (c("m_booked") + c("s_booked")).alias("booked"),
        (c("m_duplicate") + c("s_duplicates")).alias("duplicates"),
        (c("m_review") + c("s_review")).alias("review"),
        c("m_skipped").alias("skipped"),
        "statements",
        "corrected",
        (c("m_deferred") + c("s_deferred")).alias("deferred"),
        "balance_mismatch",
    )


def rates(outcomes: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Counts per tumbling step, source and disposition."""
    return (
        outcomes.groupBy(F.window("ts", step).alias("w"), "source", "disposition")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "source", "disposition", "n")
    )


def sliding_sum(counts: DataFrame, labels: list[str], window: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """Look-back sums over rows that are already one per step (``window_start``, ``n``)."""
    return (
        counts.groupBy(F.window("window_start", window, step).alias("w"), *labels)
        .agg(F.sum("n").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n")
    )


def last_value(
    samples: DataFrame, value: str, labels: list[str], window: str = "3 hours", step: str = "5 minutes", tie: str | None = None
) -> DataFrame:
    """Newest value of each look-back window; ``tie`` orders samples of equal time."""
    order = F.struct("ts", tie) if tie else F.col("ts")
    newest = (
        samples.where(F.col(value).isNotNull())
        .groupBy(F.window("ts", step).alias("_s"), *labels)
        .agg(F.max(F.struct(order.alias("at"), F.col(value).alias("value"))).alias("_v"))
        .select(F.col("_s.start").alias("_start"), *labels, "_v")
    )
    return (
        newest.groupBy(F.window("_start", window, step).alias("w"), *labels)
        .agg(F.max("_v").alias("_v"))
        .select(F.col("w.end").alias("window_end"), *labels, F.col("_v.value").alias(value))
    )


def held_value(
    samples: DataFrame, value: str, labels: list[str], window: str = "14 days", step: str = "5 minutes", tie: str | None = None
) -> DataFrame:
    """The rows of ``last_value`` for long windows: the newest value of a step is shown from the
    step's end until the next step with a value has ended or the window has passed it, so it is
    stored once and becomes only the rows it is the answer of, not one row per window that holds it.

    Rows are ordered within a label after they are one per step, so a label holds as many rows
    as there are steps in time, however many samples it has. Null values are no samples.
    """
    order = F.struct("ts", tie) if tie else F.col("ts")
    newest = (
        samples.where(F.col(value).isNotNull())
        .groupBy(F.window("ts", step).alias("_s"), *labels)
        .agg(F.max(F.struct(order.alias("at"), F.col(value).alias("value"))).alias("_v"))
        .select(F.col("_s.start").alias("_start"), *labels, F.col("_v.value").alias(value))
    )
    each, length = F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {window}")
    following = F.lead("_start").over(Window.partitionBy(*labels).orderBy("_start"))
    # least() leaves out the null of the last step.
    shown = newest.withColumn("_until", F.least(F.col("_start") + length, following))
    ends = F.explode(F.sequence(F.col("_start") + each, F.col("_until"), each)).alias("window_end")
    return shown.select(ends, *labels, value)


def review_rate(rate_rows: DataFrame) -> DataFrame:
    """Reviews per step over all sources; every observed step has a row."""
    return rate_rows.groupBy("window_start").agg(
        F.sum(F.when(F.col("disposition") == "review", F.col("n")).otherwise(0)).alias("n")
    )


def sustained(series: DataFrame, firing: Column, hold: str, step: str, labels: list[str] | None = None) -> DataFrame:
    """Stretches in which ``firing`` held in every step for at least ``hold``.

    ``series`` has one row per step (``window_start``) and label set; a missing step
    breaks a stretch. Returns started, ended (end of the last step), steps and fires_at.
    """
    labels = labels or []
    step_s, hold_s = _seconds(step), _seconds(hold)
    order = Window.partitionBy(*labels, F.date_trunc("year", "window_start")).orderBy("window_start")
    at = F.unix_timestamp("window_start")
    hot = series.where(F.coalesce(firing, F.lit(False)))
    # Stretches are found within a year, then joined where one runs over the turn of the year.
    broken = (at - F.lag(at).over(order) != step_s) | F.lag(at).over(order).isNull()
    runs = hot.withColumn("_run", F.sum(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = runs.groupBy(*labels, F.year("window_start").alias("_year"), "_run").agg(
        F.min("window_start").alias("started"), F.max("window_start").alias("_last"), F.count("*").alias("steps")
    )
    over = Window.partitionBy(*labels).orderBy("started")
    starts = F.unix_timestamp("started") - F.unix_timestamp(F.lag("_last").over(over)) != step_s
    joined = part.withColumn("_open", F.coalesce(starts, F.lit(True)).cast("int"))
    joined = joined.withColumn("_stretch", F.sum("_open").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(*labels, "_stretch").agg(
        F.min("started").alias("started"), F.max("_last").alias("_last"), F.sum("steps").alias("steps")
    )
    ended = F.timestamp_seconds(F.unix_timestamp("_last") + step_s)
    fires = F.timestamp_seconds(F.unix_timestamp("started") + hold_s)
    out = whole.select(*labels, "started", ended.alias("ended"), "steps", fires.alias("fires_at"))
    return out.where(F.unix_timestamp("ended") >= F.unix_timestamp("fires_at"))


def _seconds(text: str) -> int:
    size, unit = text.split()
    return int(size) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def balance_alerts(statement_events: DataFrame) -> DataFrame:
    """Statements that were checked and do not reconcile; an unchecked one never fires."""
    off = F.abs("balance_delta") > F.lit(DELTA_LIMIT).cast("decimal(4,2)")
    return statement_events.where(F.col("balance_checked") & off)


def no_progress(last_deferred: DataFrame, last_success: Column) -> DataFrame:
    """Windows whose last run still deferred and whose last success is over three hours old."""
    age = F.unix_timestamp("window_end") - F.unix_timestamp(last_success)
    return last_deferred.where((F.col("deferred") > 0) & (age > NO_PROGRESS_SECONDS))
