"""Scoring, monitoring and streams."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txnrecon.operators import monitor, score
from txnrecon.streaming import alerts, ingest

T0 = datetime.datetime(2026, 1, 1)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def test_field_scores_and_matrix(spark):
    labels = spark.createDataFrame(
        [("a", "transaction", "EUR 1,000.50", "eur", "out", "2026-01-01", "Shop  One", "approved", None),
         ("b", "not_a_transaction", None, None, None, None, None, None, None)],
        "example string, kind string, amount string, currency string, direction string, date string, merchant string, "
        "status string, routed_account string",
    )
    records = spark.createDataFrame(
        [("m1", "a", 1, "banco_popular", Decimal("7"), "EUR", "out", datetime.date(2026, 1, 1), "x", None, "paid"),
         ("m1", "a", 0, "banco_popular", Decimal("1000.5"), "EUR", "in", datetime.date(2026, 1, 1), "SHOP ONE", None, "pending"),
         ("m2", "b", 0, "paypal", Decimal("1"), "USD", "out", datetime.date(2026, 1, 1), "x", None, "paid")],
        "model string, example string, rec_idx int, source string, amount decimal(18,4), currency string, direction string, "
        "txn_date date, merchant string, account_hint string, status string",
    )
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    scores = score.fields(score.project(score.project_labels(labels), models, score.project_records(records)))
    got = {(r.model, r.example, r.field): r.score for r in scores.collect()}
    m1a = {f: got[("m1", "a", f)] for f in score.FIELDS}
    assert m1a == dict(kind="correct", amount="correct", currency="correct", direction="wrong", date="correct",
                       merchant="correct", status="wrong", account="na")
    assert got[("m1", "b", "kind")] == "correct" and got[("m1", "b", "amount")] == "na"
    assert got[("m2", "b", "kind")] == "wrong" and got[("m2", "a", "kind")] == "wrong" and got[("m2", "a", "amount")] == "wrong"
    matrix = {r.model: r for r in score.matrix(score.tally(scores)).collect()}
    assert matrix["m1"].kind == 1.0 and matrix["m1"].account is None
    assert matrix["m1"].OVERALL == pytest.approx(6 / 8) and matrix["m2"].OVERALL == 0.0


def outcomes(spark, rows):
    frame = spark.createDataFrame(rows, "ts timestamp, source string, disposition string")
    return frame.withColumn("msg_id", F.lit("m"))


def test_rates_and_look_back(spark):
    frame = outcomes(spark, [(minutes(1), "a", "review"), (minutes(4), "a", "review"), (minutes(6), "a", "booked"), (minutes(58), "b", "review")])
    rates = monitor.rates(frame)
    assert {(r.window_start, r.disposition): r.n for r in rates.collect()} == {
        (minutes(0), "review"): 2, (minutes(5), "booked"): 1, (minutes(55), "review"): 1,
    }
    sums = {r.window_end: r.n for r in monitor.sliding_sum(rates.where("disposition = 'review'"), []).collect()}
    assert sums[minutes(60)] == 3 and sums[minutes(65)] == 1 and sums[minutes(5)] == 2


def test_last_value(spark):
    frame = spark.createDataFrame(
        [(minutes(1), "a", 1.0, 1), (minutes(1), "a", 2.0, 2), (minutes(61), "a", None, 3)], "ts timestamp, source string, v double, i int"
    )
    got = {r.window_end: r.v for r in monitor.last_value(frame, "v", ["source"], "1 hour", tie="i").collect()}
    assert got[minutes(5)] == 2.0 and got[minutes(60)] == 2.0 and minutes(65) not in got


def test_sustained_stretches(spark):
    hot = [0, 5, 10, 15, 30, 35, 60 * 24 * 365 - 5, 60 * 24 * 365]
    frame = spark.createDataFrame([(minutes(m), 9) for m in hot] + [(minutes(20), 1)], "window_start timestamp, n int")
    got = monitor.sustained(frame, F.col("n") > 5, "10 minutes", "5 minutes").orderBy("started").collect()
    assert [(r.started, r.ended, r.steps) for r in got] == [
        (minutes(0), minutes(20), 4), (minutes(30), minutes(40), 2),
        (minutes(60 * 24 * 365 - 5), minutes(60 * 24 * 365 + 5), 2),
    ]
    assert got[0].fires_at == minutes(10)


def test_balance_alerts_ignore_unchecked(spark):
    frame = spark.createDataFrame(
        [(1, True, Decimal("0.02")), (2, True, Decimal("-0.02")), (3, True, Decimal("0.01")), (4, False, None)],
        "i int, balance_checked boolean, balance_delta decimal(24,4)",
    )
    assert sorted(r.i for r in monitor.balance_alerts(frame).collect()) == [1, 2]


def test_no_progress(spark):
    frame = spark.createDataFrame([(minutes(0), 1), (minutes(300), 1), (minutes(300), 0)], "window_end timestamp, deferred int")
    assert monitor.no_progress(frame, F.lit(minutes(0))).count() == 1


def test_events_leave_the_reason_out(spark):
    frame = spark.createDataFrame([("m", "s", "review", "unknown currency: X")], "msg_id string, source string, disposition string, reason string")
    assert monitor.events(frame).columns == ["msg_id", "source", "disposition", "review_reason_category"]
    assert "reason" in monitor.events(frame, log_pii=True).columns
    assert monitor.events(frame).collect()[0].review_reason_category == "currency_mismatch"


# --- streams ---------------------------------------------------------------------------

MAIL = "msg_id STRING, msg_seq BIGINT, external_id STRING, waits BOOLEAN"


def drop_files(spark, folder, *batches):
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"in-{len(os.listdir(folder))}-{i}")
        spark.createDataFrame(rows, MAIL).coalesce(1).write.parquet(path + ".d")
        (part,) = [f for f in os.listdir(path + ".d") if f.endswith(".parquet")]
        os.rename(os.path.join(path + ".d", part), path + ".parquet")


def reader(spark, folder):
    return spark.readStream.schema(MAIL).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def test_stream_books_once_and_retries_what_waits(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    rate_known = {"yes": False}

    def decide(messages):
        waits = F.col("waits") & F.lit(not rate_known["yes"])
        return messages.select(
            "msg_id", "msg_seq", F.lit(0).alias("rec_idx"), "external_id",
            F.when(waits, "deferred").otherwise("open").alias("outcome"), F.lit(None).cast("string").alias("reason"),
        )

    def finish():
        ingest.run(reader(spark, folder), root, decide, MAIL).awaitTermination(120)

    drop_files(spark, folder, [("1", 1, "k1", False), ("2", 2, "k1", False), ("3", 3, "k3", True)])
    finish()
    drop_files(spark, folder, [("4", 4, "k1", False), ("5", 5, "k5", False)], [("6", 6, "k5", False)])
    finish()
    booked = spark.read.parquet(f"{root}/ledger")
    assert sorted(r.msg_id for r in booked.collect()) == ["1", "5"]
    rate_known["yes"] = True
    ingest.retry_deferred(spark, root, decide, MAIL)
    ingest.retry_deferred(spark, root, decide, MAIL)
    booked = spark.read.parquet(f"{root}/ledger")
    assert sorted((r.msg_id, r.external_id) for r in booked.collect()) == [("1", "k1"), ("3", "k3"), ("5", "k5")]
    last = {}
    for r in spark.read.parquet(f"{root}/outcomes").orderBy("epoch").collect():
        last[r.msg_id] = r.outcome
    assert last == {"1": "booked", "2": "duplicate", "3": "booked", "4": "duplicate", "5": "booked", "6": "duplicate"}
    # The same stream result as one batch over everything.
    whole = spark.read.parquet(*[os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")])
    batch = ingest.book_once(whole.withColumn("rec_idx", F.lit(0)), spark.createDataFrame([], "external_id string"))
    assert {r.msg_id: r.outcome for r in batch.collect()} == last


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    batch = spark.createDataFrame([("1", 1, "k1", False)], MAIL)

    def decide(messages):
        return messages.select("msg_id", "msg_seq", F.lit(0).alias("rec_idx"), "external_id", F.lit("open").alias("outcome"),
                               F.lit(None).cast("string").alias("reason"))

    for _ in range(2):
        ingest.settle_epoch(batch, 0, root, decide, MAIL)
    assert spark.read.parquet(f"{root}/ledger").count() == 1
    assert [r.outcome for r in spark.read.parquet(f"{root}/outcomes").collect()] == ["booked"]


def stream_of(spark, tmp_path, frame):
    folder = str(tmp_path / "events")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).parquet(folder)


def drain(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_streaming_rates_equal_the_batch(spark, tmp_path):
    frame = outcomes(spark, [(minutes(m), "a", "review") for m in range(0, 60, 7)] + [(minutes(500), "a", "booked")])
    live = drain(alerts.outcome_rates(stream_of(spark, tmp_path, frame)), "rates_live")
    batch = monitor.rates(frame).where(F.col("window_start") < F.lit(minutes(400)))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_streaming_look_back_equals_the_batch(spark, tmp_path):
    frame = outcomes(spark, [(minutes(m), "a", "review") for m in range(0, 60, 7)] + [(minutes(500), "a", "review")])
    live = drain(alerts.look_back(stream_of(spark, tmp_path, frame)), "look_back_live")
    batch = monitor.sliding_sum(monitor.rates(frame).where("disposition = 'review'"), [])
    want = {tuple(r) for r in batch.where(F.col("window_end") < F.lit(minutes(400))).collect()}
    got = {tuple(r) for r in live.collect()}
    assert want and want <= got


def test_sustained_alert_fires_once(spark, tmp_path):
    rows = [("p", minutes(m), True) for m in range(0, 50, 5)] + [("q", minutes(0), True), ("q", minutes(20), False)]
    rows += [("p", minutes(55), False), ("p", minutes(60), True), ("tick", minutes(400), False)]
    frame = spark.createDataFrame(rows, "alert string, ts timestamp, firing boolean")
    live = drain(alerts.sustained(stream_of(spark, tmp_path, frame), 30 * 60), "alerts_live")
    got = sorted((r.alert, r.started) for r in live.collect())
    assert got[0] == ("p", minutes(0)) and all(a == "p" for a, _ in got) and len(got) == len(set(got))


def test_streaming_last_values(spark, tmp_path):
    frame = spark.createDataFrame(
        [(minutes(1), "a", 1.0), (minutes(3), "a", 2.0), (minutes(62), "a", 5.0), (minutes(900), "a", 9.0)],
        "ts timestamp, source string, v double",
    )
    live = drain(alerts.last_values(stream_of(spark, tmp_path, frame), "v", ["source"], "1 hour"), "last_live")
    got = {r.window_end: r.v for r in live.collect()}
    assert got[minutes(5)] == 2.0 and got[minutes(60)] == 2.0 and got[minutes(65)] == 5.0 and minutes(130) not in got


def test_bounded_dedup(spark, tmp_path):
    frame = spark.createDataFrame(
        [("k", minutes(0)), ("k", minutes(10)), ("z", minutes(5))], "external_id string, received_at timestamp"
    )
    live = drain(ingest.bounded_dedup(stream_of(spark, tmp_path, frame)), "dedup_live")
    assert sorted(r.external_id for r in live.collect()) == ["k", "z"]


def test_held_values_equal_copied_windows(spark):
    rows = [("a", 0, 1.0), ("a", 4, 2.0), ("a", 4, 3.0), ("a", 11, None), ("a", 171, 4.0), ("a", 900, 5.0), ("b", 33, 6.0), (None, 7, 7.0)]
    samples = spark.createDataFrame(rows, "source STRING, minute INT, value DOUBLE").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)
    )
    for window in ("5 minutes", "3 hours", "12 hours"):
        copied = monitor.last_value(samples, "value", ["source"], window, tie="value").collect()
        held = monitor.held_value(samples, "value", ["source"], window, tie="value").collect()
        key = lambda r: (r["window_end"], r["source"] or "", r["value"])
        assert sorted(map(key, held)) == sorted(map(key, copied)) and held
