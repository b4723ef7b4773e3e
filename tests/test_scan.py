"""What runs leave to later runs: the mailbox cursor, the ledger by month, late alerts, cached rates."""

import io
from contextlib import redirect_stdout
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txnrecon.sources import ledger_table, rate_cache
from txnrecon.streaming import ingest, late, scan

FIELDS = "msg_id STRING, seq BIGINT, in_inbox BOOLEAN, body STRING"


def plan_of(frame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.fixture
def box(spark, tmp_path):
    """A mailbox: add(rows), run(...), outcomes()."""

    class Box:
        root, log = str(tmp_path / "root"), str(tmp_path / "log")

        def add(self, *rows, stretch=10):
            scan.append(spark.createDataFrame(rows, FIELDS), self.log, stretch)

        def run(self, deferred=(), dry_run=False):
            def decide(messages):
                waits = F.col("msg_id").isin(list(deferred))
                return messages.select("msg_id", "seq", F.when(waits, "deferred").otherwise("booked").alias("outcome"), F.lit(None).alias("reason"))

            found = scan.run(spark, self.root, self.log, FIELDS, decide, dry_run, 10)
            return sorted((r["msg_id"], r["seq"], r["outcome"]) for r in found.collect())

        def cursor(self):
            return scan.cursor(spark, self.root)[1]

        def outcomes(self):
            rows = ingest.read_table(spark, f"{self.root}/outcomes", scan.OUTCOMES).collect()
            return sorted((r["msg_id"], r["seq"], r["outcome"]) for r in rows)

    return Box()


def test_created_and_changed_messages_come_once(box):
    box.add(("a", 1, True, "x"), ("b", 2, True, "y"), ("a", 3, True, "z"), ("c", 4, True, ""), ("c", 5, False, ""))
    assert box.run() == [("a", 3, "booked"), ("b", 2, "booked")]
    assert box.cursor() == 5
    assert box.run() == []
    box.add(("b", 6, True, "again"), ("d", 7, True, None))
    assert box.run() == [("b", 6, "booked"), ("d", 7, "booked")]


def test_a_dry_run_writes_nothing(box):
    box.add(("a", 1, True, "x"))
    assert box.run(dry_run=True) == [("a", 1, "booked")]
    assert box.cursor() is None and box.outcomes() == []
    assert box.run() == [("a", 1, "booked")]


def test_a_deferral_keeps_the_cursor_and_repeats_only_what_waits(box):
    box.add(("a", 1, True, "x"), ("b", 2, True, "y"))
    assert box.run(deferred=["b"]) == [("a", 1, "booked"), ("b", 2, "deferred")]
    assert box.cursor() is None
    assert box.run(deferred=["b"]) == [("b", 2, "deferred")]
    box.add(("a", 3, True, "changed"))
    assert box.run() == [("a", 3, "booked"), ("b", 2, "booked")]
    assert box.cursor() == 3


def test_a_run_killed_before_its_cursor_repeats_nothing(box, monkeypatch):
    box.add(("a", 1, True, "x"), ("b", 2, True, "y"))
    write = ingest.write_epoch

    def dies(df, path, epoch):
        if path.endswith("cursor"):
            raise RuntimeError("killed")
        write(df, path, epoch)

    monkeypatch.setattr(ingest, "write_epoch", dies)
    with pytest.raises(RuntimeError):
        box.run()
    monkeypatch.setattr(ingest, "write_epoch", write)
    assert box.run() == []
    assert box.cursor() == 2
    assert box.outcomes() == [("a", 1, "booked"), ("b", 2, "booked")]


def test_an_absent_log_and_a_repeated_append(box):
    assert box.run() == [] and box.cursor() is None
    box.add(("a", 1, True, "x"))
    box.add(("a", 1, True, "x"))
    assert box.run() == [("a", 1, "booked")]


def test_stretches_before_the_cursor_are_not_read(spark, box):
    box.add(*[(str(k), k, True, "") for k in range(95)])
    new = scan.since(spark, box.log, FIELDS, 80, 10)
    assert new.count() == 14
    assert "PartitionFilters: [isnotnull(stretch" in plan_of(new)
    assert {r[0].split("stretch=")[1][0] for r in new.select(F.input_file_name()).distinct().collect()} <= {"8", "9"}


LEDGER = "account_id BIGINT, journal_id BIGINT, txn_date DATE"


def test_a_window_reads_its_months(spark, tmp_path):
    rows = [(k % 3, k, date(1995 + k // 240, 1 + k // 20 % 12, 1 + k % 20)) for k in range(720)] + [(0, 999, None)]
    journals = spark.createDataFrame(rows, LEDGER)
    ledger_table.write(journals, str(tmp_path / "ledger"), files=2)
    ledger = ledger_table.read(spark, str(tmp_path / "ledger"), journals.schema)
    assert ledger.count() == 721
    since, until = date(1996, 3, 15), date(1996, 4, 2)
    windows = [(0, since, until), (0, date(1996, 4, 1), until), (1, since, since), (7, since, until), (2, None, None)]
    asked = spark.createDataFrame(windows, "account_id BIGINT, since DATE, until DATE")
    found = ledger_table.within(ledger, asked)
    expected = {k for a, k, d in rows if d and ((a == 0 and since <= d <= until) or (a == 1 and d == since))}
    got = [r["journal_id"] for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected
    filters = [line for line in plan_of(found).splitlines() if "PartitionFilters" in line]
    assert any("month" in line and "ubquery" in line for line in filters)
    none = ledger_table.within(ledger, asked.limit(0))
    assert none.count() == 0


ALERT = "alert_id BIGINT, account_id BIGINT, txn_date DATE, merchant STRING"


def test_late_alerts_meet_the_bookings_near_them(spark, tmp_path):
    day = date(1997, 12, 30)
    journals = spark.createDataFrame(
        [
            (1, 10, day, "Corner Bakery", "bpstmt:1"), (1, 11, date(1998, 1, 9), "Corner Bakery", "bpstmt:2"),
            (1, 12, day, "Corner Bakery", "tx-3"), (2, 13, day, "Corner Bakery", None), (3, 14, None, "Corner Bakery", "bpstmt:4"),
        ],
        "account_id BIGINT, journal_id BIGINT, txn_date DATE, merchant STRING, external_id STRING",
    )
    ledger_table.write(journals, str(tmp_path / "ledger"))
    ledger = ledger_table.read(spark, str(tmp_path / "ledger"), journals.schema)
    files = [
        [(1, 1, date(1998, 1, 4), "CORNER BAKERY"), (2, 1, date(1998, 1, 20), "CORNER BAKERY"), (3, 2, day, "CORNER BAKERY")],
        [(4, 1, date(1997, 12, 25), "CORNER BAKERY #2"), (5, 1, day, "ZQX"), (6, None, day, "CORNER BAKERY"), (7, 3, None, "CORNER BAKERY")],
    ]
    for rows in files:
        spark.createDataFrame(rows, ALERT).coalesce(1).write.mode("append").parquet(str(tmp_path / "alerts"))
    for _ in range(2):
        late.run(ingest.read_new(spark, str(tmp_path / "alerts"), ALERT, 1), ledger, str(tmp_path / "root")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "root/late")).collect()
    assert {r["epoch"] for r in rows} == {0, 1}
    assert {r["alert_id"]: r["statement_journal_id"] for r in rows} == {1: 10, 2: None, 3: None, 4: 10, 5: None, 6: None, 7: None}
    assert len(rows) == 7


def test_cached_rates_are_not_fetched_again(spark, tmp_path):
    path, asked = str(tmp_path / "rates"), []
    old, today = date(1998, 6, 29), date(1998, 6, 30)
    needed = spark.createDataFrame(
        [("usd", "EUR", old), ("USD", "EUR", today), ("USD", "USD", old), ("GBP", "EUR", old)], "from_ccy STRING, to_ccy STRING, rate_date DATE"
    )

    def fetch(keys):
        asked.append({(r["from_ccy"], r["rate_date"]) for r in keys.collect()})
        price = F.when(F.col("from_ccy") == "USD", F.lit("0.000061234567"))
        return keys.withColumn("rate", price)

    def at(minute):
        return F.lit(datetime(1998, 6, 30, 9, minute))

    assert rate_cache.read(spark, path).count() == 0
    rate_cache.refresh(spark, path, needed, fetch, at(0), 0)
    rate_cache.refresh(spark, path, needed, fetch, at(10), 1)
    rate_cache.refresh(spark, path, needed, fetch, at(20), 2)
    rate_cache.refresh(spark, path, needed, fetch, at(20), 2)
    both, unknown = {("USD", old), ("USD", today), ("GBP", old)}, ("GBP", old)
    assert asked == [both, {unknown}, {("USD", today), unknown}, {("USD", today), unknown}]
    entries = rate_cache.read(spark, path)
    assert entries.count() == 3 and {r["rate"] for r in entries.collect()} == {Decimal("0.000061234567")}
    kept = rate_cache.compacted(entries, at(20)).collect()
    assert sorted((r["from_ccy"], r["rate_date"], r["fetched_at"].minute) for r in kept) == [("USD", old, 0), ("USD", today, 20)]
    assert rate_cache.compacted(entries, at(59)).count() == 1
