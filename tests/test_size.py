"""What grows with the tables: rows through the driver, shuffles, and views computed again."""

import datetime
import io
import random
from contextlib import redirect_stdout
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F

from txnrecon import schema
from txnrecon.operators import extract, reconcile, similarity
from txnrecon.plans import catalog, notifications, views
from txnrecon.sources import ledger_table
from txnrecon.streaming import ingest, late


def plan_of(frame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


JOURNALS = "account_id BIGINT, journal_id BIGINT, txn_date DATE, merchant STRING, external_id STRING"


def test_many_days_asked_for_stay_off_the_driver(spark, tmp_path):
    journals = spark.range(3000).select(
        F.col("id").alias("account_id"), F.col("id").alias("journal_id"), F.lit("2024-02-01").cast("date").alias("txn_date"),
        F.lit("shop").alias("merchant"), F.lit("bpstmt:1").alias("external_id"),
    )
    ledger_table.write(journals, str(tmp_path / "ledger"))
    ledger = ledger_table.read(spark, str(tmp_path / "ledger"), journals.schema)
    since, until = F.lit("2024-01-01").cast("date"), F.lit("2024-03-01").cast("date")
    asked = spark.range(2500).select(F.col("id").alias("account_id"), since.alias("since"), until.alias("until"))
    found = ledger_table.within(ledger, asked)
    assert "BroadcastHashJoin LeftSemi" not in plan_of(found).replace("\n", " ").replace("Join type: ", "")
    assert "SortMergeJoin" in plan_of(found)
    assert found.count() == 2500
    assert ledger_table.within(ledger, asked.limit(3)).count() == 3


def test_late_alerts_meet_the_ledger_once(spark, tmp_path, monkeypatch):
    calls = []
    near = ledger_table.within
    monkeypatch.setattr(ledger_table, "within", lambda *a: (calls.append(a), near(*a))[1])
    rows = [(1, 7, "2024-02-01", "Shop", "bpstmt:1"), (1, 5, "2024-02-02", "shop", None), (2, 6, "2024-02-02", "shop", "bpstmt:2")]
    journals = spark.createDataFrame(rows, JOURNALS.replace("DATE", "STRING")).withColumn("txn_date", F.col("txn_date").cast("date"))
    ledger_table.write(journals, str(tmp_path / "ledger"))
    alerts = spark.sql("SELECT 1L AS o, 1L AS account_id, DATE'2024-02-03' AS txn_date, 'SHOP' AS merchant")
    probed = late.probe(alerts, ledger_table.read(spark, str(tmp_path / "ledger"), journals.schema))
    assert [tuple(r)[-1] for r in probed.collect()] == [7]
    # Only what was met is read again, not the ledger by month.
    assert len(calls) == 1 and "PartitionFilters" not in plan_of(probed)


def test_an_epoch_moves_its_rows_thrice(spark, tmp_path, monkeypatch):
    moved = []
    write, keep = ingest.write_epoch, ingest.materialize

    def seen(frame):
        moved.append(plan_of(frame).split("\n\n\n")[0].count("Exchange hashpartitioning") or plan_of(frame).count(") Exchange\n"))
        return frame

    monkeypatch.setattr(ingest, "write_epoch", lambda frame, *a: write(seen(frame), *a))
    monkeypatch.setattr(ingest, "materialize", lambda frame: keep(seen(frame)))
    fields = "msg_id STRING, msg_seq BIGINT, rec_idx BIGINT, external_id STRING, waits BOOLEAN"
    rows = [("a", 1, 0, "k", False), ("b", 2, 0, "k", False), ("c", 3, 0, "x", True), ("c", 2, 0, "y", False), (None, 4, 0, "z", True)]

    def decide(messages):
        outcome = F.when(F.col("waits"), "deferred").otherwise("open")
        both = messages.withColumn("rec_idx", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
        return both.select(
            "msg_id", "msg_seq", "rec_idx", F.concat("external_id", F.col("rec_idx").cast("string")).alias("external_id"),
            F.when(F.col("rec_idx") == 0, outcome).otherwise("open").alias("outcome"), F.lit(None).cast("string").alias("reason"),
        )

    ingest.settle_epoch(spark.createDataFrame(rows, fields), 5, str(tmp_path), decide, fields)
    out = spark.read.parquet(str(tmp_path / "outcomes/epoch=5"))
    assert sorted((r["msg_id"] or "", r["rec_idx"], r["outcome"]) for r in out.collect()) == [
        ("", 0, "deferred"), ("", 1, "booked"), ("a", 0, "booked"), ("a", 1, "booked"),
        ("b", 0, "duplicate"), ("b", 1, "duplicate"), ("c", 0, "deferred"), ("c", 1, "deferred"),
    ]
    booked = spark.read.parquet(str(tmp_path / "ledger/epoch=5"))
    assert sorted(r["external_id"] for r in booked.collect()) == ["k0", "k1", "z1"]
    waiting = spark.read.parquet(str(tmp_path / "deferred/epoch=5")).collect()
    assert [(r["msg_id"], r["external_id"]) for r in waiting] == [("c", "x")]
    # Newest versions, those that wait, keys held and first uses; for what is kept, versions of the few that wait.
    assert sum(moved) <= 8, moved


def test_of_equally_new_versions_the_one_just_come_counts(spark):
    rows = [("a", 1, "old", 0), ("a", 1, "new", 1), ("b", 2, "later", 0), ("b", 1, "sooner", 1), (None, None, "x", 1)]
    found = ingest.newest(spark.createDataFrame(rows, "msg_id STRING, msg_seq BIGINT, text STRING, _come INT"))
    assert found.columns == ["msg_id", "msg_seq", "text"]
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 1, "new"), ("b", 2, "later"), (None, None, "x")]


def counted(monkeypatch, module, name):
    calls, was = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), was(*a, **k))[1])
    return calls


def test_orders_are_bought_once_for_reconciliation(spark, sf, monkeypatch):
    calls = counted(monkeypatch, views, "orders")
    asked, _ = catalog._asked(spark, sf)
    assert len(calls) == 1 and "merchant" not in asked.columns


def test_small_blocks_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_BLOCKS", 50)
    names = spark.range(200).select("id", F.concat(F.lit("shop "), F.col("id").cast("string")).alias("name"))
    found = similarity.similar_names(names, names, ["id"], 0.7)
    assert found.rdd.getNumPartitions() >= 4
    assert found.where("name_a = name_b AND score = 1").count() == 200


def test_names_that_are_missing_match_nothing(spark):
    names = spark.createDataFrame([(1, "shop"), (1, None), (2, None)], "id INT, name STRING")
    found = similarity.similar_names(names, names, ["id"], 0.7)
    assert [tuple(r) for r in found.collect()] == [(1, "shop", "shop", 1.0)]


def test_mail_is_unwrapped_once(spark, sf, monkeypatch):
    calls = counted(monkeypatch, views, "orders")
    decided, _, _ = catalog._decided(spark, sf)
    assert len(calls) == 1 and extract.FORWARD_MARKER not in decided._jdf.queryExecution().optimizedPlan().toString()


def test_body_is_kept_for_branches_that_read_it(spark, sf, monkeypatch):
    kept = []
    was = notifications.materialize
    monkeypatch.setattr(notifications, "materialize", lambda frame: (kept.append(was(frame)), kept[-1])[1])
    catalog._decided(spark, sf)
    read = F.col("branch").isin("model", "deterministic")
    assert kept[0].where(read != F.col("body").isNotNull()).isEmpty() and not kept[0].where(~read).isEmpty()


DAY = datetime.date(2026, 4, 20)


def ledger_rows(seed):
    """Charges and journals of a few accounts, some crowded, some values missing."""
    rng = random.Random(seed)
    names = ["shop", "shop online", "shopp", "café ñandú", "ñandú", "red anvil", "anvil", "", None]

    def row(i):
        account = rng.choice([1, 1, 1, 2, 3, None])
        return account, i, rng.choice(names), Decimal(rng.choice([10, 11, 40])), rng.choice(["USD", "USD", "EUR", None])

    def day():
        return rng.choice([None, *[DAY + datetime.timedelta(k) for k in range(-25, 25)]])

    charges, journals = [], []
    for i in range(120):
        account, _, name, amount, currency = row(i)
        charges.append((account, i, f"{i:010d}", name, amount, currency, day()))
        account, _, name, amount, currency = row(i)
        held = rng.choice([None, None, "tx", f"bpstmt:{rng.randint(0, 119):010d}"])
        journals.append((account, rng.choice([i, i, i, None]), day(), amount, currency, name, held))
    return charges, journals


def test_rows_that_meet_in_a_bucket_need_no_blocks(spark, monkeypatch):
    """Charges and journals move once each; blocks of names are for crowded keys, with the same result."""
    c, j = ledger_rows(5)
    j = [r for r in j if r[1] is not None]
    charges, journals = spark.createDataFrame(c, schema.CHARGES), spark.createDataFrame(j, schema.JOURNALS)
    calls = counted(monkeypatch, reconcile, "similar_names")
    columns = ["charge_id", "intent", "n_plausible", "best_journal", "best_score", "second_score", "journal_id"]

    def asked():
        return sorted(map(tuple, reconcile.intents(charges, journals).select(*columns).collect()))

    plain = asked()
    assert not calls and len(plain) == 120
    assert {r[1] for r in plain} >= {"exact", "claim", "book", "review_ambiguous"}
    for few in (0, 4):
        monkeypatch.setattr(reconcile, "FEW", few)
        assert asked() == plain
    assert len(calls) == 2


def test_keys_are_whole_however_rows_are_cut(monkeypatch):
    rng = random.Random(3)
    rows = []
    for key in range(30):
        for side in [-1] * rng.randint(0, 2) + [0] * rng.randint(0, 4) + [1] * rng.randint(0, 5):
            name = rng.choice(["shop", "shop online", "red anvil", "anvil"])
            rows.append((key, side, rng.randint(0, 8), name, "", len(rows), rng.random() < 0.7))
    names = ["key", "_side", "day", "name", "toks", "_id", "_free"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    compare = similarity.best_near(0.7, 5, ["key"], [])

    def found(batches):
        return [r for b in compare(iter(batches)) for r in b.to_pylist()]

    want = found([whole])
    assert len(want) == sum(r[1] < 1 for r in rows) and any(r["second_score"] for r in want)
    monkeypatch.setattr(similarity, "TASK_ROWS", 5)
    for size in (1, 3, 7):
        assert found([whole.slice(k, size) for k in range(0, len(rows), size)]) == want
