"""Every registered query against its SQL, and the shape of the plans."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as contract
from tools import check
from txnrecon.plans import catalog, oracle, views

@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf, duck, name):
    frame = contract.queries()[name](spark, sf)
    mine, columns = check.rows_of(frame.columns, frame.collect())
    if name in oracle.ORACLE:
        rel = duck.sql(oracle.ORACLE[name])
        theirs, their_columns = check.rows_of(rel.columns, rel.fetchall())
        assert columns == their_columns
        assert mine == theirs


def test_every_oracle_names_a_query():
    assert set(oracle.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def plan_of(frame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    ["fx_asof_convert", "usd_ceiling", "account_route", "dedup_first_wins", "alias_canonical", "ledger_payload",
     "recon_candidates", "double_book_probe", "source_dispatch"],
)
def test_no_cross_or_nested_loop_join(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_used(spark, sf):
    plan = plan_of(catalog.fx_asof_convert(spark, sf))
    assert "o_orderpriority" in plan and "p_brand" not in plan.split("ReadSchema")[-1]


def test_dimension_filter_reaches_the_scan(spark, sf):
    plan = plan_of(views.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
