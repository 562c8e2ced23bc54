"""What a window reads and joins: sizes the planner sees, repayments of its plans only, the newest day from the last days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duewise.catalog import open_warehouse
from duewise.operators.ordering import dedupe
from duewise.plans.attribution import newest_due_day, on_days_met
from duewise.plans.warehouse import Warehouse
from duewise.sources.dated import DatedSource
from duewise.sources.domain import PANEL_DAYS, StarSchemaDomain

FOLDER = "/root/testdata/sf0.001"


def size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.mark.parametrize(("snapshot", "key", "one_a_day"), [
    ("ods_customer_daily_snapshot", "customer_id", "dim_customer"), ("ods_case_daily_snapshot", "case_id", "dim_case")])
def test_a_snapshot_is_not_taken_for_a_table_of_one_day(spark, snapshot, key, one_a_day):
    source = StarSchemaDomain(spark, FOLDER)
    assert size(source.table(snapshot).select(key, "stat_date")) >= PANEL_DAYS * size(source.raw("customer").select("c_custkey"))
    days = source.table(snapshot).groupBy("stat_date").agg(F.countDistinct(key).alias("keys"), F.count(F.lit(1)).alias("rows")).collect()
    n = source.table(one_a_day).count()
    assert len(days) == PANEL_DAYS and {(r["keys"], r["rows"]) for r in days} == {(n, n)}
    assert (min(r.stat_date for r in days), max(r.stat_date for r in days)) == (dt.date(2001, 6, 3), dt.date(2001, 8, 1))


def lines_source(spark, lines, orders):
    source = StarSchemaDomain(spark, FOLDER)
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    source._raw["lineitem"] = spark.createDataFrame(lines, schema)
    order_schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    source._raw["orders"] = spark.createDataFrame(orders, order_schema)
    return source


def test_repayments_of_a_window_are_those_of_its_plans(spark):
    at = dt.datetime(2001, 7, 30)
    lines = [(1, 1, 7, 8, 100.0, 0.0, "N", at), (1, 1, 7, 8, 90.0, 0.0, "N", at), (2, 1, 7, 8, 50.0, 0.0, "N", at)]
    # Ids that miss a key: "1-7-8" of plan 1, and of rows without a plan, which comes first and wins the id.
    lines += [(1, None, 7, 8, 30.0, 0.0, "N", at), (None, 1, 7, 8, 20.0, 0.0, "N", at - dt.timedelta(days=1))]
    lines += [(n, 1, 7, 8, 10.0, 0.0, "N", at) for n in range(100, 140)]
    orders = [(1, 11, "O", 500.0, at, "x"), (2, 11, "O", 500.0, at - dt.timedelta(days=400), "x")]
    whole = Warehouse(lines_source(spark, lines, orders))
    window = Warehouse(DatedSource(whole.source, dt.date(2001, 7, 1)))
    due = window["dwd_due_plan_detail_di"]
    assert [r.plan_id for r in due.collect()] == [1]
    repaid = window.repayments(due)
    assert sorted((r.plan_id or 0, r.repay_amount) for r in repaid.collect()) == [(0, 20.0), (1, 90.0)]
    ids = whole["dwd_repayment_detail_di"].filter("plan_id = 1 OR plan_id IS NULL").select(*repaid.columns)
    assert sorted(map(str, ids.collect())) == sorted(map(str, repaid.collect()))
    assert window["dws_loan_status_snapshot_di"].first().repaid_amount_d7 == whole["dws_loan_status_snapshot_di"].filter("loan_id = 1").first().repaid_amount_d7 == 90.0


def test_snapshot_rows_are_those_a_join_meets(spark):
    wh = open_warehouse(spark, FOLDER)
    old, day = dt.date(1996, 1, 1), dt.date(2001, 7, 4)
    base = spark.createDataFrame([(day, 3), (day, 3), (day, None), (old, 4), (dt.date(2001, 7, 5), 10**9)], "stat_date date, customer_id long")
    got = on_days_met(wh["dws_customer_status_snapshot_di"], base, "customer_id").select("stat_date", "customer_id").collect()
    assert [tuple(r) for r in got] == [(day, 3)]


def test_the_newest_day_is_found_outside_the_first_span(spark):
    wh = open_warehouse(spark, FOLDER)
    want = wh["dwd_due_plan_detail_di"].filter("dpd_bucket = 'M1'").agg(F.max("stat_date")).first()[0]
    assert newest_due_day(wh) == newest_due_day(wh, days=1) == want
    # Cases of M1 have ids of which five leave 0 or 1: customer 20 is in case 2, of another bucket.
    late, early = dt.datetime(2001, 8, 1), dt.datetime(1999, 3, 2)
    orders = [(n, 20, "O", 1.0, late - dt.timedelta(days=n), "x") for n in range(200)] + [(900, 10, "O", 1.0, early, "x"), (901, 10, "O", 1.0, dt.datetime(1995, 1, 1), "x")]
    source = lines_source(spark, [], orders)
    assert newest_due_day(Warehouse(source)) == early.date()
    assert newest_due_day(Warehouse(lines_source(spark, [], orders[:200]))) is None


def test_first_rows_of_loans_stay_the_same(spark):
    wh = open_warehouse(spark, FOLDER)
    first = dt.date(2001, 6, 3)
    window = Warehouse(DatedSource(wh.source, first))
    names = wh["dwd_due_plan_detail_di"].columns
    want = dedupe(wh["dwd_due_plan_detail_di"].filter(F.col("stat_date") >= F.lit(first)), names, names)
    assert sorted(map(str, window["dwd_due_plan_detail_di"].select(*names).collect())) == sorted(map(str, want.collect()))


def test_days_are_made_in_many_tasks_and_not_shuffled(spark):
    table = StarSchemaDomain(spark, FOLDER).table("ods_customer_daily_snapshot")
    assert table.select("customer_id", "stat_date").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = table.groupBy("stat_date", "customer_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stat_date" not in plan and "BroadcastNestedLoopJoin" in plan


def test_the_whole_fact_does_not_make_the_windows_fact(spark, monkeypatch):
    from duewise.plans import attribution

    made = []
    monkeypatch.setattr(attribution, "recovery_fact", lambda wh: made.append(wh.dated) or wh["dim_loan"])
    run = attribution.Attribution(open_warehouse(spark, FOLDER))
    assert run.fact is not None and run.overall.count() == 1 and made == [False]
