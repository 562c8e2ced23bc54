"""Customer and case states rolled up from changes, against days made loan by loan, and without a shuffle of days."""

import datetime as dt

from pyspark.sql import functions as F
from test_states import Tables, day

from duewise.plans import daily_state as ds


def tables(spark):
    plans = [(i, 100 + i % 3, day(i % 50), 100.0 + i) for i in range(30)]
    paid = [(i, day(20 + 7 * n), 25.0, "SUCCESS") for i in range(0, 30, 2) for n in range(1 + i % 6)]
    # Loans 0 to 9 are in two cases of one customer, 10 to 14 in cases of two customers; case 6 begins late, case 7 has no date.
    mapping = [(i, i % 5) for i in range(30)] + [(i, 5) for i in range(0, 10, 5)] + [(i, 6) for i in range(10, 15)] + [(3, 7), (29, 99)]
    cases = [(c, 500 + c % 5, "V", "L", c, dt.datetime(2001, 1, 1) + dt.timedelta(days=9 * c)) for c in range(6)]
    cases += [(6, 777, "V", "L", 6, dt.datetime(2001, 3, 1)), (7, 503, None, None, None, None), (8, None, "V", "L", 8, dt.datetime(2001, 1, 1))]
    mapping += [(4, 8), (4, 4)]
    return Tables(
        day(30), day(90),
        ods_repayment_plan=spark.createDataFrame(plans, "loan_id long, customer_id long, due_date date, due_amount double"),
        dwd_repayment_detail_di=spark.createDataFrame(paid, "loan_id long, repay_date date, repay_amount double, repay_status string"),
        dim_case_loan_mapping=spark.createDataFrame(mapping, "loan_id long, case_id long"),
        dim_case=spark.createDataFrame(
            cases, "case_id long, customer_id long, current_vendor_id string, current_line_id string, collector_id long, case_create_time timestamp_ntz"),
    )


def test_states_are_those_of_days_made_loan_by_loan(spark):
    wh = tables(spark)
    loans = ds.loan_daily_state(wh)
    old = sorted(map(str, ds.case_daily_state(wh, loans).collect()))
    assert len(old) > 300 and old == sorted(map(str, ds.case_daily_state(wh).collect()))
    owed = ds.active_case_loans(wh, loans).filter("outstanding_amount > 0").groupBy("stat_date", F.col("case_customer_id").alias("customer_id"))
    want = {(r.stat_date, r.customer_id): r.n for r in owed.agg(F.countDistinct("loan_id").alias("n")).collect() if r.customer_id is not None}
    got = {(r.stat_date, r.customer_id): r.active_loan_count for r in ds.customer_daily_state(wh).collect() if r.active_loan_count}
    assert got == want and max(want.values()) > 3


def test_days_of_loans_are_not_shuffled(spark):
    wh = tables(spark)
    assert "hashpartitioning(stat_date" not in ds.case_daily_state(wh)._jdf.queryExecution().executedPlan().toString()


def test_built_snapshots_are_checked_without_being_written(spark, monkeypatch):
    from duewise.catalog import open_warehouse
    from duewise.plans import checks, warehouse

    def stage(df, name):
        raise AssertionError(f"{name} was written")

    monkeypatch.setattr(warehouse, "stage", stage)
    rows = {r.check_name: r.bad_count for r in checks.snapshot_invariants(open_warehouse(spark, "/root/testdata/sf0.001")).collect()}
    assert set(rows.values()) == {0} and len(rows) == 4
    from duewise.catalog import QUERIES, load
    load()
    assert {r.bad_count for r in QUERIES["quality_snapshot_invariants"](spark, "/root/testdata/sf0.001").collect()} == {0}


def test_wrong_days_of_a_given_snapshot_are_counted(spark):
    from duewise.plans import checks

    wh = tables(spark)
    good = ds.loan_daily_state(wh)
    bad = F.when((F.col("loan_id") == 1) & F.col("stat_date").between(day(60), day(63)), F.col("outstanding_amount") + 5.0)
    wh["ods_loan_daily_snapshot"] = good.withColumn("outstanding_amount", F.coalesce(bad, "outstanding_amount"))
    wh.strict = True
    got = {r.check_name: r.bad_count for r in checks.snapshot_invariants(wh).collect()}
    assert (got["outstanding_rises"], got["outstanding_is_due_less_repaid"], got["dpd_when_paid"]) == (1, 4, 0)
