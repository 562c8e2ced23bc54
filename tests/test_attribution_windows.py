"""Attribution over pruned windows: loan counts without a distinct count, values seen only outside the windows."""

import datetime as dt

from pyspark.sql import functions as F
from test_engines import DAY0, DAYS, attribution_frames

from duewise.operators.windows import bounds_from
from duewise.plans.attribution import Attribution, segment_periods
from duewise.plans.warehouse import Warehouse
from duewise.sources.tables import FrameSet

DIMENSIONS = ["vendor_id", "region"]


def fact_of(spark, rows):
    schema = "stat_date date, loan_id long, vendor_id string, region string, repaid_amount_d7 double, due_amount double"
    counts = {c: F.lit(1).cast("long") for c in (
        "action_count", "ai_action_count", "manual_action_count", "connected_count", "ptp_count", "ptp_fulfilled_count")}
    return spark.createDataFrame(rows, schema).withColumns(counts).withColumns({"reduction_used": F.lit(True), "complaint_flag": F.lit(False)})


def test_loan_counts_are_distinct_per_value_and_period(spark):
    newest = DAYS[-1]
    rows = []
    for i, day in enumerate(DAYS):
        for loan in range(6):
            # A loan changes its vendor from day to day, and its region once in a window.
            rows.append((day, loan, f"V{(i + loan) % 3}", "UNKNOWN" if loan == 5 else f"R{i // 7 % 2}", 1.0, 2.0))
        rows.append((day, None, "V0", "R0", 1.0, 2.0))
    rows.append((DAY0 - dt.timedelta(days=1), 99, "V0", "R0", 1.0, 2.0))
    fact = fact_of(spark, rows)
    bounds = bounds_from(F.lit(newest))
    got = {(r.dimension_name, r.dimension_value, r.period): r for r in segment_periods(fact, bounds, DIMENSIONS).collect()}
    want = {}
    for day, loan, *values, paid, due in rows:
        if day < DAY0:
            continue
        period = "baseline" if (newest - day).days >= 30 else "recent"
        for name, value in zip(DIMENSIONS, values, strict=True):
            if value != "UNKNOWN":
                loans, n, repaid = want.setdefault((name, value, period), [set(), 0, 0.0])
                want[name, value, period] = [loans | ({loan} - {None}), n + 1, repaid + paid]
    assert set(got) == set(want)
    for key, (loans, n, repaid) in want.items():
        assert (got[key].loan_count, got[key].actions, got[key].numerator, got[key].denominator) == (len(loans), n, repaid, 2 * n)
        assert (got[key].reduced, got[key].complained) == (n, 0)


def test_a_value_outside_the_windows_keeps_its_dimension(spark):
    frames = attribution_frames(spark)
    # In the windows channel_code is UNKNOWN or APP; a loan of an older day shows that there is another channel.
    assert "channel_code" not in {r.dimension_name for r in Attribution(Warehouse(FrameSet(spark, frames), strict=True)).segments.collect()}
    loans, channels = frames["dws_loan_status_snapshot_di"], frames["dim_loan"]
    old = spark.createDataFrame([(DAY0 - dt.timedelta(days=9), 9999, 9999, "P_CASH", "M1", 1000.0, 0.0)], loans.schema)
    frames["dws_loan_status_snapshot_di"] = loans.unionByName(old)
    frames["dim_loan"] = channels.unionByName(spark.createDataFrame([(9999, "WEB")], channels.schema))
    run = Attribution(Warehouse(FrameSet(spark, frames), strict=True))
    segments = {(r.dimension_name, r.dimension_value): r for r in run.segments.collect()}
    assert ("channel_code", "APP") in segments and ("channel_code", "WEB") not in segments
    assert segments["product_code", "P_CASH"].loan_count_baseline == 60
    assert run.overall.first().baseline_total == 0.22


def test_no_rows(spark):
    frames = attribution_frames(spark)
    frames["dws_loan_status_snapshot_di"] = frames["dws_loan_status_snapshot_di"].limit(0)
    assert Attribution(Warehouse(FrameSet(spark, frames), strict=True)).results().count() == 0


def test_the_first_day_reaches_the_scan(spark, tmp_path):
    frames = attribution_frames(spark)
    frames["dws_loan_status_snapshot_di"].write.parquet(f"{tmp_path}/loans")
    frames["dws_loan_status_snapshot_di"] = spark.read.parquet(f"{tmp_path}/loans")
    run = Attribution(Warehouse(FrameSet(spark, frames), strict=True))
    plan = run.window_fact._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(f"GreaterThanOrEqual(stat_date,{DAY0})" in line for line in scans)
