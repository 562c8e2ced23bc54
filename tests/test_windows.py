"""Checks over pruned windows: the same result as over all history, the D7 fallback, predicates in the scans."""

import datetime as dt

from test_engines import DAY0, DAYS, step_frames

from duewise.plans.anomaly import Detection
from duewise.plans.warehouse import Warehouse
from duewise.sources.tables import FrameSet


def long_history(spark):
    """The step frames after four hundred older days, and a vendor that stopped two hundred days ago."""
    frames = step_frames(spark)
    older = [DAY0 - dt.timedelta(days=i) for i in range(1, 401)]
    board = frames["ads_postloan_dashboard_di"]
    frames["ads_postloan_dashboard_di"] = board.unionByName(spark.createDataFrame([(d, .9, .9) for d in older], board.schema))
    vendor = frames["ads_vendor_performance_di"]
    stopped = [(d, "V_OLD", .30 if i < 230 else .50) for i, d in enumerate(older) if i >= 200]
    frames["ads_vendor_performance_di"] = vendor.unionByName(spark.createDataFrame([*stopped, *((d, "V_A", .9) for d in older)], vendor.schema))
    return frames


def test_each_series_keeps_its_own_window(spark):
    run = Detection(Warehouse(FrameSet(spark, long_history(spark)), strict=True))
    rows = {(r.metric_code, r.dimension_value): r for r in run.checks.collect()}
    old = rows["connect_rate", "V_OLD"]
    assert (round(old.baseline_value, 6), round(old.recent_value, 6), old.fired) == (.5, .3, True)
    newest = DAY0 - dt.timedelta(days=201)
    assert old.recent_window == f"{newest - dt.timedelta(days=29)}~{newest}"
    assert rows["connect_rate", "V_A"].recent_value == .36 and rows["m1_recovery_rate", "ALL"].baseline_value == .2
    # The earliest window decides for all sources: that of the vendor that stopped.
    assert run.wh.source.first == newest - dt.timedelta(days=59)


def test_d7_rate_stands_in_for_a_missing_m1_rate(spark):
    frames = step_frames(spark)
    frames["ads_postloan_dashboard_di"] = frames["ads_postloan_dashboard_di"].withColumnRenamed("m1_recovery_rate", "recovery_rate_d7")
    run = Detection(Warehouse(FrameSet(spark, frames), strict=True))
    rows = {r.metric_code: r for r in run.findings.collect()}
    assert "m1_recovery_rate" not in rows and len(rows) == 7
    d7 = rows["recovery_rate_d7"]
    assert (d7.baseline_value, d7.recent_value, d7.metric_name_cn) == (.2, .15, "M1 回收率")


def test_the_first_day_reaches_the_scans(spark, tmp_path):
    frames = {}
    for name, df in long_history(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    run = Detection(Warehouse(FrameSet(spark, frames), strict=True), only=["m1_recovery_rate", "ai_call_coverage"])
    assert run.wh.source.first == DAYS[0]
    plan = run.checks._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all(f"GreaterThanOrEqual(stat_date,{DAYS[0]})" in line for line in scans)
