"""Daily states and anomaly checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add
from duewise.functions.rates import relative_change, steady_round
from duewise.operators.windows import window_bounds
from duewise.oracle import findings_sql  # noqa: F401
from duewise.plans import anomaly as an
from duewise.plans import daily_state as ds
from duewise.plans.warehouse import SHARED_TABLES

VALUES = {"baseline_value": 6, "recent_value": 6, "absolute_change": 6, "relative_change": 6}


def checks(wh):
    return an.Detection(wh).checks.drop("explanation", "recommended_next_step")


def findings(wh):
    return an.Detection(wh).findings.drop("explanation", "recommended_next_step")


def one_check(code):
    return lambda wh: an.Detection(wh, only=[code]).checks.drop("explanation", "recommended_next_step")


def bounds(wh):
    due = wh["dwd_due_plan_detail_di"]
    b = window_bounds(due)
    return due.groupBy(b.period("stat_date").alias("period")).agg(
        F.count(F.lit(1)).alias("plan_count"), F.min("stat_date").alias("first_date"), F.max("stat_date").alias("last_date"),
    ).filter(F.col("period").isNotNull()).withColumn("recent_window", b.recent_label).withColumn("baseline_window", b.baseline_label)


BOUNDS_SQL = """
    SELECT CASE WHEN stat_date >= newest - 29 THEN 'recent' ELSE 'baseline' END AS period, count(*) AS plan_count,
           min(stat_date) AS first_date, max(stat_date) AS last_date,
           any_value(strftime(newest - 29, '%Y-%m-%d') || '~' || strftime(newest, '%Y-%m-%d')) AS recent_window,
           any_value(strftime(newest - 59, '%Y-%m-%d') || '~' || strftime(newest - 30, '%Y-%m-%d')) AS baseline_window
    FROM (SELECT *, max(stat_date) OVER () AS newest FROM dwd_due_plan_detail_di)
    WHERE stat_date >= newest - 59 GROUP BY 1"""


def change_rules(wh):
    """Relative change, spike, threshold and severity on every vendor-day against the vendor's mean."""
    daily = wh["ads_vendor_performance_di"].select("stat_date", "vendor_id", "connect_rate")
    mean = daily.groupBy("vendor_id").agg(steady_round(F.avg("connect_rate"), 6).alias("mean_rate"))
    rows = daily.join(mean, "vendor_id")
    b, r = F.col("mean_rate"), F.col("connect_rate")
    rel = relative_change(b, r)
    return rows.select(
        "stat_date", "vendor_id", F.round(rel, 6).alias("relative_change"),
        an.fires("drop", r - b, rel).alias("drops"), an.fires("any", r - b, rel).alias("moves"),
        an.is_spike(b, r).alias("spikes"), an.crosses(r, 0.35).alias("above"), an.crosses(r, 0.25, "below").alias("below"),
        an.severity_of(r - b, rel).alias("severity"),
    )


CHANGE_SQL = """
    SELECT stat_date, vendor_id, c AS relative_change, a < 0 AND (c <= -0.1 OR a <= -0.02) AS drops,
           abs(a) > 0 AND (abs(c) >= 0.1 OR abs(a) >= 0.02) AS moves, a > 0 AND (c >= 0.1 OR a >= 0.02) AS spikes,
           connect_rate > 0.35 AS above, connect_rate < 0.25 AS below,
           CASE WHEN abs(c) >= 0.25 OR abs(a) >= 0.06 THEN 'high' WHEN abs(c) >= 0.15 OR abs(a) >= 0.04 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT *, round(connect_rate - m, 6) + 0.0::DOUBLE AS a,
                 CASE WHEN m = 0 THEN 0.0 ELSE round((connect_rate - m) / abs(m), 6) + 0.0::DOUBLE END AS c
          FROM ads_vendor_performance_di
          JOIN (SELECT vendor_id, round(avg(connect_rate) + 1e-10, 6) AS m FROM ads_vendor_performance_di GROUP BY 1) USING (vendor_id))"""


def register() -> None:
    add("state_loan_changes", ds.loan_changes, "SELECT * FROM loan_change", cumulative_repaid=4)
    add("state_loan_daily", ds.loan_daily_state, "SELECT * FROM loan_daily_state", cumulative_repaid=4)
    add("state_case_daily", ds.case_daily_state, "SELECT * FROM case_daily_state")
    add("state_customer_daily", ds.customer_daily_state, "SELECT * FROM customer_daily_state")
    add("anomaly_window_bounds", bounds, BOUNDS_SQL)
    add("anomaly_change_rules", change_rules, CHANGE_SQL)
    add("anomaly_checks", checks, "SELECT * FROM anomaly_check", shared=SHARED_TABLES)
    add("anomaly_findings", findings, "SELECT * FROM anomaly_finding", shared=SHARED_TABLES)
    for check in an.CHECKS:
        add(f"anomaly_check_{check.metric_code}", one_check(check.metric_code),
            f"SELECT * FROM anomaly_check WHERE metric_code = '{check.metric_code}'")
    add("anomaly_check_template_complaints", lambda wh: an.template_complaint_check(wh).drop("explanation", "recommended_next_step"),
        "SELECT * FROM template_check")
    add("anomaly_ptp_trend_warning", an.ptp_trend_warning, """
        SELECT metric_code, fired, falling, NOT fired AND falling AS warned
        FROM anomaly_check, (SELECT count(*) = 4 AS falling
            FROM (SELECT ptp_keep_rate < lag(ptp_keep_rate) OVER (ORDER BY stat_date) AS down
                  FROM (SELECT * FROM ads_postloan_dashboard_di ORDER BY stat_date DESC LIMIT 5)) WHERE down)
        WHERE metric_code = 'ptp_keep_rate'""")
    add("anomaly_severity_counts", lambda wh: an.severity_counts(findings(wh)), """
        SELECT severity, count(anomaly_id) AS finding_count FROM (VALUES ('high'), ('medium'), ('low')) l(severity)
        LEFT JOIN anomaly_finding USING (severity) GROUP BY 1""", shared=SHARED_TABLES)
    add("anomaly_top", lambda wh: an.top_findings(findings(wh), 5), """
        SELECT * FROM anomaly_finding ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
               abs(relative_change) DESC, metric_code, dimension_value LIMIT 5""", shared=SHARED_TABLES)
    add("anomaly_target", lambda wh: an.find_target(findings(wh)), """
        SELECT * FROM anomaly_finding WHERE metric_code IN ('recovery_rate_d7', 'm1_recovery_rate')
        ORDER BY metric_code, dimension_value LIMIT 1""", shared=SHARED_TABLES)
