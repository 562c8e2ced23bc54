"""The query tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add, analysis
from duewise.oracle import reports_sql  # noqa: F401
from duewise.oracle.sql import CTES
from duewise.oracle.warehouse_sql import ratio
from duewise.plans import tools
from duewise.plans.warehouse import SHARED_TABLES

CTES.update({
    "segment_fact": """
        SELECT l.stat_date, l.loan_id, due_amount, repaid_amount_d7, coalesce(channel_code, 'UNKNOWN') AS channel_code,
               coalesce(province, 'UNKNOWN') AS province, coalesce(risk_level_current, 'UNKNOWN') AS risk_level,
               coalesce(l.product_code, 'UNKNOWN') AS product_code, coalesce(score_level, 'UNKNOWN') AS score_band
        FROM (SELECT * FROM dws_loan_status_snapshot_di WHERE dpd_bucket = 'M1') l LEFT JOIN dim_loan n ON n.loan_id = l.loan_id
        LEFT JOIN dim_customer u ON u.customer_id = l.customer_id
        LEFT JOIN (SELECT customer_id, score_level FROM ods_postloan_c_score
                   QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY score_date DESC, score_id DESC) = 1) s ON s.customer_id = l.customer_id""",
    "process_fact": """
        SELECT w.*, coalesce(channel_code, 'UNKNOWN') AS channel_code, coalesce(product_code, 'UNKNOWN') AS product_code,
               coalesce(province, 'UNKNOWN') AS province, coalesce(risk_level_current, 'UNKNOWN') AS risk_level
        FROM dws_collection_process_wide_di w LEFT JOIN dim_case c ON c.case_id = w.case_id
        LEFT JOIN (SELECT case_id, min(loan_id) AS loan_id FROM dim_case_loan_mapping GROUP BY 1) m ON m.case_id = w.case_id
        LEFT JOIN dim_loan n ON n.loan_id = m.loan_id LEFT JOIN dim_customer u ON u.customer_id = c.customer_id""",
})


def segment_sql(column: str, where: str = "") -> str:
    return f"""SELECT stat_date, {column}, {ratio('sum(repaid_amount_d7)', 'sum(due_amount)', 6)} AS recovery_rate_d7, sum(due_amount) AS due_amount,
        sum(repaid_amount_d7) AS repaid_amount_d7, count(DISTINCT loan_id) AS loan_count FROM segment_fact {where} GROUP BY 1, 2"""


def breakdown_sql(column: str) -> str:
    return f"""
        SELECT '{column}' AS segment_col, v AS segment_val, 'recovery_rate_d7' AS metric, round(avg(r) + 1e-10, 6) AS avg_value,
               CASE WHEN count(*) < 2 OR arg_max(r, stat_date) = arg_min(r, stat_date) THEN 'flat' WHEN arg_max(r, stat_date) > arg_min(r, stat_date) THEN 'up' ELSE 'down' END AS trend,
               round(arg_min(r, stat_date), 6) AS first_value, round(arg_max(r, stat_date), 6) AS last_value, count(DISTINCT stat_date) AS day_count
        FROM (SELECT stat_date, {column} AS v, {ratio('sum(repaid_amount_d7)', 'sum(due_amount)', 6)} AS r FROM segment_fact
              WHERE stat_date > (SELECT max(stat_date) FROM segment_fact) - 30 GROUP BY 1, 2) GROUP BY v"""


def all_case_snapshots(wh):
    rows = tools.nest_recent(wh["dim_case"], wh["dws_case_status_snapshot_di"])
    return rows.select("case_id", "balance_segment", F.explode("recent_30d_snapshots").alias("s")).select(
        "case_id", "balance_segment", "s.stat_date", "s.collector_id", F.round("s.outstanding_amount", 4).alias("outstanding_amount"), "s.action_count"
    )


def plain_findings(wh):
    return analysis(wh).findings.drop("explanation", "recommended_next_step")


def overview(wh):
    return tools.data_overview(wh, ["dwd_due_plan_detail_di", "dwd_repayment_detail_di", "dwd_collection_action_detail_di",
                                    "dws_customer_status_snapshot_di", "dws_collection_process_wide_di", "dim_vendor"]).frame


def register() -> None:
    add("tool_recovery_rate", lambda wh: tools.recovery_rate(wh).frame, "SELECT stat_date, recovery_rate_d7 FROM ads_postloan_dashboard_di", shared=SHARED_TABLES)
    add("tool_recovery_rate_by_channel", lambda wh: tools.recovery_rate(wh, "channel_code").frame, segment_sql("channel_code"),
        due_amount=4, repaid_amount_d7=4)
    add("tool_recovery_rate_dates", lambda wh: tools.recovery_rate(wh, "score_band", "D", "2000-01-01", "2001-06-30").frame,
        segment_sql("score_band", "WHERE score_band = 'D' AND stat_date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'"), due_amount=4, repaid_amount_d7=4)
    add("tool_recovery_rate_unsupported", lambda wh: tools.recovery_rate(wh, "customer_name").frame.unionByName(
        tools.recovery_rate(wh, "province", "none of these").frame.select("stat_date", "recovery_rate_d7")),
        "SELECT stat_date, 0.0::DOUBLE AS recovery_rate_d7 FROM segment_fact WHERE province = 'none of these'")
    add("tool_anomalies_high", lambda wh: tools.anomalies(wh, "high", findings=plain_findings(wh)).frame,
        "SELECT * FROM anomaly_finding WHERE severity = 'high'")
    add("tool_anomalies_metric", lambda wh: tools.anomalies(wh, metric_code="connect_rate", findings=plain_findings(wh)).frame,
        "SELECT * FROM anomaly_finding WHERE metric_code = 'connect_rate'")
    add("tool_top_drivers", lambda wh: tools.top_drivers(wh, 5, analysis(wh).drivers).frame.select(
        "attribution_id", "dimension_name", "dimension_value", "contribution_score", "contribution_rank"), """
        SELECT attribution_id, dimension_name, dimension_value, contribution_score, contribution_rank FROM attribution_result
        WHERE contribution_rank <= 5""")
    add("tool_roi_scenario", lambda wh: tools.roi_scenarios(wh, "vendor_reallocation", analysis(wh).roi()).frame.select("scenario_id", "gross_benefit", "roi_ratio"),
        "SELECT scenario_id, gross_benefit, roi_ratio FROM roi_result WHERE scenario_id = 'vendor_reallocation'")
    means = ", ".join(f"avg({c}) AS {c}" for c in ("connect_rate", "ptp_rate", "ptp_keep_rate", "call_coverage_rate", "complaint_rate"))
    digits = {c: 6 for c in ("connect_rate", "ptp_rate", "ptp_keep_rate", "call_coverage_rate", "complaint_rate", "recovery_contribution")}
    add("tool_vendor_performance", lambda wh: tools.vendor_performance(wh).frame, f"""
        SELECT *, action_count * ptp_rate * ptp_keep_rate AS recovery_contribution
        FROM (SELECT vendor_id, CAST(sum(action_count) AS BIGINT) AS action_count, {means} FROM ads_vendor_performance_di GROUP BY 1)""", **digits)
    add("tool_collector_performance", lambda wh: tools.collector_performance(wh).frame, """
        SELECT *, least(greatest(1 - complaint_count / action_count, 0.0), 1.0) AS compliance_score
        FROM (SELECT vendor_id, collector_id, avg(action_count) AS daily_case_count, CAST(sum(action_count) AS BIGINT) AS action_count,
                     avg(connect_rate) AS connect_rate, avg(ptp_keep_rate) AS ptp_rate, avg(ptp_keep_rate) AS ptp_keep_rate,
                     CAST(sum(complaint_count) AS BIGINT) AS complaint_count FROM ads_collector_performance_di GROUP BY 1, 2)""",
        daily_case_count=6, connect_rate=6, ptp_rate=6, ptp_keep_rate=6, compliance_score=6)
    for column in ("province", "risk_level", "product_code"):
        add(f"tool_segment_breakdown_{column}", lambda wh, column=column: tools.segment_breakdown(wh, column).frame, breakdown_sql(column))
    add("tool_case_detail_snapshots", all_case_snapshots, """
        SELECT case_id, balance_segment, stat_date, s.collector_id, round(outstanding_amount, 4) AS outstanding_amount, action_count
        FROM dws_case_status_snapshot_di s JOIN dim_case USING (case_id)
        WHERE stat_date > (SELECT max(stat_date) FROM dws_case_status_snapshot_di) - 30""")
    add("tool_collection_process", lambda wh: tools.collection_process(wh).frame.drop("segment_col", "segment_val"), f"""
        SELECT CAST(sum(action_count) AS BIGINT) AS action_count, CAST(sum(connected_count) AS BIGINT) AS connected_count,
               {ratio('sum(connected_count)', 'sum(action_count)', 6)} AS connect_rate, CAST(sum(ptp_count) AS BIGINT) AS ptp_count,
               {ratio('sum(ptp_count)', 'sum(connected_count)', 6)} AS ptp_rate, {ratio('sum(ai_action_count)', 'sum(action_count)', 6)} AS ai_coverage_rate,
               (SELECT round(avg(CAST((SELECT max(stat_date) FROM process_fact) - d AS DOUBLE)), 6) FROM (SELECT case_id, max(stat_date) AS d FROM process_fact
                WHERE stat_date > (SELECT max(stat_date) FROM process_fact) - 30 GROUP BY 1)) AS days_since_last_action, count(DISTINCT case_id) AS case_count
        FROM process_fact WHERE stat_date > (SELECT max(stat_date) FROM process_fact) - 30""")
    add("tool_collection_process_segment", lambda wh: tools.collection_process(wh, "risk_level", "low").frame.select("segment_val", "action_count", "case_count", "ptp_count"), """
        SELECT 'low' AS segment_val, CAST(sum(action_count) AS BIGINT) AS action_count, count(DISTINCT case_id) AS case_count, CAST(sum(ptp_count) AS BIGINT) AS ptp_count
        FROM process_fact WHERE risk_level = 'low' AND stat_date > (SELECT max(stat_date) FROM process_fact) - 30""")

    def counted(table: str, columns: str, date: str | None) -> str:
        bounds = f"min({date}), max({date})" if date else "NULL, NULL"
        return f"SELECT '{table}', count(*), '{columns}', {repr(date) if date else 'NULL'}, {bounds} FROM {table}"

    parts = [
        counted("dwd_due_plan_detail_di", "stat_date, plan_id, loan_id, customer_id, product_code, channel_code, due_date, due_amount, outstanding_amount, dpd_bucket", "stat_date"),
        counted("dwd_repayment_detail_di", "repay_id, plan_id, loan_id, repay_time, repay_date, repay_amount, repay_status", "repay_date"),
        counted("dwd_collection_action_detail_di", "action_id, case_id, customer_id, vendor_id, line_id, collector_id, action_time, action_date, action_type, template_id, connected_flag, ptp_flag, ptp_fulfilled_flag, ai_outbound_flag", "action_date"),
        counted("dws_customer_status_snapshot_di", "stat_date, customer_id, active_loan_count, active_case_count, total_outstanding_amount, max_dpd, risk_level", "stat_date"),
        counted("dws_collection_process_wide_di", "stat_date, case_id, vendor_id, line_id, collector_id, action_count, ai_action_count, connected_count, ptp_count, ptp_fulfilled_count, complaint_count, connect_rate, ptp_fulfillment_rate, ai_coverage_rate", "stat_date"),
        counted("dim_vendor", "vendor_id, vendor_name", None),
    ]
    add("tool_data_overview", overview, f"""SELECT * FROM ({' UNION ALL '.join(parts)}) o(table_name, row_count, columns, date_column, date_start, date_end)""")
