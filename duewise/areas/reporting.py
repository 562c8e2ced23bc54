"""Strategy, return on cost, report and chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add, analysis
from duewise.oracle import reports_sql as rs
from duewise.plans import charts as ch
from duewise.plans import reports as rp
from duewise.plans.strategy import roi, roi_summary
from duewise.plans.warehouse import SHARED_TABLES as SHARED


def lab(build):
    """A dataset that starts from findings and drivers."""
    return lambda wh: build(analysis(wh))


def measured_roi(one):
    cases = one.wh["dim_case"].agg(F.count(F.lit(1))).scalar()
    return roi(one.estimates, cases).select("scenario_id", "assumed_case_base", "gross_benefit", "action_cost")


def register() -> None:
    add("strategy_evidence", lab(lambda s: s.evidence.drop("note", "group_order", "row_order")),
        "SELECT * EXCLUDE (group_order, row_order) FROM scenario_evidence")
    add("strategy_results", lab(lambda s: s.estimates.drop("evidence_links", "impacted_segments", "scenario_name", "target_metric", "target_anomaly_id")),
        "SELECT * FROM strategy_result")
    add("strategy_priorities", lab(lambda s: s.priorities()), """
        SELECT scenario_id, estimated_direction, confidence FROM strategy_result
        WHERE estimated_direction IN ('improve', 'reduce_risk') AND confidence IN ('medium', 'high')""")
    add("strategy_type_counts", lab(lambda s: s.type_counts()),
        "SELECT strategy_type, count(*) AS scenario_count FROM strategy_result GROUP BY 1")
    keep = ["scenario_id", "strategy_type", "estimated_delta", "gross_benefit", "action_cost", "net_benefit", "roi_ratio", "payback_period_days"]
    add("roi_results", lab(lambda s: s.roi().select(*keep)), "SELECT * FROM roi_result")
    add("roi_measured_case_base", lab(measured_roi), """
        SELECT scenario_id, n AS assumed_case_base, round(g, 2) AS gross_benefit,
               round(CASE strategy_type WHEN 'contact_strategy' THEN n * 0.08::DOUBLE WHEN 'capacity_strategy' THEN n * 0.1::DOUBLE * 8
                     WHEN 'settlement_strategy' THEN g * 0.15::DOUBLE WHEN 'allocation_strategy' THEN 3000 ELSE 2000 END::DOUBLE, 2) AS action_cost
        FROM (SELECT *, estimated_delta * n * 500 AS g FROM strategy_result, (SELECT count(*) AS n FROM dim_case))""")
    add("roi_summary", lab(lambda s: roi_summary(s.roi()).drop("top_scenario_name")), """
        SELECT count(*) AS scenario_count, count(*) FILTER (roi_ratio > 0) AS positive_roi_count,
               (SELECT scenario_id FROM roi_result ORDER BY roi_ratio DESC NULLS LAST, scenario_id DESC LIMIT 1) AS top_scenario_id,
               (SELECT strategy_type FROM roi_result ORDER BY roi_ratio DESC NULLS LAST, scenario_id DESC LIMIT 1) AS top_strategy_type,
               max(roi_ratio) AS top_roi_ratio FROM roi_result""")
    # ---- reports
    add("report_overview", lab(rp.overview), f"""
        SELECT count(*) AS anomaly_count, arg_min(baseline_window, {rs.ORDER}) AS baseline_window, arg_min(recent_window, {rs.ORDER}) AS recent_window,
               count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count,
               count(*) FILTER (severity = 'low') AS low_count FROM anomaly_finding""")
    add("report_target", lab(lambda s: rp.target_summary(s).select("anomaly_id", "severity", "recent_value", "visible_in_high_priority")),
        "SELECT anomaly_id, severity, recent_value, severity = 'high' AS visible_in_high_priority FROM target_finding")
    add("report_process_evidence", lab(lambda s: s.process_evidence.drop("metric_name_cn", "method")), "SELECT * FROM process_item")
    wording = """CASE WHEN dimension_name IN ('vendor_id', 'vendor_name') THEN 'vendor' WHEN dimension_name IN ('line_id', 'line_name', 'region') THEN 'line'
               WHEN dimension_name IN ('risk_level', 'balance_segment', 'score_band') THEN 'customer' ELSE 'other' END"""
    add("report_recommendations", lab(lambda s: rp.recommendations(s).select("source", "source_id", "driver")), f"""
        SELECT source, source_id, driver FROM (
            SELECT 1 AS g, contribution_rank AS o, 'attribution' AS source, attribution_id AS source_id, dimension_name || '=' || dimension_value AS driver, {wording} AS text
            FROM attribution_result WHERE contribution_rank <= 5
            UNION ALL SELECT 2, {rs.ORDER}, 'anomaly', anomaly_id, metric_code || ':' || dimension_name || '=' || dimension_value, metric_code FROM anomaly_finding WHERE severity = 'high')
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY g, o, source_id) = 1""")
    add("report_next_steps", lab(lambda s: rp.next_steps(s).select("source", "source_id")), f"""
        SELECT source, source_id FROM (SELECT * FROM (
            SELECT 1 AS g, contribution_rank AS o, 'attribution' AS source, attribution_id AS source_id, {wording} AS text FROM attribution_result WHERE contribution_rank <= 5
            UNION ALL SELECT 2, {rs.ORDER}, 'anomaly', anomaly_id, metric_code FROM anomaly_finding WHERE severity = 'high')
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY g, o, source_id) = 1 ORDER BY g, o, source_id LIMIT 8)""")
    add("report_evidence_groups", lab(lambda s: rp.evidence_groups(s).groupBy("group_code").agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.avg("delta"), 6).alias("mean_delta"))),
        "SELECT group_code, count(*) AS entries, avg(delta) AS mean_delta FROM group_item GROUP BY 1", mean_delta=6)
    add("report_evidence_chains", lab(rp.evidence_chains), """
        SELECT chain_code, CASE WHEN coalesce(largest < 1e-9, true) THEN 'neutral' WHEN group_code = 'complaint' THEN CASE WHEN m > 0 THEN 'negative' ELSE 'positive' END
                    WHEN m < 0 THEN 'negative' ELSE 'positive' END AS tone,
               CASE WHEN largest >= 1e-9 THEN driver END AS highlight_driver, CASE WHEN largest >= 1e-9 THEN metric END AS highlight_metric,
               CASE WHEN largest >= 1e-9 THEN d END AS highlight_delta
        FROM (VALUES ('contact', 'ai_call'), ('fulfill', 'ptp_keep'), ('tool', 'reduction'), ('compliance', 'complaint')) c(chain_code, group_code)
        LEFT JOIN (SELECT group_code, avg(delta) AS m, max(abs(delta)) AS largest, first(driver ORDER BY abs(delta) DESC, contribution_rank, item_order) AS driver,
                          first(metric_code ORDER BY abs(delta) DESC, contribution_rank, item_order) AS metric,
                          first(delta ORDER BY abs(delta) DESC, contribution_rank, item_order) AS d FROM group_item GROUP BY 1) USING (group_code)
        UNION ALL SELECT 'capacity', coalesce(max(CASE WHEN relative_change > 0 THEN 'negative' ELSE 'positive' END), 'neutral'), max(dimension_name || '=' || dimension_value),
               max(metric_code), max(absolute_change)
        FROM (SELECT * FROM anomaly_finding WHERE severity = 'high' AND metric_code = 'avg_case_per_collector' ORDER BY dimension_value LIMIT 1)""")
    add("report_movements", lab(rp.movements), """
        SELECT group_code, CASE WHEN m < 0 THEN 'down' ELSE 'up' END AS direction FROM (SELECT group_code, avg(delta) AS m FROM group_item GROUP BY 1) WHERE abs(m) >= 1e-9
        UNION ALL SELECT 'capacity', 'up' FROM (SELECT 1 FROM anomaly_finding WHERE severity = 'high' AND metric_code = 'avg_case_per_collector' AND relative_change > 0 LIMIT 1)""")
    add("report_driver_progress", lab(rp.driver_progress), """
        SELECT attribution_id, contribution_rank, dimension_name, dimension_value, contribution_score, round(contribution_score / max(contribution_score) OVER () * 100, 4) AS progress_pct,
               CASE dimension_name WHEN 'channel_code' THEN '渠道结构' WHEN 'province' THEN '区域结构' WHEN 'score_band' THEN '客群风险结构' WHEN 'risk_level' THEN '客群风险结构'
                    WHEN 'balance_segment' THEN '余额结构' WHEN 'vendor_id' THEN '供应商' WHEN 'line_id' THEN '线路' ELSE '维度切片' END AS driver_role
        FROM attribution_result""")
    labels = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in rp.DRIVER_LABELS)
    add("report_driver_context", lab(rp.driver_context), f"""
        SELECT contribution_rank AS rank, r.dimension_name, r.dimension_value, baseline_value, recent_value, contribution_score, confidence,
               coalesce(label, r.dimension_name || '=' || r.dimension_value || '{rp.DEFAULT_MEANING}') AS meaning
        FROM attribution_result r LEFT JOIN (VALUES {labels}) l(dimension_name, dimension_value, label)
             ON l.dimension_name = r.dimension_name AND l.dimension_value = r.dimension_value WHERE contribution_rank <= 5""")
    add("report_process_rows", lab(rp.process_rows), f"""
        SELECT metric_code, driver, baseline_value, recent_value, delta FROM (
            SELECT 1 AS g, contribution_rank * 100 + item_order AS o, metric_code, driver, baseline_value, recent_value, delta FROM process_item
            WHERE metric_code IN ('ai_call_coverage', 'ptp_keep_rate', 'reduction_usage_rate', 'complaint_rate') AND abs(delta) >= 0.000001
            UNION ALL SELECT 2, {rs.ORDER}, metric_code, dimension_name || '=' || dimension_value, baseline_value, recent_value, absolute_change FROM anomaly_finding
            WHERE severity = 'high' AND metric_code IN ('ai_call_coverage', 'ptp_keep_rate', 'reduction_usage_rate', 'complaint_per_10k_cases', 'avg_case_per_collector'))
        QUALIFY row_number() OVER (PARTITION BY metric_code, driver, recent_value ORDER BY g, o) = 1""")
    add("report_finding_sheet", lab(rp.finding_sheet), """
        SELECT metric_code, metric_name_cn, dimension_value, recent_value, baseline_value, relative_change, severity FROM anomaly_finding WHERE severity = 'high'""")
    add("report_driver_sheet", lab(lambda s: rp.driver_sheet(s).drop("recommended_action")),
        "SELECT dimension_name, dimension_value, contribution_score FROM attribution_result WHERE contribution_rank <= 5")
    add("report_roi_sheet", lab(lambda s: rp.roi_sheet(s.roi())), """
        SELECT scenario_id, roi_ratio, action_cost, gross_benefit, round(payback_period_days / 30, 4) AS payback_months FROM roi_result""")
    add("report_roi_block", lab(lambda s: rp.roi_block(s.roi())), """
        SELECT scenario_id, strategy_type, estimated_delta, printf('%+.2f%%', estimated_delta * 100) AS estimated_delta_display, gross_benefit, action_cost, net_benefit,
               roi_ratio, payback_period_days, count(*) OVER () AS scenario_count, count(*) FILTER (roi_ratio > 0) OVER () AS positive_roi_count,
               (SELECT scenario_id FROM roi_result ORDER BY roi_ratio DESC NULLS LAST, scenario_id DESC LIMIT 1) AS top_scenario_id, max(roi_ratio) OVER () AS top_roi_ratio
        FROM roi_result""")
    add("report_case_sheet", rp.case_sheet, """
        SELECT s.case_id, dpd_bucket, outstanding_amount, balance_segment, region, s.vendor_id, s.line_id,
               CASE WHEN coalesce(p.action_count, 0) <= 0 THEN 'NO_ACTION' WHEN p.ai_action_count > 0 THEN 'AI_ACTION' ELSE 'MANUAL_ACTION' END AS last_action_type,
               CASE WHEN p.ptp_fulfilled_count > 0 THEN 'PTP_FULFILLED' WHEN p.ptp_count > 0 THEN 'PTP' WHEN p.connected_count > 0 THEN 'CONNECTED'
                    WHEN p.action_count > 0 THEN 'NOT_CONNECTED' ELSE 'NO_ACTION' END AS last_outcome
        FROM (SELECT * FROM dws_case_status_snapshot_di WHERE stat_date = (SELECT max(stat_date) FROM dws_case_status_snapshot_di)) s
        LEFT JOIN dim_case c ON c.case_id = s.case_id LEFT JOIN dim_collection_line l ON l.line_id = s.line_id
        LEFT JOIN (SELECT * FROM dws_collection_process_wide_di WHERE stat_date = (SELECT max(stat_date) FROM dws_collection_process_wide_di)
                   QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY collector_id) = 1) p ON p.case_id = s.case_id""", outstanding_amount=4)
    add("report_vendor_region_pivot", rp.vendor_region_pivot, """
        SELECT coalesce(vendor_id, '合计') AS vendor_id, coalesce(region, '合计') AS region, sum(r) AS recovery_rate
        FROM (SELECT DISTINCT vendor_id, region FROM dws_vendor_line_capacity_di WHERE stat_date = (SELECT max(stat_date) FROM dws_vendor_line_capacity_di))
        LEFT JOIN (SELECT vendor_id, avg(ptp_rate) * avg(ptp_keep_rate) AS r FROM ads_vendor_performance_di GROUP BY 1) USING (vendor_id)
        GROUP BY CUBE (vendor_id, region)""", recovery_rate=6)
    add("report_briefing", lab(lambda s: rp.briefing(s, s.roi(), s.estimates)), f"""
        SELECT o.*, coalesce((SELECT metric_code FROM target_finding), 'recovery_rate_d7') AS target_metric, (SELECT relative_change FROM target_finding) AS target_relative_change,
               (SELECT dimension_name FROM attribution_result WHERE contribution_rank = 1) AS primary_dimension, (SELECT dimension_value FROM attribution_result WHERE contribution_rank = 1) AS primary_value,
               top.scenario_id AS top_scenario_id, (SELECT estimated_delta FROM strategy_result r WHERE r.scenario_id = top.scenario_id) AS top_estimated_delta,
               top.roi_ratio AS top_roi_ratio, (SELECT count(*) FROM roi_result WHERE roi_ratio > 0) AS positive_roi_count
        FROM (SELECT count(*) AS anomaly_count, arg_min(baseline_window, {rs.ORDER}) AS baseline_window, arg_min(recent_window, {rs.ORDER}) AS recent_window,
                     count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity = 'low') AS low_count
              FROM anomaly_finding) o, (SELECT * FROM roi_result ORDER BY roi_ratio DESC NULLS LAST, scenario_id DESC LIMIT 1) top""")
    # ---- charts
    add("chart_collection_funnel", ch.collection_funnel, """
        SELECT CAST(i AS INTEGER) AS step_order, step, CASE i WHEN 1 THEN 1.0 WHEN 2 THEN a WHEN 3 THEN b WHEN 4 THEN c ELSE d END AS rate
        FROM (SELECT avg(touched / assigned::DOUBLE) AS a, avg(CASE WHEN actions <> 0 THEN connected / actions ELSE 0 END) AS b,
                     avg(CASE WHEN connected <> 0 THEN promised / connected ELSE 0 END) AS c, avg(CASE WHEN promised <> 0 THEN kept / promised ELSE 0 END) AS d
              FROM (SELECT stat_date, count(DISTINCT case_id) AS assigned, count(*) FILTER (action_count > 0) AS touched, sum(action_count)::DOUBLE AS actions,
                           sum(connected_count)::DOUBLE AS connected, sum(ptp_count)::DOUBLE AS promised, sum(ptp_fulfilled_count)::DOUBLE AS kept
                    FROM dws_collection_process_wide_di WHERE stat_date > (SELECT max(stat_date) FROM dws_collection_process_wide_di) - 30 GROUP BY 1)),
             (VALUES (1, '分案数'), (2, '首次触达覆盖率'), (3, '接通率'), (4, '有效沟通率'), (5, 'PTP履约率')) s(i, step)""", rate=6)
    add("chart_waterfall", lab(ch.waterfall), """
        SELECT contribution_rank, dimension_name || '=' || dimension_value AS label,
               CASE WHEN (SELECT recent_value - baseline_value FROM attribution_result WHERE contribution_rank = 1) < 0 THEN -abs(contribution_score) ELSE contribution_score END AS contribution
        FROM attribution_result WHERE contribution_rank <= 5""")
    add("chart_vendor_matrix", ch.vendor_matrix, """
        SELECT vendor_id, connect_rate AS x, complaint_rate AS y, round(18 + action_count / max(action_count) OVER ()::DOUBLE * 52, 6) AS marker_size
        FROM ads_vendor_performance_di WHERE stat_date = (SELECT max(stat_date) FROM ads_vendor_performance_di)""")
    add("chart_capacity_heatmap", ch.capacity_heatmap, """
        SELECT line_id, strftime(stat_date, '%Y-%m-%d') AS day, coalesce(avg(case_per_collector), 0.0) AS case_per_collector
        FROM (SELECT * FROM (SELECT DISTINCT line_id FROM dws_vendor_line_capacity_di WHERE stat_date > (SELECT max(stat_date) FROM dws_vendor_line_capacity_di) - 30),
             (SELECT DISTINCT stat_date FROM dws_vendor_line_capacity_di WHERE stat_date > (SELECT max(stat_date) FROM dws_vendor_line_capacity_di) - 30)) g
        LEFT JOIN dws_vendor_line_capacity_di USING (line_id, stat_date) GROUP BY 1, 2""", case_per_collector=4)
    days = ", ".join(f"coalesce(avg(case_per_collector) FILTER (newest - stat_date = {i}), 0.0) AS d{i}" for i in range(7))
    add("chart_capacity_heatmap_wide", ch.heatmap_pivot, f"""
        SELECT line_id, {days} FROM (SELECT *, max(stat_date) OVER () AS newest FROM dws_vendor_line_capacity_di) WHERE stat_date > newest - 7 GROUP BY 1""",
        **{f"d{i}": 4 for i in range(7)})
    add("chart_dpd_structure", ch.dpd_structure, """
        SELECT dpd_bucket, CAST(CASE dpd_bucket WHEN 'CURRENT' THEN 1 WHEN 'M1' THEN 3 ELSE CASE WHEN dpd_bucket = 'M2' THEN 4 ELSE 9 END END AS INTEGER) AS bucket_order,
               c AS current_count, b AS baseline_count, CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER ()::DOUBLE ELSE 0 END AS current_share,
               CASE WHEN sum(b) OVER () > 0 THEN b / sum(b) OVER ()::DOUBLE ELSE 0 END AS baseline_share
        FROM (SELECT dpd_bucket, count(*) FILTER (stat_date = newest) AS c, count(*) FILTER (stat_date = earlier) AS b
              FROM dws_loan_status_snapshot_di, (SELECT max(stat_date) AS newest, coalesce(max(stat_date) FILTER (stat_date <= (SELECT max(stat_date) FROM dws_loan_status_snapshot_di) - 30), min(stat_date)) AS earlier
                                                 FROM dws_loan_status_snapshot_di)
              WHERE stat_date IN (newest, earlier) GROUP BY 1)""", current_share=6, baseline_share=6)
    add("chart_reduction_series", ch.reduction_series, """
        SELECT strftime(stat_date, '%Y-%m-%d') AS day, approved_reduction_amount, reduction_roi FROM ads_reduction_roi_di""", shared=SHARED, approved_reduction_amount=4)
    add("chart_complaint_risk", lambda wh: ch.complaint_risk(wh["ads_vendor_performance_di"], "vendor_id"), """
        SELECT vendor_id, round(r, 6) AS risk_score, r >= (SELECT median(complaint_rate) FROM ads_vendor_performance_di WHERE stat_date = (SELECT max(stat_date) FROM ads_vendor_performance_di)) AND r > 0 AS flagged
        FROM (SELECT vendor_id, avg(complaint_rate) AS r FROM ads_vendor_performance_di WHERE stat_date = (SELECT max(stat_date) FROM ads_vendor_performance_di) GROUP BY 1)""")
    add("chart_finding_strength", lab(ch.finding_strength),
        "SELECT metric_name_cn AS label, dimension_value, relative_change, severity FROM anomaly_finding WHERE severity = 'high'")
    add("chart_top_contributions", lab(ch.top_contributions), """
        SELECT contribution_rank, dimension_name || '=' || dimension_value AS label, contribution_score FROM attribution_result WHERE contribution_rank <= 5""")
    add("chart_roi_comparison", lab(lambda s: ch.roi_comparison(s.roi())), """
        SELECT scenario_id, action_cost AS cost, gross_benefit AS benefit, roi_ratio FROM roi_result WHERE roi_ratio IS NOT NULL""")
