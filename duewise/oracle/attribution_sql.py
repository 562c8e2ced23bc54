"""SQL text of the recovery fact and of attribution."""

from __future__ import annotations

from duewise.oracle.sql import CTES

DIMENSIONS = [
    "vendor_id", "vendor_name", "line_id", "line_name", "collector_id", "product_code", "channel_code", "province",
    "region", "balance_segment", "risk_level", "score_band",
]
PARTS = ["connect_rate:connected:actions", "ai_call_coverage:ai:actions", "manual_call_coverage:manual:actions",
         "ptp_keep_rate:kept:promised", "reduction_usage_rate:reduced:loans", "complaint_rate:complained:loans"]


def _safe(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num}::DOUBLE / {den}::DOUBLE ELSE 0.0 END"


def _linkage() -> str:
    rows = []
    for i, part in enumerate(PARTS):
        code, num, den = part.split(":")
        b, r = _safe(f"b_{num}", f"b_{den}"), _safe(f"r_{num}", f"r_{den}")
        rows.append(
            f"SELECT contribution_rank, dimension_name, dimension_value, '{code}' AS metric_code, round({b}, 6) AS baseline_value,"
            f" round({r}, 6) AS recent_value, round({r} - {b}, 6) + 0.0::DOUBLE AS delta FROM driver"
            " WHERE in_b AND in_r"
        )
    return " UNION ALL ".join(rows)


CTES.update({
    "recovery_fact": f"""
        SELECT stat_date, loan_id, customer_id, case_id, due_amount, repaid_amount_d7,
               {', '.join(f"coalesce(CAST({d} AS VARCHAR), 'UNKNOWN') AS {d}" for d in DIMENSIONS)}, dpd_bucket,
               action_count, ai_action_count, action_count - ai_action_count AS manual_action_count, connected_count, ptp_count,
               ptp_fulfilled_count, process_complaint_count, reduction_used, complaint_flag,
               CASE WHEN action_count = 0 THEN 'NO_ACTION' WHEN ai_action_count = 0 THEN 'NO_AI'
                    WHEN ai_action_count::DOUBLE / action_count >= 0.5 THEN 'AI_HIGH' ELSE 'AI_LOW' END AS ai_call_coverage,
               CASE WHEN action_count = 0 THEN 'NO_ACTION' WHEN action_count = ai_action_count THEN 'NO_MANUAL'
                    WHEN (action_count - ai_action_count)::DOUBLE / action_count >= 0.5 THEN 'MANUAL_HIGH' ELSE 'MANUAL_LOW' END AS manual_call_coverage,
               CASE WHEN reduction_used THEN 'REDUCTION_USED' ELSE 'NO_REDUCTION' END AS reduction_usage_rate,
               CASE WHEN ptp_count = 0 THEN 'NO_PTP' WHEN ptp_fulfilled_count > 0 THEN 'PTP_KEPT' ELSE 'PTP_NOT_KEPT' END AS ptp_keep_rate,
               CASE WHEN complaint_flag THEN 'COMPLAINT' ELSE 'NO_COMPLAINT' END AS complaint_rate
        FROM (SELECT l.stat_date, l.loan_id, l.customer_id, m.case_id, l.due_amount, repaid_amount_d7, l.product_code, l.dpd_bucket,
                     channel_code, province, coalesce(c.current_vendor_id, s.vendor_id) AS vendor_id,
                     coalesce(c.current_line_id, s.line_id) AS line_id, coalesce(c.collector_id, s.collector_id) AS collector_id,
                     coalesce(c.balance_segment, CASE WHEN coalesce(d.total_outstanding_amount, 0) >= 35000 THEN 'HIGH' ELSE 'NORMAL' END) AS balance_segment,
                     coalesce(d.risk_level, u.risk_level_current) AS risk_level, vendor_name, line_name, region, score_level AS score_band,
                     coalesce(p.action_count, 0) AS action_count, coalesce(p.ai_action_count, 0) AS ai_action_count,
                     coalesce(p.connected_count, 0) AS connected_count, coalesce(p.ptp_count, 0) AS ptp_count,
                     coalesce(p.ptp_fulfilled_count, 0) AS ptp_fulfilled_count, coalesce(p.process_complaint_count, 0) AS process_complaint_count,
                     (l.stat_date, m.case_id) IN (SELECT CAST(apply_time AS DATE), case_id FROM ods_reduction_application) AS reduction_used,
                     (l.stat_date, m.case_id) IN (SELECT complaint_date, case_id FROM dwd_complaint_detail_di) AS complaint_flag
              FROM (SELECT * FROM dws_loan_status_snapshot_di WHERE dpd_bucket = 'M1') l
              LEFT JOIN dim_case_loan_mapping m ON m.loan_id = l.loan_id LEFT JOIN dim_case c ON c.case_id = m.case_id
              LEFT JOIN ods_case_daily_snapshot s ON s.stat_date = l.stat_date AND s.case_id = m.case_id
              LEFT JOIN dim_loan n ON n.loan_id = l.loan_id
              LEFT JOIN ods_customer_daily_snapshot d ON d.stat_date = l.stat_date AND d.customer_id = l.customer_id
              LEFT JOIN dim_customer u ON u.customer_id = l.customer_id
              LEFT JOIN dim_vendor v ON v.vendor_id = coalesce(c.current_vendor_id, s.vendor_id)
              LEFT JOIN dim_collection_line i ON i.line_id = coalesce(c.current_line_id, s.line_id)
              LEFT JOIN (SELECT customer_id, score_level FROM ods_postloan_c_score
                         QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY score_date DESC, score_id DESC) = 1) o
                     ON o.customer_id = l.customer_id
              LEFT JOIN (SELECT stat_date, case_id, CAST(sum(action_count) AS BIGINT) AS action_count, CAST(sum(ai_action_count) AS BIGINT) AS ai_action_count,
                                CAST(sum(connected_count) AS BIGINT) AS connected_count, CAST(sum(ptp_count) AS BIGINT) AS ptp_count,
                                CAST(sum(ptp_fulfilled_count) AS BIGINT) AS ptp_fulfilled_count,
                                CAST(sum(complaint_count) AS BIGINT) AS process_complaint_count
                         FROM dws_collection_process_wide_di GROUP BY 1, 2) p ON p.stat_date = l.stat_date AND p.case_id = m.case_id)""",
    "fact_period": """
        SELECT *, CASE WHEN stat_date >= newest - 29 THEN 'recent' WHEN stat_date >= newest - 59 THEN 'baseline' ELSE 'outside' END AS period
        FROM (SELECT *, max(stat_date) OVER () AS newest FROM recovery_fact)""",
    "overall_rate": f"""
        SELECT {_safe("sum(repaid_amount_d7) FILTER (period = 'baseline')", "sum(due_amount) FILTER (period = 'baseline')")} AS baseline_total,
               {_safe("sum(repaid_amount_d7) FILTER (period = 'recent')", "sum(due_amount) FILTER (period = 'recent')")} AS recent_total
        FROM fact_period""",
    "fact_long": " UNION ALL ".join(
        f"SELECT '{d}' AS dimension_name, {i} AS dimension_index, {d} AS dimension_value, * FROM fact_period WHERE {d} <> 'UNKNOWN'"
        for i, d in enumerate(DIMENSIONS, start=1)
    ),
    "segment": f"""
        SELECT *, {_safe('r_num', 'r_den')} - {_safe('b_num', 'b_den')} AS delta, {_safe('b_num', 'b_den')} AS b_value, {_safe('r_num', 'r_den')} AS r_value
        FROM (SELECT dimension_name, any_value(dimension_index) AS dimension_index, dimension_value,
                     bool_or(period = 'baseline') AS in_b, bool_or(period = 'recent') AS in_r, {', '.join(
        f"coalesce(sum({e}) FILTER (period = '{p}'), 0) AS {p[0]}_{n}"
        for p in ('baseline', 'recent') for n, e in [('num', 'repaid_amount_d7'), ('den', 'due_amount'), ('actions', 'action_count'),
        ('ai', 'ai_action_count'), ('manual', 'manual_action_count'), ('connected', 'connected_count'), ('promised', 'ptp_count'),
        ('kept', 'ptp_fulfilled_count'), ('reduced', 'CAST(reduction_used AS INTEGER)'), ('complained', 'CAST(complaint_flag AS INTEGER)')])},
                     count(DISTINCT loan_id) FILTER (period = 'baseline') AS b_loans, count(DISTINCT loan_id) FILTER (period = 'recent') AS r_loans
              FROM fact_long GROUP BY dimension_name, dimension_value)
        WHERE (in_b OR in_r) AND dimension_name IN (SELECT dimension_name FROM fact_long GROUP BY 1 HAVING count(DISTINCT dimension_value) >= 2)""",
    "scored": """
        SELECT *, adverse / sum(adverse) OVER () AS score
        FROM (SELECT *, greatest(CASE WHEN (SELECT recent_total - baseline_total FROM overall_rate) < 0 THEN -1 ELSE 1 END * delta * weight, 0) AS adverse
              FROM (SELECT *, r_den / nullif(sum(r_den) OVER (PARTITION BY dimension_name), 0) AS weight FROM segment))
        WHERE weight >= 0.005 AND adverse > 0""",
    "driver": """
        SELECT *, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, round(r_den, 4) DESC, dimension_index, dimension_value) AS INTEGER) AS contribution_rank
        FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY dimension_name
              ORDER BY round(score, 9) DESC, round(r_den, 4) DESC, dimension_value) <= 2)
        QUALIFY contribution_rank <= 10""",
    "linkage": _linkage(),
    "driver_confidence": """
        SELECT contribution_rank, bool_or(delta < 0 OR (metric_code = 'complaint_rate' AND delta > 0)) AS moved FROM linkage GROUP BY 1""",
    "attribution_result": """
        SELECT 'M3B-recovery_rate_d7-' || lpad(CAST(contribution_rank AS VARCHAR), 2, '0') AS attribution_id,
               coalesce((SELECT anomaly_id FROM anomaly_finding WHERE metric_code IN ('recovery_rate_d7', 'm1_recovery_rate')
                         ORDER BY metric_code, dimension_value LIMIT 1), 'M3B-recovery_rate_d7-inferred') AS target_anomaly_id,
               dimension_name, dimension_value, round(b_value, 6) AS baseline_value, round(r_value, 6) AS recent_value,
               round(score, 6) AS contribution_score, contribution_rank,
               CASE WHEN dimension_name IN ('vendor_id', 'vendor_name', 'line_id', 'line_name', 'region') AND coalesce(moved, false)
                    THEN 'high' ELSE 'medium' END AS confidence
        FROM driver LEFT JOIN driver_confidence USING (contribution_rank)""",
})
