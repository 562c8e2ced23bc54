"""SQL text of the daily states and of the anomaly checks."""

from __future__ import annotations

from duewise.oracle.sql import CTES

BUCKET = "CASE WHEN {0} <= 0 THEN 'CURRENT' WHEN {0} <= 30 THEN 'M1' WHEN {0} <= 60 THEN 'M2' ELSE 'M3+' END"

CTES.update({
    "loan_daily_state": f"""
        SELECT stat_date, loan_id, customer_id, dpd, {BUCKET.format('dpd')} AS dpd_bucket, outstanding_amount,
               CASE WHEN outstanding_amount <= 0 THEN 'closed' WHEN dpd = 0 THEN 'current' WHEN dpd <= 30 THEN 'overdue'
                    ELSE 'in_collection' END AS loan_status, cumulative_repaid
        FROM (SELECT *, CASE WHEN outstanding_amount <= 0 THEN 0 ELSE CAST(stat_date - due_date AS INTEGER) END AS dpd
              FROM (SELECT s.stat_date, s.loan_id, any_value(s.customer_id) AS customer_id, any_value(due_date) AS due_date,
                           coalesce(sum(repay_amount), 0.0) AS cumulative_repaid,
                           round(greatest(any_value(due_amount) - coalesce(sum(repay_amount), 0.0), 0.0), 2) AS outstanding_amount
                    FROM (SELECT p.*, d.stat_date FROM ods_repayment_plan p JOIN (SELECT DISTINCT stat_date FROM ods_case_daily_snapshot) d ON p.due_date <= d.stat_date) s
                    LEFT JOIN dwd_repayment_detail_di r ON r.loan_id = s.loan_id AND r.repay_date <= s.stat_date
                          AND r.repay_status = 'SUCCESS'
                    GROUP BY s.stat_date, s.loan_id))""",
    "loan_change": """
        SELECT loan_id, customer_id, due_date, greatest(day, due_date) AS valid_from, valid_to, cumulative_repaid,
               round(greatest(due_amount - cumulative_repaid, 0.0), 2) AS outstanding_amount
        FROM (SELECT loan_id, p.customer_id, p.due_date, p.due_amount, day, lead(day) OVER w AS valid_to, sum(paid) OVER w AS cumulative_repaid
              FROM (SELECT loan_id, day, sum(paid) AS paid
                    FROM (SELECT loan_id, repay_date AS day, repay_amount AS paid FROM dwd_repayment_detail_di WHERE repay_status = 'SUCCESS'
                          UNION ALL SELECT loan_id, due_date, 0.0 FROM ods_repayment_plan) GROUP BY 1, 2)
              JOIN ods_repayment_plan p USING (loan_id) WINDOW w AS (PARTITION BY loan_id ORDER BY day))
        WHERE valid_to IS NULL OR valid_to > due_date""",
    "active_case_loan": """
        SELECT l.stat_date, l.loan_id, dpd, outstanding_amount, cumulative_repaid, c.*, CAST(case_create_time AS DATE) AS case_create_date
        FROM loan_daily_state l JOIN dim_case_loan_mapping m ON l.loan_id = m.loan_id JOIN dim_case c ON c.case_id = m.case_id
        WHERE CAST(case_create_time AS DATE) <= l.stat_date""",
    "case_daily_state": f"""
        SELECT stat_date, case_id, customer_id, current_vendor_id AS vendor_id, current_line_id AS line_id, collector_id,
               CASE WHEN outstanding_amount <= 0 AND stat_date - case_create_date > 30 THEN 'closed'
                    WHEN outstanding_amount <= 0 THEN 'cured' WHEN repaid > 0 THEN 'partially_paid'
                    WHEN case_dpd > 0 THEN 'in_collection' ELSE 'assigned' END AS case_status,
               {BUCKET.format('case_dpd')} AS dpd_bucket, outstanding_amount, case_dpd
        FROM (SELECT stat_date, case_id, customer_id, current_vendor_id, current_line_id, collector_id, case_create_date,
                     round(sum(outstanding_amount), 2) AS outstanding_amount, sum(cumulative_repaid) AS repaid,
                     CASE WHEN round(sum(outstanding_amount), 2) <= 0 THEN 0 ELSE max(dpd) END AS case_dpd
              FROM active_case_loan GROUP BY ALL)""",
    "customer_daily_state": """
        SELECT *, CASE WHEN total_outstanding_amount <= 0 OR max_dpd <= 30 THEN 'low' ELSE 'medium' END AS risk_level
        FROM (SELECT c.stat_date, c.customer_id, coalesce(n, 0) AS active_loan_count, active_case_count, total_outstanding_amount,
                     CASE WHEN total_outstanding_amount <= 0 THEN 0 ELSE d END AS max_dpd
              FROM (SELECT stat_date, customer_id, count(*) FILTER (outstanding_amount > 0) AS active_case_count,
                           round(sum(outstanding_amount), 2) AS total_outstanding_amount, max(case_dpd) AS d
                    FROM case_daily_state GROUP BY ALL) c
              LEFT JOIN (SELECT stat_date, customer_id, count(DISTINCT loan_id) AS n FROM active_case_loan
                         WHERE outstanding_amount > 0 GROUP BY ALL) l
                     ON l.stat_date = c.stat_date AND l.customer_id = c.customer_id)""",
    "check_series": """
        SELECT 'm1_recovery_rate' AS metric_code, 'ALL' AS dimension_value, stat_date, m1_recovery_rate::DOUBLE AS value FROM ads_postloan_dashboard_di
        UNION ALL SELECT 'connect_rate', vendor_id, stat_date, connect_rate FROM ads_vendor_performance_di
        UNION ALL SELECT 'avg_case_per_collector', region, stat_date, sum(active_case_count)::DOUBLE / sum(active_collector_count)::DOUBLE
                  FROM dws_vendor_line_capacity_di GROUP BY ALL
        UNION ALL SELECT 'high_balance_high_risk_share', 'ALL', stat_date,
                  (count(*) FILTER (risk_level = 'high' AND total_outstanding_amount >= 2 * (SELECT median(total_outstanding_amount) FROM dws_customer_status_snapshot_di)))::DOUBLE
                  / count(DISTINCT customer_id)::DOUBLE FROM dws_customer_status_snapshot_di GROUP BY stat_date
        UNION ALL SELECT 'ai_call_coverage', 'AI_OUTBOUND', stat_date, sum(ai_action_count)::DOUBLE / sum(action_count)::DOUBLE
                  FROM dws_collection_process_wide_di GROUP BY stat_date
        UNION ALL SELECT 'reduction_usage_rate', 'ALL', stat_date, reduction_usage_rate FROM ads_reduction_roi_di
        UNION ALL SELECT 'ptp_keep_rate', 'ALL', stat_date, ptp_keep_rate FROM ads_postloan_dashboard_di""",
    "check_spec": """
        SELECT * FROM (VALUES
          ('m1_recovery_rate', 'M1 回收率', 'drop', 'window_compare', 'overall', 'ads_postloan_dashboard_di'),
          ('connect_rate', '接通率', 'drop', 'window_compare', 'vendor_id', 'ads_vendor_performance_di'),
          ('avg_case_per_collector', '线路人均案量', 'increase', 'spike', 'region', 'dws_vendor_line_capacity_di'),
          ('high_balance_high_risk_share', '高余额高风险客群占比', 'share', 'window_compare', 'overall', 'dws_customer_status_snapshot_di'),
          ('ai_call_coverage', 'AI 外呼覆盖率', 'drop', 'window_compare', 'action_type', 'dws_collection_process_wide_di'),
          ('reduction_usage_rate', '减免使用率', 'drop', 'window_compare', 'overall', 'ads_reduction_roi_di'),
          ('ptp_keep_rate', 'PTP 履约率', 'drop', 'window_compare', 'overall', 'ads_postloan_dashboard_di'))
          s(metric_code, metric_name_cn, direction, anomaly_type, dimension_name, evidence_table)""",
    "check_means": """
        SELECT metric_code, dimension_value, newest,
               avg(value) FILTER (stat_date BETWEEN newest - 59 AND newest - 30) AS b,
               avg(value) FILTER (stat_date BETWEEN newest - 29 AND newest) AS r
        FROM (SELECT *, max(stat_date) OVER (PARTITION BY metric_code, dimension_value) AS newest FROM check_series)
        GROUP BY ALL""",
    "anomaly_check": """
        SELECT replace('M3A-' || metric_code || '-' || dimension_name || '-' || dimension_value, ' ', '_') AS anomaly_id, metric_code,
               metric_name_cn, anomaly_type,
               CASE WHEN direction = 'share' THEN CASE WHEN a >= 0.07 THEN 'high' ELSE 'medium' END
                    WHEN abs(c) >= 0.25 OR abs(a) >= 0.06 THEN 'high' WHEN abs(c) >= 0.15 OR abs(a) >= 0.04 THEN 'medium'
                    ELSE 'low' END AS severity,
               dimension_name, dimension_value, round(b + 1e-10, 6) + 0.0::DOUBLE AS baseline_value, round(r + 1e-10, 6) + 0.0::DOUBLE AS recent_value,
               a AS absolute_change, c AS relative_change,
               strftime(newest - 29, '%Y-%m-%d') || '~' || strftime(newest, '%Y-%m-%d') AS recent_window,
               strftime(newest - 59, '%Y-%m-%d') || '~' || strftime(newest - 30, '%Y-%m-%d') AS baseline_window,
               evidence_table, b IS NOT NULL AND r IS NOT NULL AS evaluated,
               coalesce(CASE direction WHEN 'share' THEN a >= 0.05 WHEN 'drop' THEN a < 0 AND (c <= -0.1 OR a <= -0.02)
                                       ELSE a > 0 AND (c >= 0.1 OR a >= 0.02) END, false) AS fired
        FROM (SELECT *, round(r - b + 1e-10, 6) + 0.0::DOUBLE AS a,
                     CASE WHEN b = 0 THEN 0.0 ELSE round((r - b) / abs(b) + 1e-10, 6) + 0.0::DOUBLE END AS c
              FROM check_means JOIN check_spec USING (metric_code))""",
    "anomaly_finding": "SELECT * EXCLUDE (evaluated, fired) FROM anomaly_check WHERE fired",
    "template_rate": """
        SELECT *, sum(complaint_count) OVER ()::DOUBLE / sum(action_count) OVER ()::DOUBLE AS g
        FROM (SELECT template_id, action_count, coalesce(complaint_count, 0) AS complaint_count,
                     coalesce(complaint_count, 0) / action_count::DOUBLE AS rate, newest
              FROM (SELECT template_id, count(DISTINCT action_id) AS action_count, any_value(newest) AS newest
                    FROM (SELECT *, max(action_date) OVER () AS newest FROM dwd_collection_action_detail_di
                          WHERE action_type = 'SMS' AND template_id IS NOT NULL)
                    WHERE action_date BETWEEN newest - 29 AND newest GROUP BY 1)
              LEFT JOIN (SELECT template_id, count(DISTINCT complaint_id) AS complaint_count FROM dwd_complaint_detail_di
                         WHERE complaint_date BETWEEN (SELECT max(action_date) FROM dwd_collection_action_detail_di WHERE action_type = 'SMS' AND template_id IS NOT NULL) - 29
                           AND (SELECT max(action_date) FROM dwd_collection_action_detail_di WHERE action_type = 'SMS' AND template_id IS NOT NULL)
                         GROUP BY 1) USING (template_id))""",
    "template_check": """
        SELECT 'M3A-complaint_per_10k_cases-template_id-' || template_id AS anomaly_id, 'complaint_per_10k_cases' AS metric_code,
               '万案投诉率' AS metric_name_cn, 'ratio_to_average' AS anomaly_type,
               CASE WHEN abs(c) >= 0.25 OR abs(a) >= 0.06 THEN 'high' WHEN abs(c) >= 0.15 OR abs(a) >= 0.04 THEN 'medium' ELSE 'low' END AS severity,
               'template_id' AS dimension_name, template_id AS dimension_value, round(g * 10000, 6) AS baseline_value,
               round(rate * 10000, 6) AS recent_value, round((rate - g) * 10000, 6) AS absolute_change, c AS relative_change,
               strftime(newest - 29, '%Y-%m-%d') || '~' || strftime(newest, '%Y-%m-%d') AS recent_window,
               'recent_global_average:' || strftime(newest - 29, '%Y-%m-%d') || '~' || strftime(newest, '%Y-%m-%d') AS baseline_window,
               'dwd_collection_action_detail_di+dwd_complaint_detail_di' AS evidence_table, rate >= g * 2 AS fired
        FROM (SELECT *, round(rate - g, 6) AS a, round((rate - g) / g, 6) AS c FROM template_rate
              ORDER BY rate DESC, template_id DESC LIMIT 1)""",
})
