"""SQL text of the detail, subject and application layers and of the daily metrics."""

from __future__ import annotations

from duewise.oracle.sql import CTES, rate, ratio

CTES.update({
    "dwd_due_plan_detail_di": """
        SELECT due_date AS stat_date, plan_id, p.loan_id, p.customer_id, product_code, channel_code, due_date, due_amount,
               due_amount AS outstanding_amount, coalesce(initial_dpd_bucket, 'CURRENT') AS dpd_bucket
        FROM ods_repayment_plan p LEFT JOIN dim_loan l ON p.loan_id = l.loan_id
        LEFT JOIN dim_case_loan_mapping m ON m.loan_id = p.loan_id LEFT JOIN dim_case c ON c.case_id = m.case_id""",
    "dwd_repayment_detail_di": """
        SELECT repay_id, plan_id, loan_id, repay_time, CAST(repay_time AS DATE) AS repay_date, repay_amount, repay_status
        FROM (SELECT *, row_number() OVER (PARTITION BY repay_id ORDER BY repay_time, repay_amount) AS rn
              FROM ods_repayment_detail) WHERE rn = 1""",
    "dwd_collection_action_detail_di": """
        SELECT action_id, case_id, customer_id, vendor_id, line_id, collector_id, action_time,
               CAST(action_time AS DATE) AS action_date, action_type, template_id, connected_flag, ptp_flag,
               ptp_fulfilled_flag, ai_outbound_flag
        FROM ods_collection_action""",
    "dwd_case_flow_detail_di": """
        SELECT flow_id, case_id, from_status, to_status, flow_time, CAST(flow_time AS DATE) AS flow_date, strategy_id
        FROM ods_case_flow""",
    "dwd_complaint_detail_di": """
        SELECT complaint_id, case_id, customer_id, vendor_id, collector_id, template_id, complaint_time,
               CAST(complaint_time AS DATE) AS complaint_date, complaint_type, complaint_level
        FROM ods_complaint""",
    "plan_recovery": """
        SELECT d.plan_id, d.stat_date, d.loan_id, d.customer_id, product_code, dpd_bucket, due_amount, outstanding_amount,
               coalesce(sum(repay_amount) FILTER (repay_time <= due_date + INTERVAL 7 DAY), 0.0) AS d7,
               coalesce(sum(repay_amount) FILTER (repay_time <= due_date + INTERVAL 15 DAY), 0.0) AS d15,
               coalesce(sum(repay_amount) FILTER (repay_time <= due_date + INTERVAL 30 DAY), 0.0) AS d30
        FROM dwd_due_plan_detail_di d LEFT JOIN dwd_repayment_detail_di r ON d.plan_id = r.plan_id
        GROUP BY ALL""",
    "dws_loan_status_snapshot_di": f"""
        SELECT stat_date, loan_id, customer_id, product_code, dpd_bucket, due_amount, d7 AS repaid_amount_d7,
               {rate('d7', 'due_amount')} AS recovery_rate_d7
        FROM plan_recovery""",
    "action_by_case": """
        SELECT action_date AS stat_date, case_id, count(*) AS action_count, count(*) FILTER (connected_flag) AS connected_count,
               count(*) FILTER (ptp_flag) AS ptp_count
        FROM dwd_collection_action_detail_di GROUP BY ALL""",
    "repaid_case_day": """
        SELECT repay_date AS stat_date, case_id, sum(repay_amount) AS repaid_amount
        FROM dwd_repayment_detail_di JOIN dim_case_loan_mapping USING (loan_id) GROUP BY ALL""",
    "dws_case_status_snapshot_di": """
        SELECT s.stat_date, s.case_id, customer_id, vendor_id, line_id, collector_id, dpd_bucket, outstanding_amount,
               coalesce(action_count, 0) AS action_count, coalesce(connected_count, 0) AS connected_count,
               coalesce(ptp_count, 0) AS ptp_count, coalesce(repaid_amount, 0.0) AS repaid_amount
        FROM ods_case_daily_snapshot s LEFT JOIN action_by_case a ON s.stat_date = a.stat_date AND s.case_id = a.case_id
        LEFT JOIN repaid_case_day r ON s.stat_date = r.stat_date AND s.case_id = r.case_id""",
    "dws_customer_status_snapshot_di": """
        SELECT stat_date, customer_id, active_loan_count, active_case_count, total_outstanding_amount, max_dpd, risk_level
        FROM ods_customer_daily_snapshot""",
    "complaint_by_case": """
        SELECT complaint_date AS stat_date, case_id, count(*) AS complaint_count FROM dwd_complaint_detail_di GROUP BY ALL""",
    "dws_collection_process_wide_di": f"""
        SELECT p.*, coalesce(complaint_count, 0) AS complaint_count,
               {rate('connected_count', 'action_count')} AS connect_rate,
               {rate('ptp_fulfilled_count', 'ptp_count')} AS ptp_fulfillment_rate,
               {rate('ai_action_count', 'action_count')} AS ai_coverage_rate
        FROM (SELECT action_date AS stat_date, case_id, vendor_id, line_id, collector_id, count(*) AS action_count,
                     count(*) FILTER (ai_outbound_flag) AS ai_action_count, count(*) FILTER (connected_flag) AS connected_count,
                     count(*) FILTER (ptp_flag) AS ptp_count, count(*) FILTER (ptp_fulfilled_flag) AS ptp_fulfilled_count
              FROM dwd_collection_action_detail_di GROUP BY ALL) p
        LEFT JOIN complaint_by_case c ON p.stat_date = c.stat_date AND p.case_id = c.case_id""",
    "dws_vendor_line_capacity_di": f"""
        SELECT stat_date, s.vendor_id, s.line_id, region, active_case_count, active_collector_count,
               {ratio('active_case_count', 'active_collector_count', 4)} AS case_per_collector
        FROM (SELECT stat_date, vendor_id, line_id, count(DISTINCT case_id) AS active_case_count,
                     count(DISTINCT collector_id) AS active_collector_count
              FROM ods_case_daily_snapshot GROUP BY ALL) s
        LEFT JOIN dim_collection_line l ON s.line_id = l.line_id""",
    "dws_customer_profile_di": """
        SELECT (SELECT max(stat_date) FROM dws_customer_status_snapshot_di) AS stat_date, customer_id, customer_id_hash,
               mobile_masked, province, customer_segment, risk_level_current,
               coalesce(total_outstanding_amount, 0.0) AS total_outstanding_amount
        FROM dim_customer LEFT JOIN (SELECT customer_id, arg_max(total_outstanding_amount, stat_date) AS total_outstanding_amount
                                     FROM dws_customer_status_snapshot_di GROUP BY 1) USING (customer_id)""",
    "dws_collector_profile_di": f"""
        SELECT stat_date, p.collector_id, vendor_id, line_id, skill_level, action_count,
               {rate('connected_count', 'action_count')} AS connect_rate, complaint_count
        FROM (SELECT stat_date, collector_id, first(vendor_id ORDER BY case_id, vendor_id, line_id) AS vendor_id,
                     first(line_id ORDER BY case_id, vendor_id, line_id) AS line_id,
                     CAST(sum(action_count) AS BIGINT) AS action_count, CAST(sum(connected_count) AS BIGINT) AS connected_count,
                     CAST(sum(complaint_count) AS BIGINT) AS complaint_count
              FROM dws_collection_process_wide_di GROUP BY stat_date, collector_id) p
        LEFT JOIN (SELECT collector_id, skill_level FROM dim_collector) c ON p.collector_id = c.collector_id""",
    "dws_customer_postloan_tag_di": """
        SELECT stat_date, customer_id, CASE WHEN max_dpd <= 30 THEN 'M1' WHEN max_dpd <= 60 THEN 'M2' ELSE 'M3+' END AS dpd_tag,
               CASE WHEN total_outstanding_amount >= 35000 THEN 'HIGH' ELSE 'NORMAL' END AS balance_tag,
               CASE WHEN active_case_count > 1 THEN 'MULTI_CASE' ELSE 'SINGLE_CASE' END AS behavior_tag,
               'TOUCH_PENDING' AS touch_tag, 'NORMAL' AS compliance_tag, 'BASE' AS strategy_tag
        FROM dws_customer_status_snapshot_di""",
    # ---- metrics
    "valid_call": """
        SELECT action_date AS stat_date, a.*, coalesce(duration_seconds, 0) AS duration_seconds,
               connected_flag AND coalesce(duration_seconds, 0) >= 60 AS valid_contact_flag
        FROM dwd_collection_action_detail_di a LEFT JOIN ods_call_record c ON a.action_id = c.action_id""",
    "m_due": """
        SELECT stat_date, count(DISTINCT customer_id) AS due_account_count, count(DISTINCT loan_id) AS due_loan_count,
               sum(due_amount) AS due_total_amount
        FROM dwd_due_plan_detail_di GROUP BY 1""",
    "m_entry": f"""
        SELECT d.stat_date, {rate('e.n', 'd.due_account_count')} AS collection_entry_rate
        FROM m_due d LEFT JOIN (SELECT CAST(case_create_time AS DATE) AS stat_date, count(DISTINCT customer_id) AS n
                                FROM dim_case GROUP BY 1) e ON d.stat_date = e.stat_date""",
    "m_recovery": f"""
        SELECT stat_date, {rate('sum(d7)', 'sum(outstanding_amount)')} AS recovery_rate_d7,
               {rate('sum(d15)', 'sum(outstanding_amount)')} AS recovery_rate_d15,
               {rate('sum(d30)', 'sum(outstanding_amount)')} AS recovery_rate_d30
        FROM plan_recovery GROUP BY 1""",
    "m_m1": f"""
        SELECT stat_date, {rate('sum(repaid_amount_d7)', 'sum(due_amount)')} AS m1_recovery_rate
        FROM dws_loan_status_snapshot_di WHERE dpd_bucket = 'M1' GROUP BY 1""",
    "m_process": f"""
        SELECT stat_date, {rate('sum(connected_count)', 'sum(action_count)')} AS connect_rate,
               {rate('sum(ptp_fulfilled_count)', 'sum(ptp_count)')} AS ptp_keep_rate
        FROM dws_collection_process_wide_di GROUP BY 1""",
    "m_call": f"""
        SELECT stat_date, {rate('count(*) FILTER (valid_contact_flag)', 'count(*) FILTER (connected_flag)')} AS valid_contact_rate,
               {rate('count(*) FILTER (ptp_flag)', 'count(*) FILTER (valid_contact_flag)')} AS ptp_rate
        FROM valid_call GROUP BY 1""",
    "m_talk": f"""
        SELECT stat_date, {ratio('sum(duration_seconds)', 'count(*)', 4)} AS avg_call_duration_per_call,
               {ratio('sum(duration_seconds)', 'count(DISTINCT collector_id)', 4)} AS avg_call_duration_per_collector
        FROM valid_call WHERE duration_seconds > 0 GROUP BY 1""",
    "m_first": """
        SELECT stat_date, round(greatest(avg((epoch_us(t) - epoch_us(case_create_time)) / 3600000000.0::DOUBLE), 0.0), 4) AS first_contact_hours
        FROM (SELECT action_date AS stat_date, case_id, min(action_time) AS t FROM dwd_collection_action_detail_di GROUP BY ALL)
        LEFT JOIN dim_case USING (case_id) GROUP BY 1""",
    "m_over": f"""
        SELECT stat_date, {rate('count(*) FILTER (n > 3)', 'count(*)')} AS over_frequency_contact_rate
        FROM (SELECT action_date AS stat_date, case_id, count(*) AS n FROM dwd_collection_action_detail_di GROUP BY ALL) GROUP BY 1""",
    "m_risk": f"""
        SELECT action_date AS stat_date, {rate("count(*) FILTER (template_id = 'TPL_RISK_NOTICE')", 'count(*)')} AS risk_phrase_hit_rate
        FROM dwd_collection_action_detail_di WHERE action_type IN ('SMS', 'CALL', 'AI_OUTBOUND') GROUP BY 1""",
    "m_qa": f"""
        SELECT c.stat_date, {rate('f.n', 'c.n')} AS qa_fail_rate
        FROM (SELECT action_date AS stat_date, count(*) AS n FROM dwd_collection_action_detail_di
              WHERE action_type IN ('CALL', 'AI_OUTBOUND') GROUP BY 1) c
        LEFT JOIN (SELECT complaint_date AS stat_date, count(*) AS n FROM dwd_complaint_detail_di
                   WHERE complaint_level IN ('MEDIUM', 'HIGH') GROUP BY 1) f ON c.stat_date = f.stat_date""",
    "case_day": """
        SELECT stat_date, count(DISTINCT case_id) AS assigned, count(DISTINCT collector_id) AS collectors,
               sum(repaid_amount) AS repaid
        FROM dws_case_status_snapshot_di GROUP BY 1""",
    "m_case": f"""
        SELECT d.stat_date, {rate('called', 'assigned')} AS call_coverage_rate, {rate('valid', 'assigned')} AS valid_coverage_rate,
               {ratio('repaid', 'collectors', 4)} AS collector_productivity, {rate('ccases', 'assigned')} AS complaint_rate,
               round(coalesce(complaints, 0) / assigned::DOUBLE * 10000, 4) AS complaint_per_10k_cases,
               {rate('reduced', 'assigned')} AS reduction_usage_rate
        FROM case_day d
        LEFT JOIN (SELECT stat_date, count(DISTINCT case_id) AS called FROM dws_collection_process_wide_di GROUP BY 1) a ON a.stat_date = d.stat_date
        LEFT JOIN (SELECT stat_date, count(DISTINCT case_id) AS valid FROM valid_call WHERE valid_contact_flag GROUP BY 1) v ON v.stat_date = d.stat_date
        LEFT JOIN (SELECT complaint_date AS stat_date, count(DISTINCT case_id) AS ccases, count(*) AS complaints
                   FROM dwd_complaint_detail_di GROUP BY 1) c ON c.stat_date = d.stat_date
        LEFT JOIN (SELECT CAST(apply_time AS DATE) AS stat_date, count(DISTINCT case_id) AS reduced
                   FROM ods_reduction_application GROUP BY 1) r ON r.stat_date = d.stat_date""",
    "m_redrec": f"""
        SELECT stat_date, {rate('sum(repaid_amount)', 'sum(outstanding_amount)')} AS reduction_recovery_rate
        FROM dws_case_status_snapshot_di
        WHERE (stat_date, case_id) IN (SELECT CAST(apply_time AS DATE), case_id FROM ods_reduction_application) GROUP BY 1""",
    "m_roi": f"""
        SELECT a.stat_date, {ratio('repaid - repaid * 0.82::DOUBLE', 'approved', 6)} AS reduction_roi
        FROM (SELECT CAST(apply_time AS DATE) AS stat_date, sum(approved_amount) AS approved FROM ods_reduction_application GROUP BY 1) a
        LEFT JOIN case_day d ON a.stat_date = d.stat_date""",
})

METRIC_SOURCE = {
    "due_account_count": "m_due", "due_loan_count": "m_due", "due_total_amount": "m_due",
    "collection_entry_rate": "m_entry", "recovery_rate_d7": "m_recovery", "recovery_rate_d15": "m_recovery",
    "recovery_rate_d30": "m_recovery", "m1_recovery_rate": "m_m1", "call_coverage_rate": "m_case",
    "valid_coverage_rate": "m_case", "connect_rate": "m_process", "valid_contact_rate": "m_call",
    "first_contact_hours": "m_first", "ptp_rate": "m_call", "ptp_keep_rate": "m_process",
    "avg_call_duration_per_call": "m_talk", "avg_call_duration_per_collector": "m_talk",
    "collector_productivity": "m_case", "complaint_rate": "m_case", "complaint_per_10k_cases": "m_case",
    "risk_phrase_hit_rate": "m_risk", "qa_fail_rate": "m_qa", "over_frequency_contact_rate": "m_over",
    "reduction_usage_rate": "m_case", "reduction_recovery_rate": "m_redrec", "reduction_roi": "m_roi",
}
_SIDES = list(dict.fromkeys(METRIC_SOURCE.values()))
_SPINE = " UNION ".join(f"SELECT stat_date FROM {s}" for s in _SIDES)

CTES.update({
    "ads_postloan_dashboard_di": f"""
        SELECT b.stat_date, {', '.join(f'coalesce({s}.{c}, 0) AS {c}' for c, s in METRIC_SOURCE.items())}
        FROM ({_SPINE}) b {' '.join(f'LEFT JOIN {s} ON {s}.stat_date = b.stat_date' for s in _SIDES)}
        WHERE b.stat_date <= (SELECT max(stat_date) FROM dws_case_status_snapshot_di)""",
    "ads_recovery_attribution_di": """
        SELECT stat_date, factor_code, factor_name, idx / 10.0::DOUBLE AS factor_value,
               round(least(1.0, 0.08::DOUBLE + idx * 0.035::DOUBLE), 6) AS contribution_pct
        FROM (SELECT stat_date FROM ads_postloan_dashboard_di ORDER BY stat_date DESC LIMIT 30),
             (VALUES (1, 'CAPACITY_EAST', '华东线路人均案量'), (2, 'VENDOR_B_CONNECT', '供应商 B 接通率'),
                     (3, 'HIGH_BALANCE_SHARE', '高余额客群占比'), (4, 'AI_COVERAGE', 'AI 外呼覆盖率'),
                     (5, 'REDUCTION_PTP', '减免与 PTP'), (6, 'SMS_COMPLAINT', '短信模板投诉')) f(idx, factor_code, factor_name)""",
    "ads_vendor_performance_di": f"""
        SELECT p.stat_date, p.vendor_id, action_count, {rate('called', 'assigned')} AS call_coverage_rate,
               {rate('connected', 'action_count')} AS connect_rate, {rate('ptp', 'connected')} AS ptp_rate,
               {rate('kept', 'ptp')} AS ptp_keep_rate, {rate('complaints', 'assigned')} AS complaint_rate
        FROM (SELECT stat_date, vendor_id, CAST(sum(action_count) AS BIGINT) AS action_count, count(DISTINCT case_id) AS called,
                     sum(connected_count) AS connected, sum(ptp_count) AS ptp, sum(ptp_fulfilled_count) AS kept,
                     sum(complaint_count) AS complaints
              FROM dws_collection_process_wide_di GROUP BY 1, 2) p
        LEFT JOIN (SELECT stat_date, vendor_id, count(DISTINCT case_id) AS assigned FROM dws_case_status_snapshot_di
                   GROUP BY 1, 2) a ON a.stat_date = p.stat_date AND a.vendor_id = p.vendor_id""",
    "ads_collector_performance_di": f"""
        SELECT p.stat_date, collector_id, vendor_id, action_count, {rate('connected', 'action_count')} AS connect_rate,
               {rate('kept', 'ptp')} AS ptp_keep_rate, coalesce(first_contact_hours, 0) AS first_contact_hours,
               coalesce(avg_call_duration_per_call, 0) AS avg_call_duration_per_call,
               coalesce(avg_call_duration_per_collector, 0) AS avg_call_duration_per_collector,
               coalesce(collector_productivity, 0) AS collector_productivity, complaint_count
        FROM (SELECT stat_date, collector_id, first(vendor_id ORDER BY case_id, vendor_id, line_id) AS vendor_id,
                     CAST(sum(action_count) AS BIGINT) AS action_count, sum(connected_count) AS connected, sum(ptp_count) AS ptp,
                     sum(ptp_fulfilled_count) AS kept, CAST(sum(complaint_count) AS BIGINT) AS complaint_count
              FROM dws_collection_process_wide_di GROUP BY 1, 2) p
        LEFT JOIN ads_postloan_dashboard_di b ON b.stat_date = p.stat_date""",
    "ads_reduction_roi_di": """
        SELECT b.stat_date, coalesce(n, 0) AS reduction_case_count, coalesce(approved, 0.0) AS approved_reduction_amount,
               reduction_usage_rate, reduction_recovery_rate, reduction_roi
        FROM ads_postloan_dashboard_di b
        LEFT JOIN (SELECT CAST(apply_time AS DATE) AS stat_date, count(DISTINCT case_id) AS n, sum(approved_amount) AS approved
                   FROM ods_reduction_application GROUP BY 1) r ON r.stat_date = b.stat_date""",
    "ads_compliance_qc_di": """
        SELECT b.stat_date, 'ALL' AS template_id, coalesce(assigned, 0) AS active_case_count, coalesce(n, 0) AS complaint_count,
               complaint_rate, complaint_per_10k_cases, risk_phrase_hit_rate, qa_fail_rate, over_frequency_contact_rate
        FROM ads_postloan_dashboard_di b LEFT JOIN case_day d ON d.stat_date = b.stat_date
        LEFT JOIN (SELECT complaint_date AS stat_date, count(*) AS n FROM dwd_complaint_detail_di GROUP BY 1) c
               ON c.stat_date = b.stat_date""",
})
