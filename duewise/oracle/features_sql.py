"""SQL text of feature building and of classifier evaluation."""

from __future__ import annotations

from duewise.oracle.sql import CTES

_STATE = {
    "observation": "observation_date",
    "d7": "d7_end_date",
}

CTES.update({
    "observation": """
        SELECT loan_id, customer_id, product_code, dpd_bucket, due_amount, stat_date AS observation_date, repaid_amount_d7,
               recovery_rate_d7, CAST(repaid_amount_d7 > 0 AS INTEGER) AS is_recovered_d7
        FROM dws_loan_status_snapshot_di""",
    "main_case": """
        SELECT loan_id, case_id FROM dim_case_loan_mapping WHERE main_loan_flag
        QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY mapping_start_date DESC, case_id DESC) = 1""",
    "score_asof": """
        SELECT o.loan_id, o.customer_id, o.observation_date, postloan_c_score, score_level
        FROM observation o LEFT JOIN (SELECT o.loan_id, s.* FROM observation o JOIN ods_postloan_c_score s ON s.customer_id = o.customer_id
              AND CAST(s.score_date AS DATE) <= o.observation_date
              QUALIFY row_number() OVER (PARTITION BY o.loan_id ORDER BY score_date DESC, score_id DESC) = 1) x ON x.loan_id = o.loan_id""",
    "recent_action": """
        SELECT o.loan_id, coalesce(n, 0)::DOUBLE AS action_count_7d, coalesce(c, 0)::DOUBLE AS connected_count_7d,
               CASE WHEN n > 0 THEN c::DOUBLE / n ELSE 0.0 END AS connect_rate_7d, coalesce(p, 0)::DOUBLE AS ptp_count_7d,
               CASE WHEN n > 0 THEN p::DOUBLE / n ELSE 0.0 END AS ptp_rate_7d, CAST(o.observation_date - last_day AS DOUBLE) AS days_since_last_action
        FROM observation o LEFT JOIN (
            SELECT o.loan_id, max(CAST(action_time AS DATE)) AS last_day,
                   count(*) FILTER (CAST(action_time AS DATE) >= observation_date - 6) AS n,
                   count(*) FILTER (connected_flag AND CAST(action_time AS DATE) >= observation_date - 6) AS c,
                   count(*) FILTER (ptp_flag AND CAST(action_time AS DATE) >= observation_date - 6) AS p
            FROM observation o JOIN main_case m ON m.loan_id = o.loan_id JOIN ods_collection_action a ON a.case_id = m.case_id
                 AND CAST(action_time AS DATE) <= observation_date GROUP BY 1) x ON x.loan_id = o.loan_id""",
    "case_feature": """
        SELECT m.loan_id, initial_dpd_bucket, initial_outstanding_amount, balance_segment, protect_flag, sensitive_flag,
               current_vendor_id, current_line_id, coalesce(a, 0)::DOUBLE AS action_count, coalesce(c, 0)::DOUBLE AS connected_count,
               coalesce(i, 0)::DOUBLE AS ai_action_count, coalesce(p, 0)::DOUBLE AS ptp_count, coalesce(f, 0)::DOUBLE AS ptp_fulfilled_count,
               coalesce(q, 0)::DOUBLE AS complaint_count, CASE WHEN a <> 0 THEN c::DOUBLE / a ELSE 0.0 END AS connect_rate,
               CASE WHEN a <> 0 THEN i::DOUBLE / a ELSE 0.0 END AS ai_coverage_rate,
               CASE WHEN p <> 0 THEN f::DOUBLE / p ELSE 0.0 END AS ptp_fulfillment_rate
        FROM main_case m LEFT JOIN dim_case c ON c.case_id = m.case_id
        LEFT JOIN (SELECT c.case_id, sum(action_count) AS a, sum(connected_count) AS c, sum(ai_action_count) AS i, sum(ptp_count) AS p,
                          sum(ptp_fulfilled_count) AS f, sum(complaint_count) AS q
                   FROM dim_case c JOIN dws_collection_process_wide_di w ON w.case_id = c.case_id
                        AND w.stat_date BETWEEN CAST(case_create_time AS DATE) - 6 AND CAST(case_create_time AS DATE)
                   GROUP BY 1) x ON x.case_id = m.case_id""",
    "state_key": """
        SELECT o.loan_id, o.customer_id, m.case_id, observation_date, observation_date + 7 AS d7_end_date, repaid_amount_d7
        FROM observation o LEFT JOIN main_case m ON m.loan_id = o.loan_id""",
})
for _suffix, _at in _STATE.items():
    CTES.update({
        f"loan_at_{_suffix}": f"""
            SELECT loan_id, snapshot_date, outstanding_amount, CASE WHEN outstanding_amount <= 0 THEN 0 ELSE days END AS dpd,
                   CASE WHEN outstanding_amount <= 0 THEN 'closed' WHEN days = 0 THEN 'current' WHEN days <= 30 THEN 'overdue' ELSE 'in_collection' END AS loan_status
            FROM (SELECT k.loan_id, any_value(k.{_at}) AS snapshot_date, CAST(any_value(k.{_at} - p.due_date) AS INTEGER) AS days,
                         round(greatest(any_value(due_amount) - coalesce(sum(repay_amount), 0.0), 0.0), 2) AS outstanding_amount
                  FROM state_key k JOIN ods_repayment_plan p ON p.loan_id = k.loan_id AND p.due_date <= k.{_at}
                  LEFT JOIN dwd_repayment_detail_di r ON r.loan_id = k.loan_id AND r.repay_date <= k.{_at} AND r.repay_status = 'SUCCESS'
                  GROUP BY 1)""",
        f"case_at_{_suffix}": f"""
            SELECT k.loan_id, dpd_bucket, outstanding_amount, case_status
            FROM state_key k JOIN ods_case_daily_snapshot s ON s.case_id = k.case_id AND s.stat_date <= k.{_at}
            QUALIFY row_number() OVER (PARTITION BY k.loan_id ORDER BY s.stat_date DESC) = 1""",
        f"customer_at_{_suffix}": f"""
            SELECT k.loan_id, max_dpd, total_outstanding_amount, active_case_count
            FROM state_key k JOIN ods_customer_daily_snapshot s ON s.customer_id = k.customer_id AND s.stat_date <= k.{_at}
            QUALIFY row_number() OVER (PARTITION BY k.loan_id ORDER BY s.stat_date DESC) = 1""",
    })
CTES.update({
    "state_target": """
        SELECT *, CASE WHEN outstanding_at_observation <> 0 THEN coalesce(outstanding_reduction_d7 / outstanding_at_observation, 0) ELSE 0.0 END AS outstanding_reduction_rate_d7,
               greatest(dpd_at_observation - dpd_at_d7, 0) AS dpd_reduction_d7,
               CAST(coalesce(dpd_at_observation > 0 AND dpd_at_d7 = 0 AND outstanding_reduction_d7 > 0, false) AS INTEGER) AS is_cured_d7,
               CAST(coalesce(dpd_at_d7 = 0 AND outstanding_reduction_d7 > 0 AND repaid_amount_d7 > 0, false) AS INTEGER) AS is_state_recovered_d7,
               CAST(coalesce(outstanding_at_observation > 0 AND outstanding_at_d7 <= 0.01, false) AS INTEGER) AS is_fully_recovered_d7,
               CAST(coalesce(case_status_at_d7 IN ('cured', 'closed'), false) OR coalesce(case_outstanding_at_d7 <= 0.01, false) AS INTEGER) AS case_cured_d7
        FROM (SELECT k.loan_id, k.customer_id, k.case_id, k.observation_date, d7_end_date, repaid_amount_d7,
                     lo.snapshot_date AS snapshot_date_observation, l7.snapshot_date AS snapshot_date_d7,
                     lo.dpd IS NOT NULL AS loan_state_observation_available, l7.dpd IS NOT NULL AS loan_state_d7_available,
                     lo.dpd AS dpd_at_observation, l7.dpd AS dpd_at_d7, lo.outstanding_amount AS outstanding_at_observation,
                     l7.outstanding_amount AS outstanding_at_d7, lo.loan_status AS loan_status_at_observation, l7.loan_status AS loan_status_at_d7,
                     co.outstanding_amount AS case_outstanding_at_observation, c7.outstanding_amount AS case_outstanding_at_d7,
                     co.dpd_bucket AS case_dpd_bucket_at_observation, c7.dpd_bucket AS case_dpd_bucket_at_d7,
                     co.case_status AS case_status_at_observation, c7.case_status AS case_status_at_d7,
                     uo.max_dpd AS customer_max_dpd_at_observation, u7.max_dpd AS customer_max_dpd_at_d7,
                     uo.total_outstanding_amount AS customer_total_outstanding_at_observation, u7.total_outstanding_amount AS customer_total_outstanding_at_d7,
                     uo.active_case_count AS customer_active_case_count_at_observation, u7.active_case_count AS customer_active_case_count_at_d7,
                     greatest(lo.outstanding_amount - l7.outstanding_amount, 0.0) AS outstanding_reduction_d7
              FROM state_key k LEFT JOIN loan_at_observation lo USING (loan_id) LEFT JOIN loan_at_d7 l7 USING (loan_id)
              LEFT JOIN case_at_observation co USING (loan_id) LEFT JOIN case_at_d7 c7 USING (loan_id)
              LEFT JOIN customer_at_observation uo USING (loan_id) LEFT JOIN customer_at_d7 u7 USING (loan_id))""",
    "model_dataset": """
        SELECT o.loan_id, o.observation_date, is_recovered_d7, o.product_code, channel_code, loan_amount, loan_term, interest_rate, mob, vintage_month,
               due_amount, ln(1 + greatest(due_amount, 0)) AS log_due_amount, 0.0::DOUBLE AS days_since_due_date, 0.0::DOUBLE AS dpd_x_log_due_amount, dpd_bucket,
               age_group, gender, province, city, occupation_type, customer_segment, risk_level_current, postloan_c_score,
               postloan_c_score / 100.0::DOUBLE * connect_rate_7d AS score_x_connect_rate, score_level, initial_dpd_bucket, initial_outstanding_amount,
               coalesce(initial_outstanding_amount / nullif(loan_amount, 0), 0.0) AS outstanding_to_loan_ratio, balance_segment,
               CAST(protect_flag AS DOUBLE) AS protect_flag, CAST(sensitive_flag AS DOUBLE) AS sensitive_flag, current_vendor_id, current_line_id,
               action_count_7d, connected_count_7d, connect_rate_7d, ptp_count_7d, ptp_rate_7d, days_since_last_action,
               coalesce(ai_action_count, 0) AS ai_action_count, coalesce(complaint_count, 0) AS complaint_count, coalesce(ai_coverage_rate, 0) AS ai_coverage_rate
        FROM observation o LEFT JOIN dim_loan l ON l.loan_id = o.loan_id LEFT JOIN dim_customer u ON u.customer_id = o.customer_id
        LEFT JOIN score_asof s ON s.loan_id = o.loan_id LEFT JOIN case_feature c ON c.loan_id = o.loan_id
        LEFT JOIN recent_action r ON r.loan_id = o.loan_id""",
    "model_split": """
        SELECT * EXCLUDE (rn, n), rn <= round(n * 0.25) AS is_test
        FROM (SELECT *, count(*) OVER (PARTITION BY is_recovered_d7) AS n,
                     row_number() OVER (PARTITION BY is_recovered_d7 ORDER BY md5(loan_id || '-20260521'), loan_id) AS rn FROM model_dataset)""",
    "scored_label": """
        SELECT loan_id, is_recovered_d7 AS label, floor(due_amount / 1000) / 500.0::DOUBLE AS score FROM observation""",
    "sweep": """
        SELECT *, tp / positives::DOUBLE AS tpr, fp / negatives::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS precision
        FROM (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
                     CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives
              FROM (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored_label GROUP BY 1)
              WINDOW w AS (ORDER BY score DESC))""",
    "ranking": """
        SELECT round(sum(neg * (2 * tp - pos) / 2.0::DOUBLE) / any_value(positives::DOUBLE * negatives), 6) AS auc,
               round(greatest(max(tpr - fpr), 0.0), 6) AS ks, round(sum(pos * precision) / any_value(positives), 6) AS pr_auc
        FROM sweep""",
})
