"""The documented SQL checks, run by Spark SQL over any warehouse; the reference day is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame

HIGH_BALANCE = """
SELECT period, count(DISTINCT case_id) AS case_count,
       sum(CASE WHEN balance_segment = 'HIGH' THEN 1 ELSE 0 END) AS high_balance_cases,
       avg(CASE WHEN balance_segment = 'HIGH' THEN 1.0D ELSE 0.0D END) AS high_balance_rate
FROM (SELECT case_id, balance_segment,
             CASE WHEN CAST(case_create_time AS DATE) >= date_sub(CAST(:day AS DATE), 29) THEN 'recent_30d' ELSE 'baseline' END AS period
      FROM {dim_case})
GROUP BY period"""

CONNECT_AND_AI = """
SELECT period, vendor_group, count(*) AS action_count, avg(CASE WHEN connected_flag THEN 1.0D ELSE 0.0D END) AS connect_rate,
       avg(CASE WHEN ai_outbound_flag THEN 1.0D ELSE 0.0D END) AS ai_coverage_rate
FROM (SELECT connected_flag, ai_outbound_flag, CASE WHEN vendor_id = :vendor THEN :vendor ELSE 'OTHER' END AS vendor_group,
             CASE WHEN CAST(action_time AS DATE) >= date_sub(CAST(:day AS DATE), 29) THEN 'recent_30d' ELSE 'baseline' END AS period
      FROM {ods_collection_action})
GROUP BY period, vendor_group"""

TEMPLATE_COMPLAINTS = """
WITH sent AS (
  SELECT CASE WHEN template_id = 'TPL_RISK_NOTICE' THEN template_id ELSE 'OTHER' END AS template_group, count(*) AS sms_count
  FROM {ods_sms_send_log} GROUP BY 1),
complained AS (
  SELECT CASE WHEN template_id = 'TPL_RISK_NOTICE' THEN template_id ELSE 'OTHER' END AS template_group, count(*) AS complaint_count
  FROM {ods_complaint} GROUP BY 1)
SELECT sent.template_group, sms_count, coalesce(complaint_count, 0) AS complaint_count,
       coalesce(complaint_count, 0) * 1.0D / sms_count AS complaint_rate
FROM sent LEFT JOIN complained ON sent.template_group = complained.template_group"""

REDUCTION_USE = """
WITH applied AS (
  SELECT case_id, count(reduction_id) AS applications, sum(CASE WHEN approval_status = 'APPROVED' THEN 1 ELSE 0 END) AS approved,
         sum(coalesce(approved_amount, 0)) AS amount
  FROM {ods_reduction_application} GROUP BY case_id)
SELECT period, count(DISTINCT c.case_id) AS case_count, coalesce(sum(applications), 0) AS reduction_case_count,
       coalesce(sum(approved), 0) AS approved_count, coalesce(sum(amount), 0.0D) AS approved_amount,
       coalesce(sum(applications), 0) * 1.0D / count(DISTINCT c.case_id) AS reduction_case_rate
FROM (SELECT case_id, CASE WHEN CAST(case_create_time AS DATE) >= date_sub(CAST(:day AS DATE), 29) THEN 'recent_30d' ELSE 'baseline' END AS period
      FROM {dim_case}) c LEFT JOIN applied a ON c.case_id = a.case_id
GROUP BY period"""

FACTORS = """
SELECT factor_code, count(DISTINCT stat_date) AS days, count(*) AS rows, avg(contribution_pct) AS avg_contribution_pct
FROM {ads_recovery_attribution_di} GROUP BY factor_code"""

STATEMENTS = {
    "high_balance_share": (HIGH_BALANCE, ["dim_case"]),
    "connect_and_ai_coverage": (CONNECT_AND_AI, ["ods_collection_action"]),
    "template_complaint_rate": (TEMPLATE_COMPLAINTS, ["ods_sms_send_log", "ods_complaint"]),
    "reduction_use": (REDUCTION_USE, ["dim_case", "ods_reduction_application"]),
    "attribution_factors": (FACTORS, ["ads_recovery_attribution_di"]),
}


def run(wh, name: str, day: str, vendor: str = "V_B") -> DataFrame:
    text, tables = STATEMENTS[name]
    args = {k: v for k, v in (("day", day), ("vendor", vendor)) if f":{k}" in text}
    return wh.spark.sql(text, args=args, **{t: wh[t] for t in tables})
