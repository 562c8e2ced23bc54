"""SQL text of the strategy estimates, report datasets and chart datasets."""

from __future__ import annotations

from duewise.oracle.sql import CTES
from duewise.plans.strategy import SCENARIOS

_SCEN = ", ".join(
    f"('{s[0]}', '{s[2]}', '{s[4]}', '{s[7]}', {s[8]}, '{s[9]}', '{s[10]}', {s[11]})" for s in SCENARIOS
)
_CODES = ["m1_recovery_rate", "connect_rate", "avg_case_per_collector", "high_balance_high_risk_share", "ai_call_coverage",
          "reduction_usage_rate", "ptp_keep_rate"]
_ORDER = "list_position([" + ", ".join(f"'{c}'" for c in _CODES) + "], metric_code)"
_METRICS = ["connect_rate", "ai_call_coverage", "manual_call_coverage", "ptp_keep_rate", "reduction_usage_rate", "complaint_rate"]
_ITEM = "list_position([" + ", ".join(f"'{c}'" for c in _METRICS) + "], metric_code) - 1"

CTES.update({
    "scenario": f"SELECT * FROM (VALUES {_SCEN}) s(scenario_id, strategy_type, target_anomaly_id, keyword, rule_delta, rule_direction, rule_confidence, scenario_order)",
    "target_finding": """
        SELECT * FROM anomaly_finding WHERE metric_code IN ('recovery_rate_d7', 'm1_recovery_rate') ORDER BY metric_code, dimension_value LIMIT 1""",
    "process_item": f"""
        SELECT 'M3B-recovery_rate_d7-' || lpad(CAST(contribution_rank AS VARCHAR), 2, '0') AS attribution_id, contribution_rank,
               dimension_name || '=' || dimension_value AS driver, CAST({_ITEM} AS INTEGER) AS item_order, metric_code, baseline_value, recent_value, delta
        FROM linkage WHERE contribution_rank <= 5""",
    "evidence_row": f"""
        SELECT 1 AS group_order, {_ORDER} AS row_order, 'anomaly' AS source, anomaly_id AS source_id, metric_code, dimension_name || '=' || dimension_value AS driver,
               baseline_value, recent_value, absolute_change AS delta, concat_ws(' ', anomaly_id, metric_code, dimension_name, dimension_value, evidence_table) AS text
        FROM anomaly_finding WHERE severity = 'high'
        UNION ALL SELECT 2, 1, 'anomaly', anomaly_id, metric_code, dimension_name || '=' || dimension_value, baseline_value, recent_value, absolute_change,
               concat_ws(' ', anomaly_id, metric_code, dimension_name, dimension_value, evidence_table) FROM target_finding
        UNION ALL SELECT 3, contribution_rank, 'attribution', attribution_id, NULL, dimension_name || '=' || dimension_value, baseline_value, recent_value,
               round(recent_value - baseline_value, 6), concat_ws(' ', attribution_id, dimension_name, dimension_value, ' 回收 vendor_id 出现 AI line_id') FROM attribution_result WHERE contribution_rank <= 5
        UNION ALL SELECT 4, contribution_rank * 100 + item_order, 'process_evidence', attribution_id, metric_code, driver, baseline_value, recent_value, delta,
               concat_ws(' ', attribution_id, driver, metric_code) FROM process_item""",
    "scenario_evidence": """
        SELECT scenario_id, e.* EXCLUDE (text) FROM scenario s JOIN evidence_row e ON contains(text, target_anomaly_id) OR contains(text, keyword)""",
    "strategy_result": """
        SELECT scenario_order, scenario_id, strategy_type, round(b, 6) AS baseline_value,
               round(least(greatest(b + CASE WHEN n > 0 THEN rule_delta ELSE 0 END, 0.0), 1.0), 6)::DOUBLE AS scenario_value,
               CASE WHEN n > 0 THEN rule_delta ELSE 0 END::DOUBLE AS estimated_delta, CASE WHEN n > 0 THEN rule_direction ELSE 'monitor' END AS estimated_direction,
               CASE WHEN n > 0 THEN rule_confidence ELSE 'low' END AS confidence, n AS evidence_count
        FROM (SELECT s.*, (SELECT count(*) FROM scenario_evidence e WHERE e.scenario_id = s.scenario_id) AS n,
                     coalesce((SELECT arg_min(recent_value, group_order * 100000 + row_order) FROM scenario_evidence e WHERE e.scenario_id = s.scenario_id
                               AND s.target_anomaly_id LIKE 'M3B-%' AND e.source_id = s.target_anomaly_id),
                              (SELECT recent_value FROM target_finding), 0.0)::DOUBLE AS b
              FROM scenario s)""",
    "roi_result": """
        SELECT scenario_id, strategy_type, estimated_delta, round(g, 2) AS gross_benefit, round(c, 2) AS action_cost, round(g - c, 2) + 0.0::DOUBLE AS net_benefit,
               CASE WHEN c <> 0 THEN round((g - c) / c, 6) END AS roi_ratio, CASE WHEN g <> 0 THEN round(c / g * 30, 2) END AS payback_period_days
        FROM (SELECT *, CASE strategy_type WHEN 'contact_strategy' THEN 10000 * 0.08::DOUBLE WHEN 'capacity_strategy' THEN 10000 * 0.1::DOUBLE * 8
                     WHEN 'settlement_strategy' THEN g * 0.15::DOUBLE WHEN 'allocation_strategy' THEN 3000 ELSE 2000 END::DOUBLE AS c
              FROM (SELECT *, estimated_delta * 10000 * 500 AS g FROM strategy_result))""",
    "group_item": """
        SELECT *, CASE metric_code WHEN 'ptp_keep_rate' THEN 'ptp_keep' WHEN 'reduction_usage_rate' THEN 'reduction' WHEN 'complaint_rate' THEN 'complaint'
               ELSE 'ai_call' END AS group_code FROM process_item WHERE metric_code <> 'connect_rate'""",
})
ORDER, METRIC_ITEM = _ORDER, _ITEM
