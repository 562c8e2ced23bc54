"""Offline estimates for strategy scenarios, and their return on cost.

Scenarios and rules are a short configured list. Findings and segments are compared with that list in place:
each row emits only the scenarios it supports.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.rates import clip
from duewise.operators.joins import matching_entries
from duewise.plans.anomaly import CHECKS, Detection, counts_with_zeros, find_target
from duewise.plans.attribution import Attribution
from duewise.session import pin

SCENARIO_SCHEMA = (
    "scenario_id string, scenario_name string, strategy_type string, target_metric string, target_anomaly_id string, "
    "target_segments array<struct<dimension:string,value:string>>, expected_direction string, keyword string, "
    "rule_delta double, rule_direction string, rule_confidence string, scenario_order int"
)
SCENARIOS = [  # fixed values, in the order of the schema
    ("increase_ai_call_coverage", "提升 AI 外呼覆盖", "contact_strategy", "recovery_rate_d7",
     "M3A-ai_call_coverage-action_type-AI_OUTBOUND", [("action_type", "AI_OUTBOUND"), ("channel_code", "ECOM")], "improve",
     "ai_call_coverage", 0.006, "improve", "medium", 1),
    ("increase_manual_capacity", "补充人工催收产能", "capacity_strategy", "recovery_rate_d7",
     "M3A-avg_case_per_collector-region-华东", [("region", "华东"), ("line_id", "ALL")], "improve",
     "avg_case_per_collector", 0.004, "reduce_risk", "medium", 2),
    ("adjust_reduction_usage", "调整减免使用策略", "settlement_strategy", "recovery_rate_d7",
     "M3A-reduction_usage_rate-overall-ALL", [("overall", "ALL"), ("dpd_bucket", "M1")], "improve",
     "reduction_usage_rate", 0.003, "improve", "low", 3),
    ("vendor_reallocation", "供应商与作业线资源再分配", "allocation_strategy", "recovery_rate_d7",
     "M3A-m1_recovery_rate-overall-ALL", [("region", "华东"), ("vendor_id", "ALL"), ("line_id", "ALL")], "reduce_risk",
     "region", 0.005, "reduce_risk", "medium", 4),
    ("score_band_D_priority", "D 分客群优先跟进", "segmentation_strategy", "recovery_rate_d7",
     "M3B-recovery_rate_d7-03", [("score_band", "D"), ("dpd_bucket", "M1")], "monitor",
     "score_band=D", 0.002, "monitor", "medium", 5),
]
COSTS = {  # fixed values
    "assumed_case_base": 10_000, "unit_recovery_value": 500, "ai_call_unit_cost": 0.08, "manual_capacity_unit_cost": 8.0,
    "manual_capacity_share": 0.1, "reduction_cost_rate": 0.15, "vendor_reallocation_admin_cost": 3_000,
    "segmentation_priority_admin_cost": 2_000, "payback_window_days": 30,
}
STRATEGY_TYPES = [s[2] for s in SCENARIOS]


def scenario_entries() -> Column:
    return F.array(*(
        F.struct(F.lit(s[0]).alias("scenario_id"), F.lit(s[4]).alias("target_anomaly_id"), F.lit(s[7]).alias("keyword"))
        for s in SCENARIOS
    ))


def check_order() -> Column:
    return F.array_position(F.array(*(F.lit(c.metric_code) for c in CHECKS)), F.col("metric_code"))


class StrategyLab:
    """Findings, drivers and process evidence of one warehouse, and the scenario estimates built on them.

    Findings, drivers and estimates are short result tables, computed when first asked for and pinned,
    because every report reads them.
    """

    def __init__(self, wh, findings: DataFrame | None = None, drivers: DataFrame | None = None) -> None:
        self.wh = wh
        self._given_findings = findings
        self._given_drivers = drivers

    @cached_property
    def findings(self) -> DataFrame:
        return pin(Detection(self.wh).findings if self._given_findings is None else self._given_findings)

    @cached_property
    def target(self) -> DataFrame:
        return find_target(self.findings)

    @cached_property
    def drivers(self) -> DataFrame:
        return pin(Attribution(self.wh).results(self.target) if self._given_drivers is None else self._given_drivers)

    @cached_property
    def estimates(self) -> DataFrame:
        return pin(self.results())

    @property
    def scenarios(self) -> DataFrame:
        return self.wh.spark.createDataFrame(SCENARIOS, SCENARIO_SCHEMA)

    @property
    def top_drivers(self) -> DataFrame:
        return self.drivers.filter(F.col("contribution_rank") <= 5)

    @property
    def process_evidence(self) -> DataFrame:
        """Linked process metrics of the five best drivers, in driver order."""
        linked = self.top_drivers.select(
            "attribution_id", "contribution_rank", F.concat_ws("=", "dimension_name", "dimension_value").alias("driver"),
            F.posexplode(F.filter("evidence", lambda e: e["method"] == "driver_linkage")).alias("item_order", "e"),
        )
        return linked.select(
            "attribution_id", "contribution_rank", "driver", "item_order", "e.metric_code", "e.metric_name_cn",
            "e.baseline_value", "e.recent_value", "e.delta", F.col("e.method").alias("method"),
        )

    @property
    def evidence_rows(self) -> DataFrame:
        """Everything a scenario may lean on, in order: high findings, target, drivers, process evidence."""
        def shape(df: DataFrame, group: int, source: str, source_id: str, driver: Column, delta: str, note: str | None,
                  order: Column, text: list[str]) -> DataFrame:
            metric = F.col("metric_code") if "metric_code" in df.columns else F.lit(None).cast("string")
            return df.select(
                F.lit(group).alias("group_order"), order.cast("long").alias("row_order"), F.lit(source).alias("source"),
                F.col(source_id).alias("source_id"), metric.alias("metric_code"), driver.alias("driver"),
                "baseline_value", "recent_value", F.col(delta).alias("delta"),
                (F.col(note) if note else F.lit(None).cast("string")).alias("note"),
                F.concat_ws(" ", *text).alias("text"),
            )

        label = F.concat_ws("=", "dimension_name", "dimension_value")
        finding_text = [c for c in self.findings.columns if c != "fired"]
        driver_text = ["attribution_id", "dimension_name", "dimension_value", "business_interpretation", "recommended_action", "confidence"]
        high = self.findings.filter(F.col("severity") == "high")
        parts = [
            shape(high, 1, "anomaly", "anomaly_id", label, "absolute_change", "explanation", check_order(), finding_text),
            shape(self.target, 2, "anomaly", "anomaly_id", label, "absolute_change", "explanation", F.lit(1), finding_text),
            shape(self.top_drivers.withColumn("delta", F.round(F.col("recent_value") - F.col("baseline_value"), 6)), 3,
                  "attribution", "attribution_id", label, "delta", "business_interpretation", F.col("contribution_rank"), driver_text),
            shape(self.process_evidence, 4, "process_evidence", "attribution_id", F.col("driver"), "delta", None,
                  F.col("contribution_rank") * 100 + F.col("item_order"), ["attribution_id", "driver", "metric_code", "metric_name_cn", "method"]),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @property
    def evidence(self) -> DataFrame:
        """Per scenario: every row that mentions its target id or its keyword."""
        return self.evidence_rows.withColumn(
            "_hit", F.explode(matching_entries(F.col("text"), scenario_entries(), ["target_anomaly_id", "keyword"]))
        ).select("_hit.scenario_id", *(c for c in self.evidence_rows.columns if c != "text"))

    def results(self) -> DataFrame:
        """Baseline, estimated delta, scenario value, direction and confidence of each scenario."""
        evidence = pin(self.evidence)
        own = evidence.groupBy("scenario_id").agg(
            F.count(F.lit(1)).alias("evidence_count"),
            F.collect_list(F.struct("source", "source_id", "metric_code", "driver", "baseline_value", "recent_value", "delta", "note")).alias("evidence_links"),
            F.max(F.struct("source_id", "recent_value")).alias("_any"),
        )  # findings, drivers and process items of one report: a bounded list
        matched = self.scenarios.select("scenario_id", F.col("target_anomaly_id").alias("source_id")).filter(
            F.col("source_id").startswith("M3B-")
        ).join(evidence, ["scenario_id", "source_id"]).groupBy("scenario_id").agg(
            F.min_by("recent_value", F.struct("group_order", "row_order")).alias("_driver_value")
        )
        target_value = self.target.agg(F.max("recent_value")).scalar()
        rows = self.scenarios.join(own, "scenario_id", "left").join(matched, "scenario_id", "left")
        found = F.coalesce("evidence_count", F.lit(0)) > 0
        rows = rows.withColumns({
            "baseline": F.coalesce("_driver_value", target_value, F.lit(0.0)),
            "estimated_delta": F.when(found, F.col("rule_delta")).otherwise(F.lit(0.0)),
            "estimated_direction": F.when(found, F.col("rule_direction")).otherwise("monitor"),
            "confidence": F.when(found, F.col("rule_confidence")).otherwise("low"),
        })
        return rows.select(
            "scenario_order", "scenario_id", "scenario_name", "strategy_type", "target_metric", "target_anomaly_id",
            F.round("baseline", 6).alias("baseline_value"),
            F.round(clip(F.col("baseline") + F.col("estimated_delta"), 0.0, 1.0), 6).alias("scenario_value"),
            F.round("estimated_delta", 6).alias("estimated_delta"), "estimated_direction", "confidence",
            F.col("target_segments").alias("impacted_segments"),
            F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), "evidence_links",
        )

    def priorities(self, results: DataFrame | None = None) -> DataFrame:
        rows = self.estimates if results is None else results
        return rows.filter(
            F.col("estimated_direction").isin("improve", "reduce_risk") & F.col("confidence").isin("medium", "high")
        ).select("scenario_id", "estimated_direction", "confidence")

    def type_counts(self, results: DataFrame | None = None) -> DataFrame:
        rows = self.estimates if results is None else results
        return counts_with_zeros(rows, "strategy_type", STRATEGY_TYPES, "scenario_count")

    def roi(self, results: DataFrame | None = None, case_base: Column | None = None) -> DataFrame:
        return roi(self.estimates if results is None else results, case_base)


def roi(results: DataFrame, case_base: Column | None = None) -> DataFrame:
    """Benefit, cost, net, ratio and payback of each scenario.

    The case base is the configured constant, or any column or scalar, such as a measured number of cases.
    """
    c = COSTS
    base = F.lit(float(c["assumed_case_base"])) if case_base is None else case_base.cast("double")
    gross = F.col("estimated_delta") * base * F.lit(float(c["unit_recovery_value"]))
    kind = F.col("strategy_type")
    cost = (
        F.when(kind == "contact_strategy", base * c["ai_call_unit_cost"])
        .when(kind == "capacity_strategy", base * c["manual_capacity_share"] * c["manual_capacity_unit_cost"])
        .when(kind == "settlement_strategy", gross * c["reduction_cost_rate"])
        .when(kind == "allocation_strategy", float(c["vendor_reallocation_admin_cost"]))
        .when(kind == "segmentation_strategy", float(c["segmentation_priority_admin_cost"]))
        .otherwise(0.0)
    )
    formula = (
        F.when(kind == "contact_strategy", "assumed_case_base × ai_call_unit_cost")
        .when(kind == "capacity_strategy", "assumed_case_base × 0.1 × manual_capacity_unit_cost")
        .when(kind == "settlement_strategy", "gross_benefit × reduction_cost_rate")
        .when(kind == "allocation_strategy", "vendor_reallocation_admin_cost")
        .when(kind == "segmentation_strategy", "segmentation_priority_admin_cost")
        .otherwise("unknown_strategy_type")
    )
    rows = results.withColumns({"_gross": gross, "_cost": cost, "_base": base})
    g, k = F.col("_gross"), F.col("_cost")
    return rows.select(
        "scenario_id", "scenario_name", "strategy_type", "target_metric", "estimated_delta",
        F.col("_base").cast("long").alias("assumed_case_base"), F.lit(c["unit_recovery_value"]).alias("unit_recovery_value"),
        F.round(g, 2).alias("gross_benefit"), F.round(k, 2).alias("action_cost"), F.round(g - k, 2).alias("net_benefit"),
        F.round(F.when(k != 0, (g - k) / k), 6).alias("roi_ratio"),
        F.round(F.when(g != 0, k / g * c["payback_window_days"]), 2).alias("payback_period_days"),
        formula.alias("cost_formula"), F.lit("estimated_delta × assumed_case_base × unit_recovery_value").alias("benefit_formula"),
    )


def roi_summary(rows: DataFrame) -> DataFrame:
    """One row: scenario count, positive ratios, and the scenario with the highest ratio (missing last)."""
    return rows.agg(
        F.count(F.lit(1)).alias("scenario_count"), F.count_if(F.col("roi_ratio") > 0).alias("positive_roi_count"),
        F.max(F.when(F.col("roi_ratio").isNotNull(), F.struct("roi_ratio", "scenario_id", "scenario_name", "strategy_type"))).alias("_top"),
    ).select(
        "scenario_count", "positive_roi_count", F.col("_top.scenario_id").alias("top_scenario_id"),
        F.col("_top.scenario_name").alias("top_scenario_name"), F.col("_top.strategy_type").alias("top_strategy_type"),
        F.col("_top.roi_ratio").alias("top_roi_ratio"),
    )
