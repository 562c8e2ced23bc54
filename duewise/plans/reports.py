"""Datasets behind the reports; rendering is left to the reader's own tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.text import magnitude
from duewise.operators.ordering import dedupe
from duewise.operators.windows import latest_partition
from duewise.plans.anomaly import BY_CODE, severity_counts
from duewise.plans.strategy import StrategyLab, check_order, roi_summary

EPSILON = 1e-9
EVIDENCE_GROUPS = {  # fixed values: metric code to group
    "ptp_keep_rate": "ptp_keep", "ai_call_coverage": "ai_call", "manual_call_coverage": "ai_call",
    "reduction_usage_rate": "reduction", "complaint_rate": "complaint",
}
CHAINS = [  # fixed values: chain, group, tone when the mean rises
    ("contact", "ai_call", "positive"), ("fulfill", "ptp_keep", "positive"), ("tool", "reduction", "positive"),
    ("compliance", "complaint", "negative"),
]
DRIVER_ROLES = {  # fixed values
    "channel_code": "渠道结构", "province": "区域结构", "score_band": "客群风险结构", "risk_level": "客群风险结构",
    "balance_segment": "余额结构", "vendor_id": "供应商", "line_id": "线路", "dpd_bucket": "逾期阶段",
}
DEFAULT_ROLE = "维度切片"  # fixed value
DRIVER_LABELS = [  # fixed values: dimension, value, meaning
    ("channel_code", "ECOM", "ECOM 代表电商渠道来源客群。该分组最近窗口 D7 回收率明显低于基线，说明问题可能集中在渠道客群质量、分案策略或触达资源匹配上。"),
    ("province", "山东", "山东分组回收率下降，提示区域客群、供应商执行或本地作业线排布可能出现同步变化。"),
    ("province", "上海", "上海分组回收率下降，可能与区域客群结构、触达资源切换或供应商执行节奏有关。"),
    ("score_band", "D", "D 分客群通常代表更高风险层。该层回收率下降会直接放大 M1 早期回收压力。"),
    ("score_band", "A", "A 分客群通常是较优风险层。该层也出现下降，说明问题可能不只发生在高风险客群，需关注流程或资源侧变化。"),
]
DEFAULT_MEANING = " 分组回收表现低于基线，是需要下钻验证的业务切片。"  # fixed value
REPORTED_PROCESS = ["ai_call_coverage", "ptp_keep_rate", "reduction_usage_rate", "complaint_rate"]  # fixed values
REPORTED_FINDINGS = [  # fixed values
    "ai_call_coverage", "ptp_keep_rate", "reduction_usage_rate", "complaint_per_10k_cases", "avg_case_per_collector"
]
CAPACITY_METRIC = "avg_case_per_collector"
TOTAL = "合计"  # fixed value


def value_of(column: str, pairs: dict[str, str], default: str | None) -> Column:
    out = None
    for key, label in pairs.items():
        hit = F.col(column) == key
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


# --------------------------------------------------------------------------- summary


def overview(lab: StrategyLab) -> DataFrame:
    """One row: finding counts by severity and the compared windows."""
    counts = severity_counts(lab.findings).agg(*(
        F.max(F.when(F.col("severity") == s, F.col("finding_count"))).alias(f"{s}_count") for s in ("high", "medium", "low")
    ))
    windows = lab.findings.agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.min_by("baseline_window", check_order()).alias("baseline_window"),
        F.min_by("recent_window", check_order()).alias("recent_window"),
    )
    return windows.withColumns({c: counts.select(c).scalar() for c in counts.columns})


def high_priority(lab: StrategyLab) -> DataFrame:
    return lab.findings.filter(F.col("severity") == "high")


def target_summary(lab: StrategyLab) -> DataFrame:
    """The explained finding, and whether it is already among the high-priority ones."""
    return lab.target.withColumn("visible_in_high_priority", F.col("severity") == "high")


def recommendations(lab: StrategyLab) -> DataFrame:
    """Distinct recommended actions: drivers first, then high findings; the first source of a text is kept."""
    label = F.concat_ws("=", "dimension_name", "dimension_value")
    from_drivers = lab.top_drivers.select(
        F.lit(1).alias("_group"), F.col("contribution_rank").cast("long").alias("_order"), F.lit("attribution").alias("source"),
        F.col("attribution_id").alias("source_id"), label.alias("driver"), F.col("recommended_action").alias("recommendation"),
    )
    from_findings = high_priority(lab).select(
        F.lit(2).alias("_group"), check_order().alias("_order"), F.lit("anomaly").alias("source"),
        F.col("anomaly_id").alias("source_id"), F.concat(F.col("metric_code"), F.lit(":"), label).alias("driver"),
        F.col("recommended_next_step").alias("recommendation"),
    )
    rows = from_drivers.unionByName(from_findings).filter(F.coalesce("recommendation", F.lit("")) != "")
    return dedupe(rows, ["recommendation"], ["_group", "_order", "source_id"])


def next_steps(lab: StrategyLab, limit: int = 8) -> DataFrame:
    return recommendations(lab).orderBy("_group", "_order", "source_id").limit(limit).select(
        "source", "source_id", F.col("recommendation").alias("next_step")
    )


# --------------------------------------------------------------------------- evidence


def evidence_groups(lab: StrategyLab) -> DataFrame:
    """Process evidence with its group; metrics outside the groups are left out."""
    return lab.process_evidence.withColumn("group_code", value_of("metric_code", EVIDENCE_GROUPS, None)).filter(
        F.col("group_code").isNotNull()
    )


def evidence_chains(lab: StrategyLab) -> DataFrame:
    """Tone and strongest entry per process chain, and the capacity chain from the findings."""
    strongest = F.struct(F.abs("delta"), -F.col("contribution_rank"), -F.col("item_order"))
    by_group = evidence_groups(lab).groupBy("group_code").agg(
        F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("_largest"), F.max_by("driver", strongest).alias("highlight_driver"),
        F.max_by("metric_code", strongest).alias("highlight_metric"), F.max_by("delta", strongest).alias("highlight_delta"),
    )
    chains = lab.wh.spark.createDataFrame(CHAINS, "chain_code string, group_code string, rise_tone string")
    rows = chains.join(by_group, "group_code", "left")
    moved = F.coalesce(F.col("_largest") >= EPSILON, F.lit(False))
    rising = F.when(F.col("mean_delta") > 0, F.col("rise_tone"))
    # Drops are bad where rises are good, and the other way round; a zero mean counts as the good side.
    falling = F.when(F.col("rise_tone") == "positive", F.when(F.col("mean_delta") < 0, "negative").otherwise("positive")).otherwise("positive")
    process = rows.select(
        "chain_code", F.when(moved, F.coalesce(rising, falling)).otherwise("neutral").alias("tone"),
        *(F.when(moved, F.col(c)).alias(c) for c in ("highlight_driver", "highlight_metric", "highlight_delta")),
    )
    signal = high_priority(lab).filter(F.col("metric_code") == CAPACITY_METRIC).orderBy("dimension_value").limit(1)
    capacity = signal.agg(
        F.lit("capacity").alias("chain_code"),
        F.coalesce(F.max(F.when(F.col("relative_change") > 0, "negative").otherwise("positive")), F.lit("neutral")).alias("tone"),
        F.max(F.concat_ws("=", "dimension_name", "dimension_value")).alias("highlight_driver"),
        F.max("metric_code").alias("highlight_metric"), F.max("absolute_change").alias("highlight_delta"),
    )
    return process.unionByName(capacity)


def movements(lab: StrategyLab) -> DataFrame:
    """Direction of the mean change per evidence group (near zero is skipped), plus a capacity flag row."""
    means = evidence_groups(lab).groupBy("group_code").agg(F.avg("delta").alias("mean_delta")).filter(F.abs("mean_delta") >= EPSILON)
    groups = means.select("group_code", F.when(F.col("mean_delta") < 0, "down").otherwise("up").alias("direction"))
    pressed = high_priority(lab).filter((F.col("metric_code") == CAPACITY_METRIC) & (F.col("relative_change") > 0)).limit(1)
    return groups.unionByName(pressed.select(F.lit("capacity").alias("group_code"), F.lit("up").alias("direction")))


def driver_progress(lab: StrategyLab) -> DataFrame:
    """Score of each driver as percent of the best score, with the role of its dimension."""
    best = lab.drivers.agg(F.max("contribution_score")).scalar()
    share = F.when(best > 0, F.col("contribution_score") / best * 100).otherwise(0.0)
    return lab.drivers.select(
        "attribution_id", "contribution_rank", "dimension_name", "dimension_value", "contribution_score",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)), 4).alias("progress_pct"),
        value_of("dimension_name", DRIVER_ROLES, DEFAULT_ROLE).alias("driver_role"),
    )


def driver_context(lab: StrategyLab) -> DataFrame:
    labels = lab.wh.spark.createDataFrame(DRIVER_LABELS, "dimension_name string, dimension_value string, label string")
    fallback = F.concat(F.col("dimension_name"), F.lit("="), F.col("dimension_value"), F.lit(DEFAULT_MEANING))
    return lab.top_drivers.join(F.broadcast(labels), ["dimension_name", "dimension_value"], "left").select(
        F.col("contribution_rank").alias("rank"), "dimension_name", "dimension_value", "baseline_value", "recent_value",
        "contribution_score", "confidence", F.coalesce("label", fallback).alias("meaning"),
    )


def process_rows(lab: StrategyLab) -> DataFrame:
    """Moved process metrics and process-type findings, once per (metric, driver, recent value)."""
    from_drivers = lab.process_evidence.filter(
        F.col("metric_code").isin(REPORTED_PROCESS) & (F.abs("delta") >= 0.000001)
    ).select(
        F.lit(1).alias("_group"), (F.col("contribution_rank") * 100 + F.col("item_order")).cast("long").alias("_order"), "metric_code",
        "driver", "baseline_value", "recent_value", "delta",
    )
    from_findings = high_priority(lab).filter(F.col("metric_code").isin(REPORTED_FINDINGS)).select(
        F.lit(2).alias("_group"), check_order().alias("_order"), "metric_code",
        F.concat_ws("=", "dimension_name", "dimension_value").alias("driver"), "baseline_value", "recent_value",
        F.col("absolute_change").alias("delta"),
    )
    rows = dedupe(from_drivers.unionByName(from_findings), ["metric_code", "driver", "recent_value"], ["_group", "_order"])
    return rows.drop("_group", "_order")


# --------------------------------------------------------------------------- sheets


def finding_sheet(lab: StrategyLab) -> DataFrame:
    return high_priority(lab).select(
        "metric_code", "metric_name_cn", "dimension_value", "recent_value", "baseline_value", "relative_change", "severity"
    )


def driver_sheet(lab: StrategyLab) -> DataFrame:
    return lab.top_drivers.select("dimension_name", "dimension_value", "contribution_score", "recommended_action")


def roi_sheet(roi_rows: DataFrame) -> DataFrame:
    return roi_rows.select(
        "scenario_id", "roi_ratio", "action_cost", "gross_benefit", F.round(F.col("payback_period_days") / 30, 4).alias("payback_months")
    )


def roi_block(roi_rows: DataFrame) -> DataFrame:
    """Scenario rows with display text, next to the counts and the best scenario."""
    summary = roi_summary(roi_rows)
    return roi_rows.select(
        "scenario_id", "strategy_type", "estimated_delta", magnitude("estimated_delta", signed=True).alias("estimated_delta_display"),
        "gross_benefit", "action_cost", "net_benefit", "roi_ratio", "payback_period_days",
        *(summary.select(c).scalar().alias(c) for c in ("scenario_count", "positive_roi_count", "top_scenario_id", "top_roi_ratio")),
    )


def case_sheet(wh, size: int | None = None) -> DataFrame:
    """The cases on the newest day, with the class of the last action and outcome; ``size`` takes the first by id only."""
    status = latest_partition(wh["dws_case_status_snapshot_di"])
    status = status if size is None else status.orderBy("case_id").limit(size)
    case = dedupe(wh["dim_case"].select("case_id", "balance_segment"), ["case_id"], ["balance_segment"])
    place = dedupe(
        latest_partition(wh["dws_vendor_line_capacity_di"]).select("vendor_id", "line_id", "region"), ["vendor_id", "line_id"], ["region"]
    )
    counts = ["action_count", "ai_action_count", "connected_count", "ptp_count", "ptp_fulfilled_count"]
    process = dedupe(
        latest_partition(wh["dws_collection_process_wide_di"]).select("case_id", "collector_id", *counts), ["case_id"], ["collector_id"]
    ).select("case_id", *(F.col(c).alias(f"_p_{c}") for c in counts))
    rows = status.join(case, "case_id", "left").join(place, ["vendor_id", "line_id"], "left").join(process, "case_id", "left")
    rows = rows.withColumns({c: F.coalesce(f"_p_{c}", F.lit(0)) for c in counts})
    action = F.when(F.col("action_count") <= 0, "NO_ACTION").when(F.col("ai_action_count") > 0, "AI_ACTION").otherwise("MANUAL_ACTION")
    outcome = (
        F.when(F.col("ptp_fulfilled_count") > 0, "PTP_FULFILLED").when(F.col("ptp_count") > 0, "PTP")
        .when(F.col("connected_count") > 0, "CONNECTED").when(F.col("action_count") > 0, "NOT_CONNECTED").otherwise("NO_ACTION")
    )
    return rows.select(
        "case_id", "dpd_bucket", "outstanding_amount", "balance_segment", "region", "vendor_id", "line_id",
        action.alias("last_action_type"), outcome.alias("last_outcome"),
    )


def vendor_region_pivot(wh) -> DataFrame:
    """Recovery proxy per vendor and region, with row, column and grand totals from one cube."""
    vendor = wh["ads_vendor_performance_di"].groupBy("vendor_id").agg(
        (F.avg("ptp_rate") * F.avg("ptp_keep_rate")).alias("recovery_rate")
    )
    pairs = latest_partition(wh["dws_vendor_line_capacity_di"]).select("vendor_id", "region").dropna().distinct()
    rows = pairs.join(vendor, "vendor_id", "left")
    return rows.cube("vendor_id", "region").agg(F.sum("recovery_rate").alias("recovery_rate")).select(
        F.coalesce("vendor_id", F.lit(TOTAL)).alias("vendor_id"), F.coalesce("region", F.lit(TOTAL)).alias("region"), "recovery_rate"
    )


def briefing(lab: StrategyLab, roi_rows: DataFrame, results: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One row of facts: what happened, the main driver, the best scenario, and model quality when given."""
    best = roi_summary(roi_rows)
    first = lab.drivers.filter(F.col("contribution_rank") == 1)
    chosen = results.filter(F.col("scenario_id") == best.select("top_scenario_id").scalar())
    row = overview(lab).withColumns({
        "target_metric": F.coalesce(lab.target.agg(F.max("metric_code")).scalar(), F.lit("recovery_rate_d7")),
        "target_relative_change": lab.target.agg(F.max("relative_change")).scalar(),
        "primary_dimension": first.agg(F.max("dimension_name")).scalar(),
        "primary_value": first.agg(F.max("dimension_value")).scalar(),
        "top_scenario_id": F.coalesce(best.select("top_scenario_id").scalar(), F.lit("none")),
        "top_estimated_delta": chosen.agg(F.max("estimated_delta")).scalar(),
        "top_roi_ratio": best.select("top_roi_ratio").scalar(),
        "positive_roi_count": best.select("positive_roi_count").scalar(),
    })
    if model is None:
        return row
    return row.withColumns({f"model_{c}": model.agg(F.max(c)).scalar() for c in ("auc", "ks", "pr_auc")})


assert set(REPORTED_FINDINGS) - {"complaint_per_10k_cases"} <= set(BY_CODE)
