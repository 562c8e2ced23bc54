"""Forbidden-phrase scans over whole text tables, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.text import VIOLATION_WORDS, compat_form, dictionary_entries, needs_compat, risk_level, violations
from duewise.operators.windows import latest_partition
from duewise.plans.anomaly import counts_with_zeros

LEVELS = ["clean", "medium", "high"]  # fixed values
RULE_DIMENSIONS = [  # fixed values
    "威胁恐吓", "冒充司法", "骚扰第三方", "诱导新贷", "辱骂侮辱", "隐私保护", "频次边界", "身份表述", "协商导向", "时段合规", "人工复核",
]
SCORE_DIMENSIONS = [  # fixed values
    "开场身份说明", "账单事实说明", "金额与日期说明", "客户异议识别", "还款方案引导", "情绪控制", "催收强度", "合规红线", "投诉风险",
    "PTP确认", "结束语规范",
]
RED_LINE, COMPLAINT_RISK = "合规红线", "投诉风险"
NEUTRAL = 70  # fixed value
AXES = {  # fixed values: radar axis, names under which a score row may carry it
    "合规性": ["合规性", "合规", "合规红线", "overall_compliance_score", "compliance_score"],
    "强度": ["强度", "催收强度", "pressure_score", "intensity_score"],
    "清晰度": ["清晰度", "清晰", "账单事实说明", "金额与日期说明", "clarity_score"],
    "同理": ["同理", "同理心", "情绪控制", "客户异议识别", "empathy_score"],
    "完整": ["完整", "完整性", "开场身份说明", "PTP确认", "结束语规范", "completeness_score"],
    "流程": ["流程", "流程规范", "还款方案引导", "PTP确认", "process_score"],
}


def scan(df: DataFrame, text: str = "text", words: dict[str, list[str]] | None = None) -> DataFrame:
    """Add text length, violations (position, category, keyword), their count and the risk level.

    The whole text of every row is scanned on the JVM; Python only sees non-ASCII texts, and only to bring
    full-width and similar characters to their plain form.
    """
    entries = dictionary_entries(VIOLATION_WORDS if words is None else words)
    source = F.coalesce(F.col(text), F.lit(""))
    formed = df.withColumn("_form", compat_form(needs_compat(source)))
    plain = F.coalesce(F.col("_form.text"), source)
    scanned = formed.withColumn("violations", violations(plain, F.col("_form.origin"), entries)).drop("_form")
    return scanned.withColumns({
        "text_length": F.length(source), "violation_count": F.size("violations"),
    }).withColumn("risk_level", risk_level("violation_count")).withColumn(
        "summary",
        F.when(F.col("violation_count") == 0, "未发现违规关键词，风险等级 clean。").otherwise(
            F.format_string("发现 %d 个违规关键词，风险等级 %s。", "violation_count", "risk_level")
        ),
    )


def level_summary(scanned: DataFrame) -> DataFrame:
    return counts_with_zeros(scanned, "risk_level", LEVELS, "text_count")


def rule_score(scanned: DataFrame) -> DataFrame:
    """100 for clean text, 30 for high risk, otherwise 90 less 15 per hit but at least 60."""
    n = F.col("violation_count")
    score = F.when(n == 0, 100).when(F.col("risk_level") == "high", 30).otherwise(F.greatest(F.lit(60), 90 - n * 15))
    return scanned.withColumn("score", score)


def rule_dimensions(scanned: DataFrame, keys: list[str], dimensions: list[str] | None = None) -> DataFrame:
    """One row per text and named dimension: 100, or 30 when a hit falls in it."""
    hit = F.array_distinct(F.transform("violations", lambda v: v["category"]))
    names = F.array(*(F.lit(d) for d in (RULE_DIMENSIONS if dimensions is None else dimensions)))
    return scanned.withColumn("_hit", hit).select(*keys, "_hit", F.explode(names).alias("dimension")).select(
        *keys, "dimension", F.when(F.array_contains("_hit", F.col("dimension")), 30).otherwise(100).alias("score")
    )


def neutral_scores() -> Column:
    return F.map_from_arrays(
        F.array(*(F.lit(d) for d in SCORE_DIMENSIONS)), F.array(*(F.lit(NEUTRAL) for _ in SCORE_DIMENSIONS))
    )


def merge_scores(scanned: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Outside scores tightened by the scan; rows without a score get neutral ones.

    ``scores``: keys, dimensions MAP, overall_compliance_score, supervisor_review_required. Any hit pushes the
    red line down to 20 - 10 n and complaint risk up to 60 + 10 n and asks for review; the overall score is
    capped at 65 for medium and 30 for high risk.
    """
    joined = scanned.join(scores, keys, "left")
    n = F.col("violation_count")
    dims = F.coalesce("dimensions", neutral_scores())
    red = F.least(F.coalesce(F.element_at(dims, RED_LINE), F.lit(100)), F.greatest(F.lit(0), 20 - n * 10))
    risk = F.greatest(F.coalesce(F.element_at(dims, COMPLAINT_RISK), F.lit(0)), 60 + n * 10)
    others = F.map_filter(dims, lambda k, _: ~k.isin(RED_LINE, COMPLAINT_RISK))
    tightened = F.map_concat(others, F.create_map(F.lit(RED_LINE), red, F.lit(COMPLAINT_RISK), risk))
    overall = F.coalesce("overall_compliance_score", F.lit(NEUTRAL))
    cap = F.when(F.col("risk_level") == "high", 30).when(F.col("risk_level") == "medium", 65)
    return joined.withColumns({
        "dimensions": F.when(n > 0, tightened).otherwise(dims),
        "overall_compliance_score": F.when(cap.isNotNull(), F.least(overall, cap)).otherwise(overall),
        "supervisor_review_required": F.coalesce("supervisor_review_required", F.lit(False)) | (n > 0),
        "scored": F.col("overall_compliance_score").isNotNull(),
        "keyword_risk_level": F.col("risk_level"),
    })


def quality_axes(rows: DataFrame, dimensions: str = "dimensions", date: str | None = "stat_date") -> DataFrame:
    """Mean per radar axis over the newest date: per row the mean of the aliases it has, then over rows."""
    latest = latest_partition(rows, date) if date else rows

    def axis_value(aliases: list[str]) -> Column:
        present = F.filter(F.array(*(F.element_at(F.col(dimensions), a).cast("double") for a in aliases)), lambda v: v.isNotNull())
        return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present))

    means = latest.agg(F.array(*(
        F.struct(F.lit(axis).alias("axis"), F.avg(axis_value(aliases)).alias("score")) for axis, aliases in AXES.items()
    )).alias("rows"))
    return means.select(F.inline("rows"))
