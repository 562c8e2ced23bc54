"""Datasets behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.operators.ordering import exact_median
from duewise.operators.windows import last_days, latest_partition, max_date
from duewise.plans.strategy import StrategyLab

FUNNEL = ["分案数", "首次触达覆盖率", "接通率", "有效沟通率", "PTP履约率"]  # fixed values
BUCKET_ORDER = ["CURRENT", "M0", "M1", "M2", "M3", "M4", "M5", "M6+"]  # fixed values
RISK_RATES = ["complaint_rate", "risk_phrase_hit_rate", "qa_fail_rate", "over_frequency_contact_rate"]  # fixed values


def share(num: Column, den: Column) -> Column:
    """num / den, 0 when den is zero."""
    return F.when(den != 0, num / den).otherwise(0.0)


def collection_funnel(wh, days: int = 30) -> DataFrame:
    """Means over the last days of five daily conversion rates."""
    daily = last_days(wh["dws_collection_process_wide_di"], days).groupBy("stat_date").agg(
        F.countDistinct("case_id").alias("assigned"), F.count_if(F.col("action_count") > 0).alias("touched"),
        F.sum("action_count").alias("actions"), F.sum("connected_count").alias("connected"),
        F.sum("ptp_count").alias("promised"), F.sum("ptp_fulfilled_count").alias("kept"),
    )
    c = F.col
    rates = [F.lit(1.0), share(c("touched"), c("assigned")), share(c("connected"), c("actions")),
             share(c("promised"), c("connected")), share(c("kept"), c("promised"))]
    means = daily.agg(F.array(*(
        F.struct(F.lit(i).alias("step_order"), F.lit(name).alias("step"), F.avg(rate).alias("rate"))
        for i, (name, rate) in enumerate(zip(FUNNEL, rates), start=1)
    )).alias("rows"))
    return means.select(F.inline("rows"))


def waterfall(lab: StrategyLab, limit: int = 5) -> DataFrame:
    """Best drivers with signed contributions: negative when the leading driver's value fell."""
    rows = lab.drivers.filter(F.col("contribution_rank") <= limit)
    first = rows.filter(F.col("contribution_rank") == 1)
    delta = F.coalesce(first.agg(F.max(F.col("recent_value") - F.coalesce("baseline_value", F.lit(0.0)))).scalar(), F.lit(0.0))
    score = F.coalesce("contribution_score", F.lit(0.0))
    return rows.select(
        "contribution_rank", F.concat_ws("=", "dimension_name", "dimension_value").alias("label"),
        F.when((delta < 0) & (score >= 0), -F.abs(score)).otherwise(score).alias("contribution"),
    )


def vendor_matrix(wh) -> DataFrame:
    """Newest day per vendor: connect rate against complaint rate, with marker sizes from 18 to 70."""
    latest = latest_partition(wh["ads_vendor_performance_di"])
    largest = latest.agg(F.max("action_count")).scalar()
    size = F.when(largest > 0, 18 + F.col("action_count") / largest * 52).otherwise(28.0)
    return latest.select(
        "vendor_id", F.col("connect_rate").alias("x"), F.col("complaint_rate").alias("y"), F.round(size, 6).alias("marker_size")
    )


def capacity_heatmap(wh, days: int = 30) -> DataFrame:
    """Mean cases per collector for every line and day of the last days, zero where a line has no value.

    Kept long: one row per cell, so lines and days may grow without widening the schema.
    """
    recent = last_days(wh["dws_vendor_line_capacity_di"], days)
    cells = recent.groupBy("line_id", "stat_date").agg(F.avg("case_per_collector").alias("case_per_collector"))
    newest = max_date(wh["dws_vendor_line_capacity_di"])
    dates = F.sequence(F.date_sub(newest, days - 1), newest)
    # A day on which no line has a value is no column of the heat map.
    seen = recent.select("stat_date").distinct()
    grid = recent.select("line_id").distinct().select("line_id", F.explode(dates).alias("stat_date")).join(
        seen, "stat_date", "left_semi"
    )
    return grid.join(cells, ["line_id", "stat_date"], "left").select(
        "line_id", F.date_format("stat_date", "yyyy-MM-dd").alias("day"),
        F.coalesce("case_per_collector", F.lit(0.0)).alias("case_per_collector"),
    )


def heatmap_pivot(wh, days: int = 7) -> DataFrame:
    """The heat map as a wide table, one column per day back from the newest (``d0`` is the newest)."""
    newest = max_date(wh["dws_vendor_line_capacity_di"])
    recent = last_days(wh["dws_vendor_line_capacity_di"], days).withColumn("back", F.concat(F.lit("d"), F.datediff(newest, "stat_date")))
    names = [f"d{i}" for i in range(days)]
    return recent.groupBy("line_id").pivot("back", names).agg(F.avg("case_per_collector")).na.fill(0.0, names)


def dpd_structure(wh) -> DataFrame:
    """Bucket counts and shares on the newest day and on the last day at least 30 days earlier."""
    rows = wh["dws_loan_status_snapshot_di"].select("stat_date", "dpd_bucket").dropna(subset=["stat_date"])
    newest = max_date(rows)
    dates = rows.agg(
        F.max(F.when(F.col("stat_date") <= F.date_sub(newest, 30), F.col("stat_date"))).alias("earlier"), F.min("stat_date").alias("first")
    ).select(F.coalesce("earlier", "first").alias("d")).scalar()
    current, before = F.col("stat_date") == newest, F.col("stat_date") == dates
    counted = rows.filter(current | before).groupBy("dpd_bucket").agg(
        F.count_if(current).alias("current_count"), F.count_if(before).alias("baseline_count")
    )
    totals = counted.agg(F.sum("current_count").alias("c"), F.sum("baseline_count").alias("b"))
    place = F.array_position(F.array(*(F.lit(b) for b in BUCKET_ORDER)), F.col("dpd_bucket"))
    return counted.select(
        "dpd_bucket", F.when(place > 0, place).otherwise(F.lit(len(BUCKET_ORDER) + 1)).cast("int").alias("bucket_order"),
        "current_count", "baseline_count",
        share(F.col("current_count"), totals.select("c").scalar()).alias("current_share"),
        share(F.col("baseline_count"), totals.select("b").scalar()).alias("baseline_share"),
    )


def reduction_series(wh) -> DataFrame:
    return wh["ads_reduction_roi_di"].orderBy("stat_date").select(
        F.date_format("stat_date", "yyyy-MM-dd").alias("day"), "approved_reduction_amount", "reduction_roi"
    )


def complaint_risk(df: DataFrame, group: str) -> DataFrame:
    """Sum of the risk rates on the newest day, mean per group, flagged at or above the median and above zero."""
    latest = latest_partition(df)
    rates = [c for c in RISK_RATES if c in df.columns]
    score = sum((F.coalesce(c, F.lit(0.0)) for c in rates), F.lit(0.0))
    grouped = latest.groupBy(group).agg(F.avg(score).alias("risk_score"))
    middle = exact_median(grouped, "risk_score").scalar()
    return grouped.select(
        group, F.round("risk_score", 6).alias("risk_score"),
        ((F.col("risk_score") >= middle) & (F.col("risk_score") > 0)).alias("flagged"),
    )


def finding_strength(lab: StrategyLab) -> DataFrame:
    return lab.findings.filter((F.col("severity") == "high") & F.col("relative_change").isNotNull()).select(
        F.coalesce("metric_name_cn", "metric_code").alias("label"), "dimension_value", "relative_change", "severity"
    )


def top_contributions(lab: StrategyLab) -> DataFrame:
    return lab.top_drivers.select(
        "contribution_rank", F.concat_ws("=", "dimension_name", "dimension_value").alias("label"), "contribution_score"
    )


def roi_comparison(roi_rows: DataFrame) -> DataFrame:
    return roi_rows.filter(F.col("roi_ratio").isNotNull() & F.col("scenario_id").isNotNull()).select(
        "scenario_id", F.col("action_cost").alias("cost"), F.col("gross_benefit").alias("benefit"), "roi_ratio"
    )
