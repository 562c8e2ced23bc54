"""The ten read-only query tools and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.rates import clip, safe_rate, steady_round
from duewise.operators.ordering import dedupe, latest_per_key
from duewise.operators.windows import date_range, last_days, max_date
from duewise.schemas import without_personal_fields
from duewise.sources.tables import profile

SEGMENT_COLUMNS = ("channel_code", "province", "risk_level", "product_code", "score_band")  # fixed values
PROCESS_SEGMENTS = ("channel_code", "product_code", "province", "risk_level", "vendor_id", "line_id", "collector_id")
UNKNOWN = "UNKNOWN"


@dataclass
class ToolResult:
    """What a tool answers: all rows and a note. A ``cap`` for display is the caller's to set; there is none by default."""

    tool: str
    params: dict[str, Any]
    frame: DataFrame
    cap: int | None = None
    order: tuple[str, ...] = ()
    note: str = ""

    @property
    def row_count(self) -> int:
        return self.frame.count()

    @property
    def shown(self) -> DataFrame:
        out = self.frame.orderBy(*self.order) if self.order else self.frame
        return out.limit(self.cap) if self.cap is not None else out


def empty(wh, schema: str) -> DataFrame:
    return wh.spark.createDataFrame([], schema)


def segment_fact(wh) -> DataFrame:
    """M1 loan-days with the five segment columns, missing values as UNKNOWN."""
    loan = wh["dws_loan_status_snapshot_di"].filter(F.col("dpd_bucket") == "M1")
    channel = dedupe(wh["dim_loan"].select("loan_id", "channel_code"), ["loan_id"], ["channel_code"])
    customer = dedupe(
        wh["dim_customer"].select("customer_id", "province", F.col("risk_level_current").alias("risk_level")),
        ["customer_id"], ["province", "risk_level"],
    )
    score = latest_per_key(
        wh["ods_postloan_c_score"].select("customer_id", "score_date", "score_id", "score_level"),
        ["customer_id"], "score_date", ["score_id"],
    ).select("customer_id", F.col("score_level").alias("score_band"))
    joined = loan.join(channel, "loan_id", "left").join(customer, "customer_id", "left").join(score, "customer_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in SEGMENT_COLUMNS})


def process_fact(wh) -> DataFrame:
    """Process rows with loan and customer attributes of the case; several loans per case: the first by id."""
    case = dedupe(wh["dim_case"].select("case_id", "customer_id"), ["case_id"], ["customer_id"])
    loan_of_case = dedupe(wh["dim_case_loan_mapping"].select("case_id", "loan_id"), ["case_id"], ["loan_id"])
    loan = dedupe(wh["dim_loan"].select("loan_id", "channel_code", "product_code"), ["loan_id"], ["product_code"])
    customer = dedupe(
        wh["dim_customer"].select("customer_id", "province", F.col("risk_level_current").alias("risk_level")),
        ["customer_id"], ["province", "risk_level"],
    )
    attributes = (
        case.join(loan_of_case, "case_id", "left").join(loan, "loan_id", "left").join(customer, "customer_id", "left")
    )
    joined = wh["dws_collection_process_wide_di"].join(attributes, "case_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in PROCESS_SEGMENTS})


def recovery_by(fact: DataFrame, keys: list[str]) -> DataFrame:
    return fact.groupBy(*keys).agg(
        F.sum("due_amount").alias("due_amount"), F.sum("repaid_amount_d7").alias("repaid_amount_d7"),
        F.countDistinct("loan_id").alias("loan_count"),
    ).select(
        *keys, safe_rate("repaid_amount_d7", "due_amount", clipped=False).alias("recovery_rate_d7"), "due_amount",
        "repaid_amount_d7", "loan_count",
    )


def recovery_rate(
    wh, segment_col: str | None = None, segment_val: str | None = None, date_start: str | None = None,
    date_end: str | None = None,
) -> ToolResult:
    """D7 recovery per day over all buckets, or per day and segment over M1 loans only."""
    params = {"segment_col": segment_col, "segment_val": segment_val, "date_start": date_start, "date_end": date_end}
    if not segment_col:
        board = date_range(wh["ads_postloan_dashboard_di"], date_start, date_end).select("stat_date", "recovery_rate_d7")
        return ToolResult("query_recovery_rate", params, board, order=("stat_date",))
    if segment_col not in SEGMENT_COLUMNS:
        return ToolResult("query_recovery_rate", params, empty(wh, "stat_date date, recovery_rate_d7 double"), note="unsupported segment")
    fact = date_range(segment_fact(wh), date_start, date_end)
    if segment_val is not None:
        fact = fact.filter(F.col(segment_col) == str(segment_val))
    keys = ["stat_date", segment_col]
    return ToolResult("query_recovery_rate", params, recovery_by(fact, keys), order=tuple(keys))


def anomalies(wh, severity: str | None = None, metric_code: str | None = None, findings: DataFrame | None = None) -> ToolResult:
    from duewise.plans.anomaly import Detection

    rows = Detection(wh).findings if findings is None else findings
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    if metric_code is not None:
        rows = rows.filter(F.col("metric_code") == metric_code)
    return ToolResult("query_anomalies", {"severity": severity, "metric_code": metric_code}, rows)


def top_drivers(wh, top_n: int = 5, results: DataFrame | None = None) -> ToolResult:
    from duewise.plans.attribution import Attribution

    rows = Attribution(wh).results() if results is None else results
    ordered = rows.orderBy(
        F.coalesce("contribution_rank", F.lit(10**9)), F.abs(F.coalesce("contribution_score", F.lit(0.0))).desc()
    )
    return ToolResult("query_top_drivers", {"top_n": top_n}, ordered.limit(max(int(top_n), 0)))


def roi_scenarios(wh, scenario_id: str | None = None, results: DataFrame | None = None) -> ToolResult:
    from duewise.plans.strategy import StrategyLab

    rows = StrategyLab(wh).roi() if results is None else results
    if scenario_id is not None:
        rows = rows.filter(F.col("scenario_id") == scenario_id)
    return ToolResult("query_roi_scenarios", {"scenario_id": scenario_id}, rows)


def vendor_performance(
    wh, vendor_id: str | None = None, date_start: str | None = None, date_end: str | None = None
) -> ToolResult:
    rows = date_range(wh["ads_vendor_performance_di"], date_start, date_end)
    if vendor_id:
        rows = rows.filter(F.col("vendor_id") == str(vendor_id))
    means = ["connect_rate", "ptp_rate", "ptp_keep_rate", "call_coverage_rate", "complaint_rate"]
    grouped = rows.groupBy("vendor_id").agg(F.sum("action_count").alias("action_count"), *(F.avg(c).alias(c) for c in means))
    out = grouped.withColumn(
        "recovery_contribution", F.round(F.col("action_count") * F.col("ptp_rate") * F.col("ptp_keep_rate"), 6)
    )
    params = {"vendor_id": vendor_id, "date_start": date_start, "date_end": date_end}
    return ToolResult("query_vendor_performance", params, out, order=("vendor_id",))


def collector_performance(
    wh, vendor_id: str | None = None, date_start: str | None = None, date_end: str | None = None
) -> ToolResult:
    """``ptp_rate`` here is the mean keep rate: the name is kept for compatibility."""
    rows = date_range(wh["ads_collector_performance_di"], date_start, date_end)
    if vendor_id:
        rows = rows.filter(F.col("vendor_id") == str(vendor_id))
    grouped = rows.groupBy("vendor_id", "collector_id").agg(
        F.avg("action_count").alias("daily_case_count"), F.sum("action_count").alias("action_count"),
        F.avg("connect_rate").alias("connect_rate"), F.avg("ptp_keep_rate").alias("ptp_rate"),
        F.avg("ptp_keep_rate").alias("ptp_keep_rate"), F.sum("complaint_count").alias("complaint_count"),
    )
    share = F.when(F.col("action_count") != 0, 1 - F.col("complaint_count") / F.col("action_count"))
    out = grouped.withColumn("compliance_score", clip(F.coalesce(share, F.lit(1.0)), 0.0, 1.0))
    params = {"vendor_id": vendor_id, "date_start": date_start, "date_end": date_end}
    return ToolResult("query_collector_performance", params, out, order=("vendor_id", "collector_id"))


def trend(first: Column, last: Column) -> Column:
    return F.when(last > first, "up").when(last < first, "down").otherwise("flat")


def segment_breakdown(wh, segment_col: str, metric: str = "recovery_rate_d7", days: int = 30) -> ToolResult:
    """Mean, first and last daily value and trend per segment value over the last days."""
    params = {"segment_col": segment_col, "metric": metric, "days": days}
    schema = "segment_col string, segment_val string, metric string, avg_value double, trend string"
    if segment_col not in SEGMENT_COLUMNS:
        return ToolResult("query_segment_breakdown", params, empty(wh, schema), note="unsupported segment")
    if metric != "recovery_rate_d7":
        known = metric in wh["ads_postloan_dashboard_di"].columns
        note = "no segment detail for this metric" if known else "unknown metric"
        return ToolResult("query_segment_breakdown", params, empty(wh, schema), note=note)
    daily = recovery_by(last_days(segment_fact(wh), days), ["stat_date", segment_col])
    v, d = F.col(metric), F.col("stat_date")
    grouped = daily.groupBy(segment_col).agg(
        F.avg(v).alias("_avg"), F.min_by(v, d).alias("_first"), F.max_by(v, d).alias("_last"), F.count(v).alias("_n"),
        F.countDistinct(d).alias("day_count"),
    )
    out = grouped.select(
        F.lit(segment_col).alias("segment_col"), F.col(segment_col).alias("segment_val"), F.lit(metric).alias("metric"),
        steady_round("_avg", 6).alias("avg_value"),
        F.when(F.col("_n") >= 2, trend(F.col("_first"), F.col("_last"))).otherwise("flat").alias("trend"),
        F.round("_first", 6).alias("first_value"), F.round("_last", 6).alias("last_value"), "day_count",
    )
    return ToolResult("query_segment_breakdown", params, out, order=("segment_val",))


def nest_recent(cases: DataFrame, snapshots: DataFrame, days: int = 30) -> DataFrame:
    """Cases with their snapshots of the last days as an array; a case has one snapshot per day."""
    recent = without_personal_fields(last_days(snapshots, days))
    nested = recent.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("stat_date", *(c for c in recent.columns if c not in ("case_id", "stat_date"))))).alias(
            "recent_30d_snapshots"
        )
    )
    return without_personal_fields(cases).join(nested, "case_id", "left")


def case_detail(wh, case_id: str | None = None, customer_id: str | None = None) -> ToolResult:
    params = {"case_id": case_id, "customer_id": customer_id}
    cases, snapshots = wh["dim_case"], wh["dws_case_status_snapshot_di"]
    if not case_id and not customer_id:
        return ToolResult("query_case_detail", params, cases.limit(0), note="case_id or customer_id is required")
    for column, value in params.items():
        if value:
            cases = cases.filter(F.col(column) == F.lit(value))
            snapshots = snapshots.filter(F.col(column) == F.lit(value))
    return ToolResult("query_case_detail", params, nest_recent(cases, snapshots), order=("case_id",))


def collection_process(
    wh, segment_col: str | None = None, segment_val: str | None = None, days: int = 30
) -> ToolResult:
    """One-row summary of the last days, with mean days since each case's last action."""
    params = {"segment_col": segment_col, "segment_val": segment_val, "days": days}
    rows = last_days(process_fact(wh), days)
    if segment_col:
        if segment_col not in rows.columns:
            return ToolResult("query_collection_process", params, empty(wh, "action_count long"), note="unsupported segment")
        if segment_val is not None:
            rows = rows.filter(F.col(segment_col) == str(segment_val))
    per_case = rows.groupBy("case_id").agg(
        F.max("stat_date").alias("_last"),
        *(F.sum(c).alias(c) for c in ("action_count", "connected_count", "ptp_count", "ai_action_count")),
    )
    newest = F.max("_last")
    sums = per_case.agg(
        *(F.sum(c).alias(c) for c in ("action_count", "connected_count", "ptp_count", "ai_action_count")),
        F.count("case_id").alias("case_count"), newest.alias("_newest"),
        F.avg(F.datediff(F.lit("1970-01-01"), "_last")).alias("_mean_back"),
    ).filter(F.col("case_count") > 0)
    out = sums.select(
        F.lit(segment_col).cast("string").alias("segment_col"), F.lit(segment_val).cast("string").alias("segment_val"),
        "action_count", "connected_count", safe_rate("connected_count", "action_count", clipped=False).alias("connect_rate"),
        "ptp_count", safe_rate("ptp_count", "connected_count", clipped=False).alias("ptp_rate"),
        safe_rate("ai_action_count", "action_count", clipped=False).alias("ai_coverage_rate"),
        steady_round(F.datediff("_newest", F.lit("1970-01-01")) + F.col("_mean_back"), 6).alias("days_since_last_action"),
        "case_count",
    )
    return ToolResult("query_collection_process", params, out)


def data_overview(wh, tables: list[str] | None = None) -> ToolResult:
    from duewise.plans.warehouse import BUILDERS

    names = list(BUILDERS) if tables is None else tables
    return ToolResult("get_data_overview", {}, profile({n: wh[n] for n in names}), order=("table_name",))


TOOLS: dict[str, Callable[..., ToolResult]] = {
    "query_recovery_rate": recovery_rate,
    "query_anomalies": anomalies,
    "query_top_drivers": top_drivers,
    "query_roi_scenarios": roi_scenarios,
    "query_vendor_performance": vendor_performance,
    "query_collector_performance": collector_performance,
    "query_segment_breakdown": segment_breakdown,
    "query_case_detail": case_detail,
    "query_collection_process": collection_process,
    "get_data_overview": data_overview,
}


def call_tool(wh, name: str, params: dict[str, Any] | None = None) -> ToolResult:
    """Run a tool by name; an unknown name gives an empty result with a note."""
    if name not in TOOLS:
        return ToolResult(name, dict(params or {}), empty(wh, "result string"), note=f"unknown tool: {name}")
    return TOOLS[name](wh, **(params or {}))
