"""Recent-versus-baseline checks over daily series, and the findings they give.

Every check contributes a small daily series; all series are stacked and compared in one pass. A check that
cannot be evaluated becomes a warning and never stops the others.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duewise.functions.dates import window_label
from duewise.functions.rates import clean, relative_change, steady_round
from duewise.functions.text import fixed as two
from duewise.functions.text import percent as pct
from duewise.operators.ordering import exact_median, last_observations
from duewise.operators.windows import window_bounds
from duewise.plans.metrics import dashboard
from duewise.sources.dated import DatedSource
from duewise.sources.tables import TableMissing


@dataclass(frozen=True)
class Rules:
    """Thresholds (fixed values)."""

    recent_days: int = 30
    baseline_days: int = 30
    maturity_days: int = 0
    min_relative: float = 0.10
    min_absolute: float = 0.02
    medium_relative: float = 0.15
    medium_absolute: float = 0.04
    high_relative: float = 0.25
    high_absolute: float = 0.06
    share_fires_at: float = 0.05
    share_high_at: float = 0.07
    complaint_multiple: float = 2.0
    trend_points: int = 5


DEFAULT_RULES = Rules()
TEN_THOUSAND = 10_000
M1_FALLBACK = "recovery_rate_d7"


@dataclass(frozen=True)
class Check:
    metric_code: str
    metric_name_cn: str
    direction: str
    anomaly_type: str
    dimension_name: str
    evidence_table: str
    explanation: Callable[[Column, Column, Column], Column]
    recommended_next_step: str
    series: Callable[..., DataFrame]
    rule: str = "window"


def _series(df: DataFrame, value: Column, dimension_value: Column | str = "ALL") -> DataFrame:
    who = F.lit(dimension_value) if isinstance(dimension_value, str) else dimension_value
    return df.select(F.to_date("stat_date").alias("stat_date"), who.alias("dimension_value"), clean(value).alias("value"))


def board_of(wh, codes: Sequence[str]) -> DataFrame:
    """The dashboard with the metrics asked for; only their families are built where the source has no dashboard."""
    given = wh.strict or wh.source.has("ads_postloan_dashboard_di")
    return wh["ads_postloan_dashboard_di"] if given else dashboard(wh, codes)


def m1_series(wh, rules: Rules) -> DataFrame:
    board = board_of(wh, ["m1_recovery_rate"])
    code = "m1_recovery_rate" if "m1_recovery_rate" in board.columns else M1_FALLBACK
    return _series(board, F.col(code))


def vendor_connect_series(wh, rules: Rules) -> DataFrame:
    return _series(wh["ads_vendor_performance_di"], F.col("connect_rate"), F.col("vendor_id"))


def capacity_series(wh, rules: Rules) -> DataFrame:
    daily = wh["dws_vendor_line_capacity_di"].dropna(subset=["region", "stat_date"]).groupBy("stat_date", "region").agg(
        F.sum("active_case_count").alias("cases"), F.sum("active_collector_count").alias("collectors")
    )
    return _series(daily, F.when(F.col("collectors") != 0, F.col("cases") / F.col("collectors")), F.col("region"))


def high_balance_share_series(wh, rules: Rules) -> DataFrame:
    """Daily share of customers at or above twice the overall median balance who are also high risk."""
    balances = [
        w["dws_customer_status_snapshot_di"].select("stat_date", "customer_id", "risk_level", clean("total_outstanding_amount").alias("balance"))
        for w in (wh, getattr(wh, "whole", wh))
    ]
    status, overall = balances
    threshold = exact_median(overall, "balance").select(F.col("median") * 2).scalar()
    daily = status.groupBy("stat_date").agg(
        F.countDistinct("customer_id").alias("customers"),
        F.count_if((F.col("balance") >= threshold) & (F.col("risk_level") == "high")).alias("risky"),
    )
    return _series(daily, F.when(F.col("customers") != 0, F.col("risky") / F.col("customers")))


def ai_coverage_series(wh, rules: Rules) -> DataFrame:
    daily = wh["dws_collection_process_wide_di"].groupBy("stat_date").agg(
        F.sum("action_count").alias("actions"), F.sum("ai_action_count").alias("ai")
    )
    return _series(daily, F.when(F.col("actions") != 0, F.col("ai") / F.col("actions")), "AI_OUTBOUND")


def reduction_usage_series(wh, rules: Rules) -> DataFrame:
    if not wh.strict and not wh.source.has("ads_reduction_roi_di"):
        return _series(board_of(wh, ["reduction_usage_rate"]), F.col("reduction_usage_rate"))
    return _series(wh["ads_reduction_roi_di"], F.col("reduction_usage_rate"))


def ptp_keep_series(wh, rules: Rules) -> DataFrame:
    return _series(board_of(wh, ["ptp_keep_rate"]), F.col("ptp_keep_rate"))


def dashboard_series(board: DataFrame, codes: list[str]) -> DataFrame:
    """Several dashboard metrics as series rows, from one pass over the dashboard."""
    items = F.array(*(
        F.struct(F.lit("ALL").alias("dimension_value"), clean(c).alias("value"), F.lit(c).alias("metric_code")) for c in codes
    ))
    return board.select(F.to_date("stat_date").alias("stat_date"), F.inline(items))


# Names, formats and next steps are fixed values.
CHECKS = [
    Check("m1_recovery_rate", "M1 回收率", "drop", "window_compare", "overall", "ads_postloan_dashboard_di",
          lambda b, r, d: F.concat(F.lit("最近窗口均值 "), pct(r), F.lit(" 低于基线 "), pct(b), F.lit("，变化 "), pct(d), F.lit("。")),
          "进入 M3-B 后按供应商、线路、客群结构、AI 覆盖和减免策略下钻归因。", m1_series),
    Check("connect_rate", "接通率", "drop", "window_compare", "vendor_id", "ads_vendor_performance_di",
          lambda b, r, d: F.concat(F.lit("供应商最近接通率 "), pct(r), F.lit("，低于基线 "), pct(b), F.lit("。")),
          "下钻供应商的线路、催员和触达时段，验证执行资源或号码质量问题。", vendor_connect_series),
    Check("avg_case_per_collector", "线路人均案量", "increase", "spike", "region", "dws_vendor_line_capacity_di",
          lambda b, r, d: F.concat(F.lit("线路人均案量从 "), two(b), F.lit(" 升至 "), two(r), F.lit("，产能压力上升。")),
          "下钻各 line_id 的 active_case_count 与 active_collector_count，评估临时增员或分案转移。", capacity_series),
    Check("high_balance_high_risk_share", "高余额高风险客群占比", "increase", "window_compare", "overall",
          "dws_customer_status_snapshot_di",
          lambda b, r, d: F.concat(F.lit("高余额高风险客群占比从 "), pct(b), F.lit(" 升至 "), pct(r), F.lit("。")),
          "进入后续归因阶段后拆分余额段、risk_level 和入案批次，识别结构变化贡献。", high_balance_share_series, "share"),
    Check("ai_call_coverage", "AI 外呼覆盖率", "drop", "window_compare", "action_type", "dws_collection_process_wide_di",
          lambda b, r, d: F.concat(F.lit("AI 外呼覆盖率从 "), pct(b), F.lit(" 降至 "), pct(r), F.lit("。")),
          "检查 AI 外呼线路容量、分案策略和人工替代触达占比。", ai_coverage_series),
    Check("reduction_usage_rate", "减免使用率", "drop", "window_compare", "overall", "ads_reduction_roi_di",
          lambda b, r, d: F.concat(F.lit("减免使用率从 "), pct(b), F.lit(" 降至 "), pct(r), F.lit("。")),
          "下钻 vendor_id、line_id 与 dpd_bucket，确认减免授权、审批或策略门槛是否变化。", reduction_usage_series),
    Check("ptp_keep_rate", "PTP 履约率", "drop", "window_compare", "overall", "ads_postloan_dashboard_di",
          lambda b, r, d: F.concat(F.lit("PTP 履约率从 "), pct(b), F.lit(" 降至 "), pct(r), F.lit("。")),
          "下钻承诺还款客户的风险等级、余额段、催员和减免使用情况。", ptp_keep_series),
]
BY_CODE = {c.metric_code: c for c in CHECKS}
FINDING_COLUMNS = [
    "anomaly_id", "metric_code", "metric_name_cn", "anomaly_type", "severity", "dimension_name", "dimension_value",
    "baseline_value", "recent_value", "absolute_change", "relative_change", "recent_window", "baseline_window",
    "evidence_table", "explanation", "recommended_next_step",
]


# --------------------------------------------------------------------------- rule expressions


def fires(direction: Column | str, absolute: Column, relative: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Right direction and (relative OR absolute) at or above its threshold.

    Changes are rounded to 6 places first, so that a change exactly on a threshold does not depend on the
    order in which means were summed.
    """
    way = F.lit(direction) if isinstance(direction, str) else direction
    a, r = steady_round(absolute, 6), steady_round(relative, 6)
    sign = F.when(way == "drop", F.lit(-1.0)).when(way == "increase", F.lit(1.0)).otherwise(F.signum(a))
    return (a * sign > 0) & ((r * sign >= rules.min_relative) | (a * sign >= rules.min_absolute))


def severity_of(absolute: Column, relative: Column, rules: Rules = DEFAULT_RULES) -> Column:
    a, r = F.abs(steady_round(absolute, 6)), F.abs(steady_round(relative, 6))
    return (
        F.when((r >= rules.high_relative) | (a >= rules.high_absolute), "high")
        .when((r >= rules.medium_relative) | (a >= rules.medium_absolute), "medium")
        .otherwise("low")
    )


def is_spike(baseline: Column, recent: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return fires("increase", recent - baseline, relative_change(baseline, recent), rules)


def crosses(value: Column, limit: float, direction: str = "above") -> Column:
    return value > limit if direction == "above" else value < limit


def trend_drop(series: DataFrame, value: str, points: int = 5, date: str = "stat_date") -> DataFrame:
    """One row ``(falling)``: the last ``points`` observations exist and each is below the one before."""
    tail = last_observations(series.select(date, clean(value).alias("_v")), date, points)
    step = F.col("_v") < F.lag("_v").over(W.orderBy(date))  # at most `points` rows
    return tail.withColumn("_down", step).agg(
        ((F.count("_v") == points) & (F.count_if(F.col("_down")) == points - 1)).alias("falling")
    )


# --------------------------------------------------------------------------- comparison


def compare_windows(series: DataFrame, keys: list[str], rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Unweighted means of the daily values in the two windows, per key.

    Windows end at the key's own newest date, less ``maturity_days`` when the newest days are not final yet.
    A series has one row per date, so the window per key is small; a key with no value in either window
    keeps null means.
    """
    newest = F.date_sub(F.max("stat_date").over(W.partitionBy(*keys)), rules.maturity_days)
    recent_start = F.date_sub("_newest", rules.recent_days - 1)
    baseline_end = F.date_sub("_newest", rules.recent_days)
    baseline_start = F.date_sub("_newest", rules.recent_days + rules.baseline_days - 1)
    dated = series.dropna(subset=["stat_date"]).withColumn("_newest", newest)
    means = dated.groupBy(*keys).agg(
        F.max("_newest").alias("_newest"),
        F.avg(F.when(F.col("stat_date").between(baseline_start, baseline_end), F.col("value"))).alias("baseline"),
        F.avg(F.when(F.col("stat_date").between(recent_start, F.col("_newest")), F.col("value"))).alias("recent"),
    )
    return means.select(
        *keys, "baseline", "recent",
        (F.col("recent") - F.col("baseline")).alias("absolute"),
        relative_change("baseline", "recent").alias("relative"),
        window_label(recent_start, "_newest").alias("recent_window"),
        window_label(baseline_start, baseline_end).alias("baseline_window"),
    )


def _per_check(value: Callable[[Check], Column]) -> Column:
    out = None
    for check in CHECKS:
        condition = F.col("metric_code").isin(
            [check.metric_code, M1_FALLBACK] if check.metric_code == "m1_recovery_rate" else [check.metric_code]
        )
        out = F.when(condition, value(check)) if out is None else out.when(condition, value(check))
    return out


#: The table whose days end the series of a check, and its dimension.
SERIES_DAYS = {
    "m1_recovery_rate": ("ads_postloan_dashboard_di", None), "ptp_keep_rate": ("ads_postloan_dashboard_di", None),
    "reduction_usage_rate": ("ads_reduction_roi_di", None), "connect_rate": ("ads_vendor_performance_di", "vendor_id"),
    "avg_case_per_collector": ("dws_vendor_line_capacity_di", "region"),
    "high_balance_high_risk_share": ("dws_customer_status_snapshot_di", None), "ai_call_coverage": ("dws_collection_process_wide_di", None),
}
#: Read by most of the checks, so written once, for the days of the windows only.
WINDOW_TABLES = ("dwd_collection_action_detail_di", "dwd_due_plan_detail_di")
#: Built here, the dashboard and what copies its days end with the case snapshots, which have a row for each of its days.
BOARD_DAYS = ("ads_postloan_dashboard_di", "ads_reduction_roi_di")


def newest_days(wh, codes: Sequence[str]) -> DataFrame | None:
    """The newest day of each series of the checks, from columns of dates and dimensions alone."""
    parts = []
    for name, dimension in dict.fromkeys(SERIES_DAYS[c] for c in codes):
        built = name in BOARD_DAYS and not wh.strict and not wh.source.has(name)
        keys = [] if dimension is None else [dimension]
        try:
            days = wh["ods_case_daily_snapshot" if built else name].select(F.to_date("stat_date").alias("newest"), *keys)
        except (TableMissing, AnalysisException, KeyError):
            continue
        parts.append(days.groupBy(*keys).agg(F.max("newest").alias("newest")).select("newest"))
    return reduce(DataFrame.union, parts) if parts else None


def since(wh, rules: Rules, codes: Sequence[str]):
    """A warehouse that starts where the earliest window of any series starts.

    Every series has its own newest day, so the earliest of them decides; nothing that a window needs is left out.
    The day is a literal in the plans that follow, so that it prunes partitions and row groups. ``whole`` stays at hand for
    figures over all history.
    """
    days = newest_days(type(wh)(wh.source, strict=wh.strict), codes)  # nothing is staged for it
    oldest = days.agg(F.min("newest")).first()[0] if days is not None else None
    if oldest is None:
        return wh
    back = rules.maturity_days + rules.recent_days + rules.baseline_days - 1
    windowed = type(wh)(DatedSource(wh.source, oldest - datetime.timedelta(days=back)), strict=wh.strict, shared=WINDOW_TABLES)
    windowed.whole = wh
    return windowed


class Detection:
    """The checks of one run: ``checks`` holds a row for each, ``findings`` those that fired."""

    def __init__(self, wh, rules: Rules = DEFAULT_RULES, only: list[str] | None = None) -> None:
        codes = [c.metric_code for c in CHECKS if only is None or c.metric_code in only]
        wh = since(wh, rules, codes)
        self.wh = wh
        self.rules = rules
        self.warnings: list[str] = []
        parts: list[DataFrame] = []
        wanted = [c for c in CHECKS if only is None or c.metric_code in only]
        together = self._dashboard_checks(wanted)
        if together:
            parts.append(dashboard_series(board_of(wh, together), together))
        for check in wanted:
            if check.metric_code in together:
                continue
            try:
                part = check.series(wh, rules).withColumn("metric_code", F.lit(self._code_of(check)))
            except (TableMissing, AnalysisException, KeyError) as exc:
                self.warnings.append(f"{check.metric_code} skipped: {exc}")
                continue
            parts.append(part)
        self.series = reduce(DataFrame.unionByName, parts) if parts else None

    def _code_of(self, check: Check) -> str:
        """A dashboard without the M1 rate is checked, and reported, on its D7 rate."""
        if check.metric_code == "m1_recovery_rate" and "m1_recovery_rate" not in self.wh["ads_postloan_dashboard_di"].columns:
            return M1_FALLBACK
        return check.metric_code

    def _dashboard_checks(self, wanted: list[Check]) -> list[str]:
        """Checks that read the dashboard, so that it is computed once for all of them."""
        codes = {"m1_recovery_rate", "ptp_keep_rate"}
        if not self.wh.source.has("ads_reduction_roi_di"):
            codes.add("reduction_usage_rate")  # the built concession table copies this dashboard column
        if not self.wh.has("ads_postloan_dashboard_di"):
            return []
        present = self.wh["ads_postloan_dashboard_di"].columns
        found = [c.metric_code for c in wanted if c.metric_code in codes and c.metric_code in present]
        return found if len(found) > 1 else []

    @property
    def checks(self) -> DataFrame | None:
        """One row per check and dimension value, fired or not; rows without both windows have null values."""
        if self.series is None:
            return None
        rules = self.rules
        compared = compare_windows(self.series, ["metric_code", "dimension_value"], rules)
        absolute, relative = F.col("absolute"), F.col("relative")
        share = _per_check(lambda c: F.lit(c.rule == "share"))
        by_share = steady_round(absolute, 6) >= rules.share_fires_at
        share_level = F.when(steady_round(absolute, 6) >= rules.share_high_at, "high").otherwise("medium")
        direction = _per_check(lambda c: F.lit(c.direction))
        dimension = _per_check(lambda c: F.lit(c.dimension_name))
        both = F.col("baseline").isNotNull() & F.col("recent").isNotNull()
        return compared.select(
            F.translate(
                F.concat(F.lit("M3A-"), "metric_code", F.lit("-"), dimension, F.lit("-"), "dimension_value"), " ", "_"
            ).alias("anomaly_id"),
            "metric_code",
            _per_check(lambda c: F.lit(c.metric_name_cn)).alias("metric_name_cn"),
            _per_check(lambda c: F.lit(c.anomaly_type)).alias("anomaly_type"),
            F.when(share, share_level).otherwise(severity_of(absolute, relative, rules)).alias("severity"),
            dimension.alias("dimension_name"),
            "dimension_value",
            steady_round("baseline", 6).alias("baseline_value"),
            steady_round("recent", 6).alias("recent_value"),
            steady_round(absolute, 6).alias("absolute_change"),
            steady_round(relative, 6).alias("relative_change"),
            "recent_window", "baseline_window",
            _per_check(lambda c: F.lit(c.evidence_table)).alias("evidence_table"),
            _per_check(lambda c: c.explanation(F.col("baseline"), F.col("recent"), absolute)).alias("explanation"),
            _per_check(lambda c: F.lit(c.recommended_next_step)).alias("recommended_next_step"),
            both.alias("evaluated"),
            F.coalesce(F.when(share, by_share).otherwise(fires(direction, absolute, relative, rules)), F.lit(False)).alias("fired"),
        )

    @property
    def findings(self) -> DataFrame | None:
        checks = self.checks
        return None if checks is None else checks.filter("fired").select(*FINDING_COLUMNS)

    @property
    def unevaluated(self) -> DataFrame | None:
        """Warnings found in the data: checks whose series has no value in one of the windows."""
        checks = self.checks
        return None if checks is None else checks.filter(~F.col("evaluated")).select(
            "metric_code", "dimension_value", F.lit("lacks baseline or recent observations").alias("warning")
        )


def ptp_trend_warning(wh, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A PTP keep rate that falls five days in a row although its window check does not fire."""
    fired = Detection(wh, rules, only=["ptp_keep_rate"]).checks.select("metric_code", "fired")
    falling = trend_drop(wh["ads_postloan_dashboard_di"], "ptp_keep_rate", rules.trend_points).scalar()
    return fired.select(
        "metric_code", "fired", F.coalesce(falling, F.lit(False)).alias("falling"),
        (~F.col("fired") & F.coalesce(falling, F.lit(False))).alias("warned"),
    )


def template_complaints(wh, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Recent complaints per SMS by template, with the rate over all templates and its multiple."""
    sms = wh["dwd_collection_action_detail_di"].filter((F.col("action_type") == "SMS") & F.col("template_id").isNotNull())
    bounds = window_bounds(sms, "action_date", rules.recent_days, rules.baseline_days)
    sent = sms.filter(bounds.is_recent("action_date")).groupBy("template_id").agg(
        F.countDistinct("action_id").alias("action_count")
    )
    complained = (
        wh["dwd_complaint_detail_di"].filter(F.col("template_id").isNotNull() & bounds.is_recent("complaint_date"))
        .groupBy("template_id").agg(F.countDistinct("complaint_id").alias("complaint_count"))
    )
    rows = sent.join(complained, "template_id", "left").withColumn(
        "complaint_count", F.coalesce("complaint_count", F.lit(0).cast("long"))
    )
    overall = rows.agg((F.sum("complaint_count") / F.sum("action_count")).alias("global_rate"), F.count(F.lit(1)).alias("templates"))
    return rows.select(
        "template_id", "action_count", "complaint_count",
        F.when(F.col("action_count") != 0, F.col("complaint_count") / F.col("action_count")).alias("complaint_rate"),
        overall.select("global_rate").scalar().alias("global_rate"),
        overall.select("templates").scalar().alias("template_total"),
        bounds.recent_label.alias("recent_window"),
    )


def template_complaint_check(wh, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The template with the highest complaint rate against the overall rate (per ten thousand)."""
    rows = template_complaints(wh, rules).filter((F.col("template_total") >= 2) & (F.col("global_rate") > 0))
    top = rows.agg(
        F.max(F.struct("complaint_rate", "template_id", "global_rate", "recent_window")).alias("t")
    ).filter(F.col("t").isNotNull()).select("t.*")
    absolute = F.col("complaint_rate") - F.col("global_rate")
    relative = relative_change("global_rate", "complaint_rate")
    return top.select(
        F.concat(F.lit("M3A-complaint_per_10k_cases-template_id-"), "template_id").alias("anomaly_id"),
        F.lit("complaint_per_10k_cases").alias("metric_code"),
        F.lit("万案投诉率").alias("metric_name_cn"),
        F.lit("ratio_to_average").alias("anomaly_type"),
        severity_of(absolute, relative, rules).alias("severity"),
        F.lit("template_id").alias("dimension_name"),
        F.col("template_id").alias("dimension_value"),
        F.round(F.col("global_rate") * TEN_THOUSAND, 6).alias("baseline_value"),
        F.round(F.col("complaint_rate") * TEN_THOUSAND, 6).alias("recent_value"),
        F.round(absolute * TEN_THOUSAND, 6).alias("absolute_change"),
        F.round(relative, 6).alias("relative_change"),
        "recent_window",
        F.concat(F.lit("recent_global_average:"), "recent_window").alias("baseline_window"),
        F.lit("dwd_collection_action_detail_di+dwd_complaint_detail_di").alias("evidence_table"),
        F.concat(
            "template_id", F.lit(" 最近万案投诉率为 "), two(F.col("complaint_rate") * TEN_THOUSAND),
            F.lit("，约为全模板均值 "), two(F.col("global_rate") * TEN_THOUSAND), F.lit(" 的 "),
            two(F.col("complaint_rate") / F.col("global_rate")), F.lit(" 倍。"),
        ).alias("explanation"),
        F.lit("下钻该模板的发送供应商、发送时段、投诉等级和具体话术，进入合规复核。").alias("recommended_next_step"),
        (F.col("complaint_rate") >= F.col("global_rate") * rules.complaint_multiple).alias("fired"),
    )


# --------------------------------------------------------------------------- summaries

SEVERITIES = ["high", "medium", "low"]  # fixed values, in rank order


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "high", 0).when(F.col(column) == "medium", 1).otherwise(2)


def counts_with_zeros(df: DataFrame, column: str, levels: list[str], count: str = "finding_count") -> DataFrame:
    """Rows per level, including levels that do not occur, from one aggregate."""
    totals = df.agg(
        F.array(*(
            F.struct(F.lit(level).alias(column), F.count_if(F.col(column) == level).alias(count)) for level in levels
        )).alias("_rows")
    )
    return totals.select(F.inline("_rows"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return counts_with_zeros(findings, "severity", SEVERITIES)


def top_findings(findings: DataFrame, limit: int = 5) -> DataFrame:
    return findings.orderBy(
        severity_rank(), F.abs("relative_change").desc(), "metric_code", "dimension_value"
    ).limit(limit)


def find_target(findings: DataFrame, metric: str = "recovery_rate_d7") -> DataFrame:
    """The finding to explain: of the metric itself, or of its M1 form; at most one row."""
    codes = [metric, "m1_recovery_rate"] if metric == "recovery_rate_d7" else [metric]
    return findings.filter(F.col("metric_code").isin(codes)).orderBy("metric_code", "dimension_value").limit(1)
