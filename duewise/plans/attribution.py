"""Which business segments explain a change of the M1 recovery rate.

The recovery fact of the two windows is brought to one row per loan, period and combination of dimension values.
Each such row knows for which dimensions it is the first of its loan with that value, so that loan counts become
plain sums: unpivoting over the twelve dimensions then needs no distinct count and no wide shuffle. The same aggregate
yields the process counts that serve as evidence.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.functions.rates import flag_sum, safe_rate, total
from duewise.operators.joins import coalescing_join, met
from duewise.operators.ordering import dedupe, latest_per_key, top_per_key
from duewise.operators.windows import WindowBounds, bounds_from
from duewise.plans.warehouse import HIGH_BALANCE
from duewise.session import stage
from duewise.sources.dated import DatedSource

DIMENSIONS = [  # fixed values, in rank-tie order
    "vendor_id", "vendor_name", "line_id", "line_name", "collector_id", "product_code", "channel_code", "province",
    "region", "balance_segment", "risk_level", "score_band",
]
MIN_WEIGHT = 0.005  # fixed value
PER_DIMENSION = 2  # fixed value
UNKNOWN = "UNKNOWN"
PROCESS_COUNTS = [
    "action_count", "ai_action_count", "connected_count", "ptp_count", "ptp_fulfilled_count", "process_complaint_count"
]
S, L, D, DATE, TS = T.StringType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()


# --------------------------------------------------------------------------- fact


def attach_process(wh, fact: DataFrame) -> DataFrame:
    """Same-day process counts of the loan's case; zero when there are none."""
    columns = {"stat_date": DATE, "case_id": L, **{c: L for c in PROCESS_COUNTS[:-1]}, "complaint_count": L}
    daily = (
        wh.optional("dws_collection_process_wide_di", columns)
        .groupBy("stat_date", "case_id")
        .agg(*(F.sum(c).alias(c) for c in PROCESS_COUNTS[:-1]), F.sum("complaint_count").alias("process_complaint_count"))
    )
    joined = fact.join(daily, ["stat_date", "case_id"], "left")
    return joined.select(*fact.columns, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in PROCESS_COUNTS))


def _attach_flag(fact: DataFrame, rows: DataFrame, id_column: str, time_column: str, flag: str) -> DataFrame:
    seen = (
        rows.select(F.to_date(time_column).alias("stat_date"), "case_id", id_column)
        .dropna(subset=["stat_date", "case_id"])
        .groupBy("stat_date", "case_id")
        .agg((F.count(id_column) > 0).alias("_seen"))
    )
    return fact.join(seen, ["stat_date", "case_id"], "left").select(
        *fact.columns, F.coalesce("_seen", F.lit(False)).alias(flag)
    )


def attach_reduction(wh, fact: DataFrame) -> DataFrame:
    rows = wh.optional("ods_reduction_application", {"case_id": L, "apply_time": TS, "reduction_id": L})
    return _attach_flag(fact, rows, "reduction_id", "apply_time", "reduction_used")


def attach_complaints(wh, fact: DataFrame) -> DataFrame:
    rows = wh.optional("dwd_complaint_detail_di", {"case_id": L, "complaint_date": DATE, "complaint_id": L})
    return _attach_flag(fact, rows, "complaint_id", "complaint_date", "complaint_flag")


def coverage_class(part: str, none_label: str, high: str, low: str) -> Column:
    actions, share = F.col("action_count"), F.col(part)
    return (
        F.when(actions == 0, "NO_ACTION").when(share == 0, none_label)
        .when(share / F.when(actions != 0, actions) >= 0.5, high).otherwise(low)
    )


def normalize(fact: DataFrame) -> DataFrame:
    """Balance fallback, process classes, and UNKNOWN for every missing dimension value."""
    balance = F.coalesce("total_outstanding_amount", F.lit(0.0))
    out = (
        fact.withColumn("balance_segment", F.coalesce("balance_segment", F.when(balance >= HIGH_BALANCE, "HIGH").otherwise("NORMAL")))
        .withColumn("manual_action_count", F.col("action_count") - F.col("ai_action_count"))
        .withColumn("ai_call_coverage", coverage_class("ai_action_count", "NO_AI", "AI_HIGH", "AI_LOW"))
        .withColumn("manual_call_coverage", coverage_class("manual_action_count", "NO_MANUAL", "MANUAL_HIGH", "MANUAL_LOW"))
        .withColumn("reduction_usage_rate", F.when(F.col("reduction_used"), "REDUCTION_USED").otherwise("NO_REDUCTION"))
        .withColumn(
            "ptp_keep_rate",
            F.when(F.col("ptp_count") == 0, "NO_PTP").when(F.col("ptp_fulfilled_count") > 0, "PTP_KEPT").otherwise("PTP_NOT_KEPT"),
        )
        .withColumn("complaint_rate", F.when(F.col("complaint_flag"), "COMPLAINT").otherwise("NO_COMPLAINT"))
    )
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in [*DIMENSIONS, "dpd_bucket"]})


def _basis(wh, name: str, origin: str) -> str:
    """``origin`` where ``name`` is built here by left joins to it, which keep its rows and columns as they are."""
    return origin if not wh.strict and not wh.source.has(name) and wh.source.has(origin) else name


def on_days_met(snapshot: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The rows of a daily snapshot that a left join of ``base`` by day and ``key`` can meet.

    A snapshot has every customer or case on every day, and most of ``base`` may lie outside its days. The pairs that both
    can have are written once: few or many, their size is known, and their keys are met before the days are.
    """
    days = snapshot.select("stat_date").distinct()
    pairs = stage(base.select("stat_date", key).distinct().join(days, "stat_date", "left_semi"), "pairs")
    return met(met(snapshot, pairs, [key]), pairs, ["stat_date", key])


def recovery_fact(wh) -> DataFrame:
    """M1 loan-days with case, resource, customer and score attributes and same-day process facts.

    Missing optional tables leave their dimensions UNKNOWN and add a note to the warehouse. All right sides
    hold one row per key, so the fact keeps the rows of the loan status table.
    """
    # A strict warehouse builds nothing, so its tables are joined as they are given.
    def few(right: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
        return met(right, left, keys) if wh.dated and not wh.strict else right

    def on_days(snapshot: DataFrame, key: str) -> DataFrame:
        return snapshot if wh.strict else on_days_met(snapshot, base, key)

    loan = wh["dws_loan_status_snapshot_di"].filter(F.col("dpd_bucket") == "M1").select(
        F.to_date("stat_date").alias("stat_date"), "loan_id", "customer_id", "product_code", "dpd_bucket", "due_amount",
        "repaid_amount_d7",
    )
    mapping = wh.optional("dim_case_loan_mapping", {"loan_id": L, "case_id": L})
    mapping = few(mapping.select("loan_id", "case_id"), loan, ["loan_id"])
    loan = loan.join(dedupe(mapping, ["loan_id"], ["case_id"]), "loan_id", "left")
    # Written once where tables are built: the steps below look at its keys before they look up the rest.
    base = loan = loan if wh.strict else stage(loan, "fact-loans")

    case = wh.optional(
        "dim_case",
        {"case_id": L, "current_vendor_id": S, "current_line_id": S, "collector_id": L, "balance_segment": S},
    ).select(
        "case_id", F.col("current_vendor_id").alias("vendor_id"), F.col("current_line_id").alias("line_id"), "collector_id",
        "balance_segment",
    )
    case = few(case, base, ["case_id"])
    loan = loan.join(dedupe(case, ["case_id"], ["vendor_id", "line_id"]), "case_id", "left")

    status = wh.optional(
        _basis(wh, "dws_case_status_snapshot_di", "ods_case_daily_snapshot"),
        {"stat_date": DATE, "case_id": L, "vendor_id": S, "line_id": S, "collector_id": L},
    )
    places = ["vendor_id", "line_id", "collector_id"]
    daily = dedupe(on_days(status.select("stat_date", "case_id", *places), "case_id"), ["stat_date", "case_id"], places)
    loan = coalescing_join(loan, daily, ["stat_date", "case_id"], places)

    channel = wh.optional("dim_loan", {"loan_id": L, "channel_code": S}).select("loan_id", "channel_code")
    loan = loan.join(dedupe(few(channel, base, ["loan_id"]), ["loan_id"], ["channel_code"]), "loan_id", "left")

    balance = wh.optional(
        "dws_customer_status_snapshot_di",
        {"stat_date": DATE, "customer_id": L, "risk_level": S, "total_outstanding_amount": D},
    ).select(F.to_date("stat_date").alias("stat_date"), "customer_id", "risk_level", "total_outstanding_amount")
    loan = loan.join(on_days(balance, "customer_id"), ["stat_date", "customer_id"], "left")

    customer = wh.optional("dim_customer", {"customer_id": L, "province": S, "risk_level_current": S}).select(
        "customer_id", "province", F.col("risk_level_current").alias("risk_level")
    )
    customer = dedupe(few(customer, base, ["customer_id"]), ["customer_id"], ["province", "risk_level"])
    loan = coalescing_join(loan, customer, ["customer_id"], ["risk_level", "province"])

    vendor = wh.optional("dim_vendor", {"vendor_id": S, "vendor_name": S}).select("vendor_id", "vendor_name")
    loan = loan.join(dedupe(vendor, ["vendor_id"], ["vendor_name"]), "vendor_id", "left")
    line = wh.optional("dim_collection_line", {"line_id": S, "line_name": S, "region": S}).select("line_id", "line_name", "region")
    loan = loan.join(dedupe(line, ["line_id"], ["line_name"]), "line_id", "left")

    score = wh.optional("ods_postloan_c_score", {"score_id": L, "customer_id": L, "score_date": S, "score_level": S})
    latest = latest_per_key(
        few(score.select("score_id", "customer_id", "score_date", "score_level"), base, ["customer_id"]),
        ["customer_id"], "score_date", ["score_id"],
    ).select("customer_id", F.col("score_level").alias("score_band"))
    loan = loan.join(latest, "customer_id", "left")

    return normalize(attach_complaints(wh, attach_reduction(wh, attach_process(wh, loan))))


# --------------------------------------------------------------------------- segments


def overall_rates(fact: DataFrame, bounds: WindowBounds) -> DataFrame:
    """One row: ratio of sums in both windows."""
    def of(condition: Column) -> Column:
        paid = total(F.when(condition, F.col("repaid_amount_d7")))
        due = total(F.when(condition, F.col("due_amount")))
        return safe_rate(paid, due, clipped=False, scale=None)

    return fact.agg(
        of(bounds.is_baseline("stat_date")).alias("baseline_total"), of(bounds.is_recent("stat_date")).alias("recent_total")
    ).withColumn("total_delta", F.col("recent_total") - F.col("baseline_total"))


MEASURES = [
    "numerator", "denominator", "loan_count", "actions", "ai_actions", "manual_actions", "connected", "promised", "kept",
    "reduced", "complained",
]


SUMMED = ["action_count", "ai_action_count", "manual_action_count", "connected_count", "ptp_count", "ptp_fulfilled_count"]


def loan_periods(fact: DataFrame, bounds: WindowBounds, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row per loan, period and combination of dimension values, with sums and ``first_of``.

    ``first_of`` holds, in the order of ``dimensions``, whether the row is the first of its loan and period with its
    value; a loan has few combinations, as rows combine before the shuffle. Rows without a loan count no loan and are
    spread by their values.
    """
    spread = F.when(F.col("loan_id").isNull(), F.xxhash64(*dimensions))
    rows = fact.withColumn("period", bounds.period("stat_date")).filter(F.col("period").isNotNull()).withColumn("_spread", spread)
    combined = rows.groupBy("period", "loan_id", "_spread", *dimensions).agg(
        total("repaid_amount_d7").alias("repaid"), total("due_amount").alias("due"), *(F.sum(c).alias(c) for c in SUMMED),
        flag_sum("reduction_used").alias("reduced"), flag_sum("complaint_flag").alias("complained"),
    )
    own = [c for c in combined.columns if c not in ("period", "loan_id", "_spread")]
    by_loan = combined.groupBy("period", "loan_id", "_spread").agg(F.collect_list(F.struct(*own)).alias("rows"))
    placed = by_loan.select("period", "loan_id", "rows", F.posexplode("rows").alias("at", "row"))
    first_of = [
        F.col("loan_id").isNotNull() & (F.array_position(F.col(f"rows.{d}"), F.col(f"row.{d}")) == F.col("at") + 1) for d in dimensions
    ]
    return placed.select("period", "row.*", F.array(*first_of).alias("first_of"))


def segment_periods(fact: DataFrame, bounds: WindowBounds, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Sums per (dimension, value, period), by an aggregate that combines before its shuffle to a row per segment."""
    narrow = loan_periods(fact, bounds, dimensions)
    unpivoted = narrow.select("period", "repaid", "due", *SUMMED, "reduced", "complained", F.inline(F.array(*(
        F.struct(F.lit(d).alias("dimension_name"), F.col(d).alias("dimension_value"), F.get("first_of", F.lit(i)).alias("first"))
        for i, d in enumerate(dimensions)
    ))))
    return unpivoted.filter(F.col("dimension_value") != UNKNOWN).groupBy("dimension_name", "dimension_value", "period").agg(
        total("repaid").alias("numerator"),
        total("due").alias("denominator"),
        F.count_if("first").alias("loan_count"),
        F.sum("action_count").alias("actions"),
        F.sum("ai_action_count").alias("ai_actions"),
        F.sum("manual_action_count").alias("manual_actions"),
        F.sum("connected_count").alias("connected"),
        F.sum("ptp_count").alias("promised"),
        F.sum("ptp_fulfilled_count").alias("kept"),
        F.sum("reduced").alias("reduced"),
        F.sum("complained").alias("complained"),
    )


def single_valued(periods: DataFrame) -> list[str]:
    """Dimensions with exactly one known value in the windows; at most twelve names."""
    ends = periods.groupBy("dimension_name").agg((F.min("dimension_value") == F.max("dimension_value")).alias("one"))
    return [r.dimension_name for r in ends.filter("one").collect()]


def with_several_values(fact: DataFrame, dimensions: list[str]) -> list[str]:
    """Those of ``dimensions`` that have two known values in ``fact``: one narrow row of ends, whatever the rows."""
    known = {d: F.when(F.col(d) != UNKNOWN, F.col(d)) for d in dimensions}
    ends = fact.agg(*((F.min(v) != F.max(v)).alias(d) for d, v in known.items())).first()
    return [d for d in dimensions if ends[d]]


def segment_deltas(periods: DataFrame, several: Sequence[str] = ()) -> DataFrame:
    """One row per segment seen in either window, with both periods side by side.

    A dimension with fewer than two known values is left out, unless ``several`` names it as one that has more values
    outside the windows.
    """
    pivoted = periods.groupBy("dimension_name", "dimension_value").agg(*(
        F.coalesce(F.max(F.when(F.col("period") == p, F.col(m))), F.lit(0)).alias(f"{m}_{p}")
        for p in ("baseline", "recent") for m in MEASURES
    ), *(F.max((F.col("period") == p).cast("int")).alias(f"in_{p}") for p in ("baseline", "recent")))
    # One row per dimension: twelve at most.
    wide_enough = periods.groupBy("dimension_name").agg(
        ((F.min("dimension_value") != F.max("dimension_value")) | F.col("dimension_name").isin(list(several))).alias("_several")
    ).filter("_several").select("dimension_name")
    return (
        pivoted.filter((F.col("in_baseline") == 1) | (F.col("in_recent") == 1))
        .join(F.broadcast(wide_enough), "dimension_name", "left_semi")
        .withColumn("value_baseline", safe_rate("numerator_baseline", "denominator_baseline", clipped=False, scale=None))
        .withColumn("value_recent", safe_rate("numerator_recent", "denominator_recent", clipped=False, scale=None))
        .withColumn("delta", F.col("value_recent") - F.col("value_baseline"))
    )


def dimension_index(column: str = "dimension_name") -> Column:
    return F.array_position(F.array(*(F.lit(d) for d in DIMENSIONS)), F.col(column))


def score_contributions(segments: DataFrame, total_delta: Column) -> DataFrame:
    """Share of the adverse within-segment effect, normalised over all dimensions together."""
    totals = segments.groupBy("dimension_name").agg(F.sum("denominator_recent").alias("_total"))
    weighed = (
        segments.join(F.broadcast(totals), "dimension_name")  # twelve rows at most
        .withColumn("recent_weight", F.when(F.col("_total") != 0, F.col("denominator_recent") / F.col("_total")))
        .withColumn("raw_contribution", F.col("delta") * F.col("recent_weight"))
        .withColumn("_signed", F.when(total_delta < 0, -F.col("raw_contribution")).otherwise(F.col("raw_contribution")))
        .withColumn("adverse_contribution", F.when(F.col("_signed") > 0, F.col("_signed")).otherwise(F.lit(0.0)))
    )
    kept = weighed.filter((F.col("recent_weight") >= MIN_WEIGHT) & (F.col("adverse_contribution") > 0))
    whole = kept.agg(F.sum("adverse_contribution")).scalar()
    return kept.withColumn("contribution_score", F.col("adverse_contribution") / whole).drop("_total", "_signed")


def driver_order() -> list[Column]:
    """Score, then recent denominator, then dimension list order, then value; scores are rounded so that
    equal segments do not swap on floating noise."""
    return [
        F.round("contribution_score", 9).desc(), F.round("denominator_recent", 4).desc(), dimension_index().asc(),
        F.col("dimension_value").asc(),
    ]


def ranked_drivers(scored: DataFrame, limit: int = 10, per_dimension: int = PER_DIMENSION) -> DataFrame:
    """Best segments of each dimension, then best overall, with a 1-based rank."""
    best = top_per_key(scored, ["dimension_name"], driver_order(), per_dimension).orderBy(*driver_order()).limit(limit)
    return best.withColumn("contribution_rank", F.row_number().over(W.orderBy(*driver_order())))  # `limit` rows


# --------------------------------------------------------------------------- evidence and wording

PROCESS_METRICS = [  # fixed values: code, numerator, denominator, name
    ("connect_rate", "connected", "actions", "接通率"),
    ("ai_call_coverage", "ai_actions", "actions", "AI 外呼覆盖率"),
    ("manual_call_coverage", "manual_actions", "actions", "人工触达占比"),
    ("ptp_keep_rate", "kept", "promised", "PTP 履约率"),
    ("reduction_usage_rate", "reduced", "loan_count", "减免使用率"),
    ("complaint_rate", "complained", "loan_count", "投诉率"),
]


def process_evidence() -> Column:
    """Array of the six process metrics; empty unless the segment has rows in both windows."""
    items = []
    for code, num, den, name in PROCESS_METRICS:
        b = safe_rate(f"{num}_baseline", f"{den}_baseline", clipped=False, scale=None)
        r = safe_rate(f"{num}_recent", f"{den}_recent", clipped=False, scale=None)
        items.append(F.struct(
            F.lit(code).alias("metric_code"), F.lit(name).alias("metric_name_cn"), F.round(b, 6).alias("baseline_value"),
            F.round(r, 6).alias("recent_value"), F.round(r - b, 6).alias("delta"),
        ))
    both = (F.col("in_baseline") == 1) & (F.col("in_recent") == 1)
    return F.filter(F.array(*items), lambda _: both)


def evidence_array(linkage: Column) -> Column:
    """The segment's own change first, then one entry per process metric."""
    none_d, none_l, none_s = F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("string")
    segment = F.struct(
        F.lit("segment_delta").alias("method"), none_s.alias("metric_code"), none_s.alias("metric_name_cn"),
        F.round("value_baseline", 6).alias("baseline_value"), F.round("value_recent", 6).alias("recent_value"),
        F.round("delta", 6).alias("delta"), F.col("loan_count_baseline").alias("baseline_loan_count"),
        F.col("loan_count_recent").alias("recent_loan_count"), F.round("denominator_baseline", 2).alias("baseline_denominator"),
        F.round("denominator_recent", 2).alias("recent_denominator"), F.round("recent_weight", 6).alias("recent_weight"),
    )
    linked = F.transform(linkage, lambda m: F.struct(
        F.lit("driver_linkage").alias("method"), m["metric_code"].alias("metric_code"),
        m["metric_name_cn"].alias("metric_name_cn"), m["baseline_value"].alias("baseline_value"),
        m["recent_value"].alias("recent_value"), m["delta"].alias("delta"), none_l.alias("baseline_loan_count"),
        none_l.alias("recent_loan_count"), none_d.alias("baseline_denominator"), none_d.alias("recent_denominator"),
        none_d.alias("recent_weight"),
    ))
    return F.concat(F.array(segment), linked)


RESOURCE = ("vendor_id", "vendor_name", "line_id", "line_name", "region")
WORDING = [  # fixed values: dimensions, interpretation after the segment value, recommended action
    (("vendor_id", "vendor_name"), " 的 M1 D7 回收率降幅对整体下降贡献较高，需优先核查供应商执行质量。",
     "复盘该供应商近 30 天接通、PTP 履约和减免使用，必要时调整分案或补充产能。"),
    (("line_id", "line_name", "region"), " 对回收率下降贡献较高，可能与线路资源、区域案源结构或产能压力有关。",
     "按线路核查人均案量、在催案件和催员可用产能，优先处理高贡献线路。"),
    (("risk_level", "balance_segment", "score_band", "dpd_bucket"), " 客群组内回收表现恶化，是资产结构或客户风险迁徙层面的重要信号。",
     "对该客群单独设定触达、减免和 PTP 跟进策略，不改变指标口径。"),
    (("ai_call_coverage", "manual_call_coverage", "ptp_keep_rate", "reduction_usage_rate", "complaint_rate"),
     " 对应的过程执行状态与回收率下降同步出现，支持过程指标作为解释链路。",
     "定位对应案件集合，检查触达策略、承诺还款跟进、减免授权或投诉管控是否发生变化。"),
]
OTHER_WORDING = (" 分组的回收率下降对整体异常有可量化贡献。", "继续按该维度下钻到供应商、线路和客群组合，验证是否存在集中异常。")  # fixed values
BUCKET_NOTE = "按 M1 dpd_bucket 过滤后解释 recovery_rate_d7，未重新定义指标口径。"  # fixed value


def wording(index: int) -> Column:
    out = None
    for entry in WORDING:
        hit = F.col("dimension_name").isin(list(entry[0]))
        out = F.when(hit, F.lit(entry[index])) if out is None else out.when(hit, F.lit(entry[index]))
    return out.otherwise(F.lit(OTHER_WORDING[index - 1]))


def confidence(linkage: Column) -> Column:
    """High for a resource dimension when a process metric fell or complaints rose, else medium."""
    fell = F.exists(linkage, lambda m: m["delta"] < 0)
    rose = F.exists(linkage, lambda m: (m["metric_code"] == "complaint_rate") & (m["delta"] > 0))
    return F.when(F.col("dimension_name").isin(list(RESOURCE)) & (fell | rose), "high").otherwise("medium")


#: Read by both the fact and the overall rate, so written once, for the days of the windows only.
WINDOW_TABLES = ("dws_loan_status_snapshot_di", "dwd_due_plan_detail_di")


def newest_due_day(wh, days: int = 60) -> datetime.date | None:
    """The newest day of an M1 loan, from dates and buckets alone; all windows end with it.

    Where plans are built here, the last ``days`` days of due dates are looked through first, then ever longer spans: a day
    found in a span is the newest of all, as no plan of a later day lies outside it.
    """
    def newest(w) -> datetime.date | None:
        built = not w.strict and not w.source.has("dws_loan_status_snapshot_di")
        rows = w["dwd_due_plan_detail_di" if built else "dws_loan_status_snapshot_di"]
        return rows.filter(F.col("dpd_bucket") == "M1").agg(F.max(F.to_date("stat_date"))).first()[0]

    if wh.strict or any(wh.source.has(n) for n in ("dws_loan_status_snapshot_di", "dwd_due_plan_detail_di")):
        return newest(wh)
    plans = wh["ods_repayment_plan"]
    if not isinstance(plans.schema["due_date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return newest(wh)
    first, last = plans.agg(F.min(F.to_date("due_date")), F.max(F.to_date("due_date"))).first()
    while last is not None and days < (last - first).days:
        day = newest(type(wh)(DatedSource(wh.source, last - datetime.timedelta(days=days))))
        if day is not None:
            return day
        days *= 8
    return newest(wh)


class Attribution:
    """One attribution run; each step is a DataFrame that can be looked at on its own."""

    def __init__(self, wh, recent_days: int = 30, baseline_days: int = 30) -> None:
        self.wh = wh
        newest = newest_due_day(type(wh)(wh.source, strict=wh.strict))  # nothing is staged for it
        self.bounds = bounds_from(F.lit(newest).cast("date"), recent_days, baseline_days)
        self.windowed = wh
        if newest is not None:
            first = newest - datetime.timedelta(days=recent_days + baseline_days - 1)
            self.windowed = type(wh)(DatedSource(wh.source, first), strict=wh.strict, shared=WINDOW_TABLES)
            self.windowed.notes = wh.notes

    @cached_property
    def window_fact(self) -> DataFrame:
        """The recovery fact of the windows; made when first asked for, since that writes some of its tables."""
        return recovery_fact(self.windowed).filter(self.bounds.in_either("stat_date"))

    @cached_property
    def fact(self) -> DataFrame:
        """The recovery fact of all days."""
        return recovery_fact(self.wh)

    @property
    def overall(self) -> DataFrame:
        return overall_rates(self.windowed["dws_loan_status_snapshot_di"].filter(F.col("dpd_bucket") == "M1"), self.bounds)

    @cached_property
    def segments(self) -> DataFrame:
        # A few rows per dimension value, written once because totals, filter and ranking all read them.
        periods = stage(segment_periods(self.window_fact, self.bounds), "segment-periods")
        # The days outside the windows matter only to a dimension whose one value there may have others elsewhere.
        single = single_valued(periods)
        return segment_deltas(periods, with_several_values(self.fact, single) if single else ())

    @property
    def scored(self) -> DataFrame:
        return score_contributions(self.segments, self.overall.select("total_delta").scalar())

    def drivers(self, limit: int = 10) -> DataFrame:
        return ranked_drivers(self.scored, limit).withColumn("linkage", process_evidence())

    def results(self, target: DataFrame | None = None, metric: str = "recovery_rate_d7", limit: int = 10) -> DataFrame:
        """The result records; ``target`` is the finding being explained (at most one row)."""
        inferred = F.lit(f"M3B-{metric}-inferred")
        target_id = inferred if target is None else F.coalesce(target.agg(F.max("anomaly_id")).scalar(), inferred)
        drivers = self.drivers(limit)  # before the notes are read, as it makes them
        notes = [F.lit(n) for n in dict.fromkeys(self.wh.notes)]
        if metric == "recovery_rate_d7":
            notes.append(F.lit(BUCKET_NOTE))
        return drivers.select(
            F.format_string(f"M3B-{metric}-%02d", "contribution_rank").alias("attribution_id"),
            target_id.alias("target_anomaly_id"),
            F.lit(metric).alias("target_metric_code"),
            F.lit("D7 回收率").alias("target_metric_name_cn"),
            "dimension_name", "dimension_value",
            F.round("value_baseline", 6).alias("baseline_value"),
            F.round("value_recent", 6).alias("recent_value"),
            F.round("contribution_score", 6).alias("contribution_score"),
            "contribution_rank",
            evidence_array(F.col("linkage")).alias("evidence"),
            F.concat("dimension_value", wording(1)).alias("business_interpretation"),
            wording(2).alias("recommended_action"),
            confidence(F.col("linkage")).alias("confidence"),
            F.array(*notes).cast("array<string>").alias("notes"),
        )
