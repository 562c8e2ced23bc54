"""The 26 daily metrics and the dashboard that stacks them.

Metrics that share a source are computed together: seven aggregates replace 26 passes. The dashboard
unions the seven narrow results and groups once by date, so a query that needs three metrics still prunes
every column the other 23 would have read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.functions.dates import hours_between
from duewise.functions.rates import clip, flag_sum, safe_rate, total
from duewise.operators.ordering import drop_null_keys
from duewise.operators.windows import cap_at, max_date

BASELINE_RECOVERY_WITHOUT_REDUCTION = 0.82  # fixed value
VALID_CALL_SECONDS = 60  # fixed value
OVER_FREQUENCY_LIMIT = 3  # fixed value
RISK_TEMPLATE = "TPL_RISK_NOTICE"  # fixed value


def date_spine(*frames: DataFrame) -> DataFrame:
    """All dates that occur in any frame."""
    return reduce(DataFrame.union, [f.select("stat_date") for f in frames]).dropna().distinct()


def due_metrics(wh) -> DataFrame:
    due = drop_null_keys(wh["dwd_due_plan_detail_di"], ["stat_date"])
    return due.groupBy("stat_date").agg(
        F.countDistinct("customer_id").alias("due_account_count"),
        F.countDistinct("loan_id").alias("due_loan_count"),
        total("due_amount").alias("due_total_amount"),
    )


def entry_metrics(wh) -> DataFrame:
    due = drop_null_keys(wh["dwd_due_plan_detail_di"], ["stat_date"]).groupBy("stat_date").agg(
        F.countDistinct("customer_id").alias("due_accounts")
    )
    entered = (
        wh["dim_case"].withColumn("stat_date", F.to_date("case_create_time")).groupBy("stat_date")
        .agg(F.countDistinct("customer_id").alias("entry_accounts"))
    )
    return due.join(entered, "stat_date", "left").select(
        "stat_date", safe_rate("entry_accounts", "due_accounts").alias("collection_entry_rate")
    )


def recovery_metrics(wh) -> DataFrame:
    """Repaid within N days over outstanding, per due date; each plan counts once in the denominator."""
    from duewise.plans.warehouse import plan_recoveries

    due = drop_null_keys(wh["dwd_due_plan_detail_di"], ["stat_date"]).select(
        "plan_id", "stat_date", "due_date", "outstanding_amount"
    )
    paid = plan_recoveries(due, wh.repayments(due), [7, 15, 30])
    sums = paid.groupBy("stat_date").agg(
        *(F.sum(f"repaid_amount_d{n}").alias(f"_d{n}") for n in (7, 15, 30)),
        total("outstanding_amount").alias("_out"),
    )
    return sums.select("stat_date", *(safe_rate(f"_d{n}", "_out").alias(f"recovery_rate_d{n}") for n in (7, 15, 30)))


def m1_recovery(wh) -> DataFrame:
    loan = drop_null_keys(wh["dws_loan_status_snapshot_di"].filter(F.col("dpd_bucket") == "M1"), ["stat_date"])
    return loan.groupBy("stat_date").agg(
        safe_rate(total("repaid_amount_d7"), total("due_amount")).alias("m1_recovery_rate")
    )


def process_metrics(wh) -> DataFrame:
    """connect and PTP keep rate."""
    sums = drop_null_keys(wh["dws_collection_process_wide_di"], ["stat_date"]).groupBy("stat_date").agg(
        F.sum("action_count").alias("actions"),
        F.sum("connected_count").alias("connected"),
        F.sum("ptp_count").alias("promised"),
        F.sum("ptp_fulfilled_count").alias("kept"),
    )
    return sums.select(
        "stat_date",
        safe_rate("connected", "actions").alias("connect_rate"),
        safe_rate("kept", "promised").alias("ptp_keep_rate"),
    )


def valid_calls(wh) -> DataFrame:
    """Actions with their call length; a contact is valid when connected for at least a minute."""
    calls = wh["ods_call_record"].select("action_id", F.expr("try_cast(duration_seconds as double)").alias("_seconds"))
    seconds = F.coalesce("_seconds", F.lit(0.0))
    return (
        wh["dwd_collection_action_detail_di"]
        .join(calls, "action_id", "left")
        .select(
            F.col("action_date").alias("stat_date"), "action_id", "case_id", "collector_id", "connected_flag",
            "ptp_flag", seconds.alias("duration_seconds"),
            (F.coalesce("connected_flag", F.lit(False)) & (seconds >= VALID_CALL_SECONDS)).alias("valid_contact_flag"),
        )
    )


def call_metrics(wh) -> DataFrame:
    valid = drop_null_keys(valid_calls(wh), ["stat_date"])
    seconds = F.col("duration_seconds")
    sums = valid.groupBy("stat_date").agg(
        flag_sum("valid_contact_flag").alias("valid"),
        flag_sum("connected_flag").alias("connected"),
        flag_sum("ptp_flag").alias("promised"),
        F.sum(F.when(seconds > 0, seconds)).alias("talk"),
        F.count_if(seconds > 0).alias("calls"),
        F.countDistinct(F.when(seconds > 0, F.col("collector_id"))).alias("talkers"),
    )
    return sums.select(
        "stat_date",
        safe_rate("valid", "connected").alias("valid_contact_rate"),
        safe_rate("promised", "valid").alias("ptp_rate"),
        # No call that day means no row for these two metrics; the dashboard then shows 0.
        F.when(F.col("calls") > 0, safe_rate("talk", "calls", clipped=False, scale=4)).alias("avg_call_duration_per_call"),
        F.when(F.col("calls") > 0, safe_rate("talk", "talkers", clipped=False, scale=4)).alias(
            "avg_call_duration_per_collector"
        ),
    )


def first_contact(wh) -> DataFrame:
    """Mean hours from case creation to the case's first action of the day, negative means lifted to 0."""
    first = (
        drop_null_keys(wh["dwd_collection_action_detail_di"], ["action_date", "case_id"])
        .groupBy(F.col("action_date").alias("stat_date"), "case_id")
        .agg(F.min("action_time").alias("first_time"))
    )
    created = wh["dim_case"].select("case_id", "case_create_time")
    hours = first.join(created, "case_id", "left").select(
        "stat_date", hours_between("first_time", "case_create_time").alias("hours")
    )
    return hours.groupBy("stat_date").agg(F.round(clip(F.avg("hours"), 0.0), 4).alias("first_contact_hours"))


def contact_metrics(wh) -> DataFrame:
    """Over-frequency rate from a per-case count, risk template rate from the same pass."""
    action = drop_null_keys(wh["dwd_collection_action_detail_di"], ["action_date"])
    checked = F.col("action_type").isin("SMS", "CALL", "AI_OUTBOUND")
    per_case = action.groupBy(F.col("action_date").alias("stat_date"), "case_id").agg(
        F.count("action_id").alias("actions"),
        F.count(F.when(checked, F.col("action_id"))).alias("checked"),
        F.count_if(checked & (F.col("template_id") == RISK_TEMPLATE)).alias("risky"),
    )
    sums = per_case.groupBy("stat_date").agg(
        F.count_if(F.col("case_id").isNotNull() & (F.col("actions") > OVER_FREQUENCY_LIMIT)).alias("over"),
        F.count("case_id").alias("contacted"),
        F.sum("checked").alias("checked"),
        F.sum("risky").alias("risky"),
    )
    return sums.select(
        "stat_date",
        safe_rate("over", "contacted").alias("over_frequency_contact_rate"),
        F.when(F.col("checked") > 0, safe_rate("risky", "checked")).alias("risk_phrase_hit_rate"),
    )


def qa_metrics(wh) -> DataFrame:
    checked = (
        drop_null_keys(wh["dwd_collection_action_detail_di"], ["action_date"])
        .filter(F.col("action_type").isin("CALL", "AI_OUTBOUND"))
        .groupBy(F.col("action_date").alias("stat_date"))
        .agg(F.count("action_id").alias("checked"))
    )
    failed = (
        drop_null_keys(wh["dwd_complaint_detail_di"], ["complaint_date"])
        .filter(F.col("complaint_level").isin("MEDIUM", "HIGH"))
        .groupBy(F.col("complaint_date").alias("stat_date"))
        .agg(F.count("complaint_id").alias("failed"))
    )
    return checked.join(failed, "stat_date", "left").select(
        "stat_date", safe_rate("failed", "checked").alias("qa_fail_rate")
    )


#: The side of the case status that each of its metrics needs besides the assigned cases.
CASE_SIDES = {
    "call_coverage_rate": "called", "valid_coverage_rate": "valid", "complaint_rate": "complaints",
    "complaint_per_10k_cases": "complaints", "reduction_usage_rate": "used",
}


def case_metrics(wh, codes: Sequence[str] | None = None) -> DataFrame:
    """Metrics whose denominator is the daily case status: coverage, productivity, complaints, concessions.

    ``codes`` limits them, and the tables that are read, to those asked for.
    """
    status = drop_null_keys(wh["dws_case_status_snapshot_di"], ["stat_date"])
    assigned = status.groupBy("stat_date").agg(
        F.countDistinct("case_id").alias("assigned"),
        F.countDistinct("collector_id").alias("collectors"),
        total("repaid_amount").alias("repaid"),
    )
    called = wh["dws_collection_process_wide_di"].groupBy("stat_date").agg(F.countDistinct("case_id").alias("called"))
    valid = valid_calls(wh).filter("valid_contact_flag").groupBy("stat_date").agg(F.countDistinct("case_id").alias("valid"))
    complaints = (
        wh["dwd_complaint_detail_di"].groupBy(F.col("complaint_date").alias("stat_date"))
        .agg(F.countDistinct("case_id").alias("complaint_cases"), F.count("complaint_id").alias("complaints"))
    )
    applications = wh["ods_reduction_application"].withColumn("stat_date", F.to_date("apply_time"))
    used = applications.groupBy("stat_date").agg(F.countDistinct("case_id").alias("reduced"))
    sides = {"called": called, "valid": valid, "complaints": complaints, "used": used}
    wanted = {CASE_SIDES.get(c) for c in (CASE_SIDES if codes is None else codes)}
    joined = assigned
    for name, side in sides.items():
        if name in wanted:
            joined = joined.join(side, "stat_date", "left")
    rates = [
        safe_rate("called", "assigned").alias("call_coverage_rate"),
        safe_rate("valid", "assigned").alias("valid_coverage_rate"),
        safe_rate("repaid", "collectors", clipped=False, scale=4).alias("collector_productivity"),
        safe_rate("complaint_cases", "assigned").alias("complaint_rate"),
        F.coalesce(
            F.round(safe_rate("complaints", "assigned", clipped=False, scale=None) * 10000, 4), F.lit(0.0)
        ).alias("complaint_per_10k_cases"),
        safe_rate("reduced", "assigned").alias("reduction_usage_rate"),
    ]
    if codes is None:
        return joined.select("stat_date", *rates)
    named = dict(zip(CASE_CODES, rates, strict=True))
    return joined.select("stat_date", *(named[c] for c in codes))


def reduction_recovery(wh) -> DataFrame:
    reduced = (
        wh["ods_reduction_application"].select(F.to_date("apply_time").alias("stat_date"), "case_id").dropna().distinct()
    )
    joined = wh["dws_case_status_snapshot_di"].join(reduced, ["stat_date", "case_id"], "left_semi")
    return joined.groupBy("stat_date").agg(
        safe_rate(total("repaid_amount"), total("outstanding_amount")).alias("reduction_recovery_rate")
    )


def reduction_roi(wh, baseline: float = BASELINE_RECOVERY_WITHOUT_REDUCTION) -> DataFrame:
    """Uplift over approved amount; all repayments of the day count, not only those of reduced cases."""
    approved = (
        drop_null_keys(wh["ods_reduction_application"].withColumn("stat_date", F.to_date("apply_time")), ["stat_date"])
        .groupBy("stat_date")
        .agg(total("approved_amount").alias("approved"))
    )
    repaid = drop_null_keys(wh["dws_case_status_snapshot_di"], ["stat_date"]).groupBy("stat_date").agg(
        total("repaid_amount").alias("repaid")
    )
    actual = F.coalesce("repaid", F.lit(0.0))
    return approved.join(repaid, "stat_date", "left").select(
        "stat_date",
        safe_rate(actual - actual * F.lit(baseline), "approved", clipped=False).alias("reduction_roi"),
    )


#: The metrics of :func:`case_metrics`, in its order.
CASE_CODES = (
    "call_coverage_rate", "valid_coverage_rate", "collector_productivity", "complaint_rate", "complaint_per_10k_cases", "reduction_usage_rate",
)


@dataclass(frozen=True)
class Family:
    """Metrics produced by one aggregate."""

    build: Callable[..., DataFrame]
    codes: tuple[str, ...]


FAMILIES = (
    Family(due_metrics, ("due_account_count", "due_loan_count", "due_total_amount")),
    Family(entry_metrics, ("collection_entry_rate",)),
    Family(recovery_metrics, ("recovery_rate_d7", "recovery_rate_d15", "recovery_rate_d30")),
    Family(m1_recovery, ("m1_recovery_rate",)),
    Family(process_metrics, ("connect_rate", "ptp_keep_rate")),
    Family(call_metrics, ("valid_contact_rate", "ptp_rate", "avg_call_duration_per_call", "avg_call_duration_per_collector")),
    Family(first_contact, ("first_contact_hours",)),
    Family(contact_metrics, ("over_frequency_contact_rate", "risk_phrase_hit_rate")),
    Family(qa_metrics, ("qa_fail_rate",)),
    Family(
        case_metrics,
        ("call_coverage_rate", "valid_coverage_rate", "collector_productivity", "complaint_rate",
         "complaint_per_10k_cases", "reduction_usage_rate"),
    ),
    Family(reduction_recovery, ("reduction_recovery_rate",)),
    Family(reduction_roi, ("reduction_roi",)),
)

METRIC_CODES = [  # fixed values, in dashboard order
    "due_account_count", "due_loan_count", "due_total_amount", "collection_entry_rate", "recovery_rate_d7",
    "recovery_rate_d15", "recovery_rate_d30", "m1_recovery_rate", "call_coverage_rate", "valid_coverage_rate",
    "connect_rate", "valid_contact_rate", "first_contact_hours", "ptp_rate", "ptp_keep_rate",
    "avg_call_duration_per_call", "avg_call_duration_per_collector", "collector_productivity", "complaint_rate",
    "complaint_per_10k_cases", "risk_phrase_hit_rate", "qa_fail_rate", "over_frequency_contact_rate",
    "reduction_usage_rate", "reduction_recovery_rate", "reduction_roi",
]
NOT_RATIOS = {  # fixed values: counts, amounts, durations and unbounded ratios
    "due_account_count", "due_loan_count", "due_total_amount", "first_contact_hours", "avg_call_duration_per_call",
    "avg_call_duration_per_collector", "collector_productivity", "complaint_per_10k_cases", "reduction_roi",
}
RATIO_CODES = [c for c in METRIC_CODES if c not in NOT_RATIOS]
COUNT_CODES = ("due_account_count", "due_loan_count")

REGISTRY: dict[str, Family] = {code: family for family in FAMILIES for code in family.codes}


def metric(wh, code: str) -> DataFrame:
    """Daily series ``(stat_date, code)`` of one metric; an unknown code is a ``KeyError``."""
    if code not in REGISTRY:
        raise KeyError(f"unknown metric: {code}")
    return REGISTRY[code].build(wh).select("stat_date", code).filter(F.col(code).isNotNull())


def dashboard_dates(wh) -> DataFrame:
    """The dates that any metric has, from one date column of each of four tables."""
    dates = (
        wh["dwd_due_plan_detail_di"].select("stat_date"), wh["dwd_collection_action_detail_di"].select(F.col("action_date").alias("stat_date")),
        wh["dws_case_status_snapshot_di"].select("stat_date"), wh["ods_reduction_application"].select(F.to_date("apply_time").alias("stat_date")),
    )
    return date_spine(*(d.distinct() for d in dates))


def dashboard(wh, codes: Sequence[str] | None = None) -> DataFrame:
    """All metrics per date; a date that only some metrics have shows 0 for the others.

    With ``codes`` only the families of those metrics are built; every other family gives its dates alone.
    """
    wanted = list(METRIC_CODES if codes is None else codes)
    if codes is None:
        parts = [family.build(wh) for family in FAMILIES]
    else:
        asked = [(family, [c for c in family.codes if c in wanted]) for family in FAMILIES]
        parts = [(f.build(wh, own) if f.build is case_metrics else f.build(wh)).select("stat_date", *own) for f, own in asked if own]
        parts.append(dashboard_dates(wh))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Each (date, metric) occurs at most once, so max() only picks it.
    wide = drop_null_keys(stacked, ["stat_date"]).groupBy("stat_date").agg(*(F.max(c).alias(c) for c in wanted))
    filled = wide.select(
        "stat_date",
        *(F.coalesce(c, F.lit(0).cast("long") if c in COUNT_CODES else F.lit(0.0)).alias(c) for c in wanted),
    )
    return cap_at(filled, max_date(wh["dws_case_status_snapshot_di"]))
