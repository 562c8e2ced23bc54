"""The data-quality suite of the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.operators import constraints as cs
from duewise.operators import quality as q
from duewise.plans.metrics import METRIC_CODES, RATIO_CODES
from duewise.plans.warehouse import BUILDERS
from duewise.schemas import PRIMARY_KEYS
from duewise.sources.tables import layer_of

FOREIGN_KEYS = [  # fixed values: child table, column, parent table, column
    ("dim_loan", "customer_id", "dim_customer", "customer_id"), ("dim_case", "customer_id", "dim_customer", "customer_id"),
    ("dim_case_loan_mapping", "customer_id", "dim_customer", "customer_id"), ("dim_case_loan_mapping", "loan_id", "dim_loan", "loan_id"),
    ("dim_case_loan_mapping", "case_id", "dim_case", "case_id"), ("dim_collection_line", "vendor_id", "dim_vendor", "vendor_id"),
    ("dim_collector", "line_id", "dim_collection_line", "line_id"), ("ods_repayment_plan", "loan_id", "dim_loan", "loan_id"),
    ("ods_repayment_detail", "plan_id", "ods_repayment_plan", "plan_id"), ("ods_collection_action", "case_id", "dim_case", "case_id"),
    ("ods_collection_action", "vendor_id", "dim_vendor", "vendor_id"), ("ods_collection_action", "line_id", "dim_collection_line", "line_id"),
    ("ods_collection_action", "collector_id", "dim_collector", "collector_id"), ("ods_collection_note", "case_id", "dim_case", "case_id"),
    ("ods_assignment_decision_log", "case_id", "dim_case", "case_id"), ("ods_complaint", "case_id", "dim_case", "case_id"),
]
KEYED = [
    "dim_customer", "dim_loan", "dim_case", "dim_vendor", "dim_collection_line", "dim_collector", "dim_case_loan_mapping",
    "ods_case_daily_snapshot", "ods_customer_daily_snapshot",
]
AMOUNT_TABLES = ["dim_loan", "dim_case", "ods_repayment_plan", "ods_repayment_detail", "ods_reduction_application",
                 "dws_customer_status_snapshot_di", "dws_case_status_snapshot_di"]
RATE_TABLES = ["dws_loan_status_snapshot_di", "dws_collection_process_wide_di", "ads_vendor_performance_di"]
SNAPSHOTS = ["ods_case_daily_snapshot", "ods_customer_daily_snapshot"]
OTHER_TABLES = ("ods_repayment_detail", "ods_call_record", "ods_sms_send_log", "ods_case_flow", "ods_loan_daily_snapshot")
CENT = 0.005


def catalogue(wh, layer: str) -> list[str]:
    """The tables of a layer that the warehouse has: those with a declared key, a reference or a builder."""
    known = {*PRIMARY_KEYS, *BUILDERS, *OTHER_TABLES, *(t for c, _, p, _ in FOREIGN_KEYS for t in (c, p))}
    return [t for t in sorted(known) if layer_of(t) == layer and wh.has(t)]


def constraints(wh, layer: str) -> DataFrame:
    """Key, amount, rate, privacy and column rules of every table of a layer.

    Rates are bound to [0, 1] in the subject and application layers, clear personal fields are barred from detail on.
    """
    parts = []
    for name in catalogue(wh, layer):
        required = METRIC_CODES if name == "ads_postloan_dashboard_di" else ()
        rules = cs.rules_by_name(
            wh[name], name, PRIMARY_KEYS.get(name, ()), rates=layer in ("dws", "ads"), no_personal=layer in ("dwd", "dws", "ads"), required=required
        )
        parts.append(cs.evaluate(wh[name], rules))
    return q.stack(parts)


def references(wh) -> DataFrame:
    """All declared references, those of absent tables included."""
    declared = [cs.Reference(*r) for r in FOREIGN_KEYS]
    names = dict.fromkeys(t for r in declared for t in (r.child, r.parent))
    return cs.unmet_references({t: wh[t] for t in names if wh.has(t)}, declared)


def primary_keys(wh) -> DataFrame:
    return q.stack([q.duplicate_keys(wh[t], PRIMARY_KEYS[t], t) for t in KEYED])


def foreign_keys(wh) -> DataFrame:
    """Every declared reference whose two tables exist."""
    return q.stack([
        q.missing_parents(wh[c], ck, wh[p], pk, f"{c}.{ck}") for c, ck, p, pk in FOREIGN_KEYS if wh.has(c) and wh.has(p)
    ])


def amounts(wh) -> DataFrame:
    return q.stack([q.negative_amounts(wh[t], t) for t in AMOUNT_TABLES])


def date_order(wh) -> DataFrame:
    """Payments and due dates before the loan was disbursed."""
    loan = wh["dim_loan"].select("loan_id", F.col("disburse_time").cast("timestamp_ntz").alias("_start"))
    paid = wh["ods_repayment_detail"].groupBy("loan_id", "repay_time").agg(F.count(F.lit(1)).alias("_n"))
    early_pay = paid.join(loan, "loan_id").filter(F.col("repay_time") < F.col("_start")).agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("bad_count")
    )
    early_due = wh["ods_repayment_plan"].join(loan, "loan_id").agg(
        F.count_if(F.col("due_date").cast("timestamp_ntz") < F.col("_start")).alias("bad_count")
    )
    return early_pay.select(F.lit("repay_time").alias("check_name"), "bad_count").unionByName(
        early_due.select(F.lit("due_date").alias("check_name"), "bad_count")
    )


def rates(wh) -> DataFrame:
    return q.stack([q.rates_out_of_range(wh[t], t) for t in RATE_TABLES])


def dashboard_ratios(wh) -> DataFrame:
    return q.rates_out_of_range(wh["ads_postloan_dashboard_di"], "ads_postloan_dashboard_di", RATIO_CODES)


def core_metrics_present(wh) -> DataFrame:
    return q.all_null(wh["ads_postloan_dashboard_di"], METRIC_CODES, "ads_postloan_dashboard_di")


def dashboard_columns_missing(wh) -> list[str]:
    return q.missing_columns(wh["ads_postloan_dashboard_di"], METRIC_CODES)


def unmapped_cases(wh) -> DataFrame:
    return q.missing_parents(wh["dim_case"], "case_id", wh["dim_case_loan_mapping"], "case_id", "dim_case.case_id")


def snapshot_gaps(wh) -> DataFrame:
    return q.stack([q.empty_days(wh[t], t) for t in [*SNAPSHOTS, "dws_loan_status_snapshot_di"]])


def trends(wh) -> DataFrame:
    board = wh["ads_postloan_dashboard_di"]
    worst = wh["ads_vendor_performance_di"].filter(F.col("vendor_id") == "V_EUROPE")
    return q.stack([
        q.tail_means(board, "m1_recovery_rate", "m1_recovery_rate"),
        q.tail_means(worst, "connect_rate", "connect_rate V_EUROPE"),
        q.tail_means(board, "reduction_usage_rate", "reduction_usage_rate"),
    ])


def snapshot_invariants(wh) -> DataFrame:
    """Outstanding never rises, equals due less repaid, no DPD when paid, customer total = sum of its cases.

    Where the snapshot is built here its days are made by loan in the tasks that check them: they are neither written nor
    shuffled, and what they hold is counted by loan and amounts before it meets the plans.
    """
    from duewise.plans.daily_state import case_daily_state, customer_daily_state

    name = "ods_loan_daily_snapshot"
    loans, given = wh[name], wh.strict or wh.source.has(name)
    plan = wh["ods_repayment_plan"].groupBy("loan_id").agg(F.sum("due_amount").alias("due_amount"))
    expected = F.greatest(F.col("due_amount") - F.col("cumulative_repaid"), F.lit(0.0))
    amounts = loans.groupBy("loan_id", "outstanding_amount", "cumulative_repaid").agg(F.count(F.lit(1)).alias("_days"))
    off = F.abs(F.col("outstanding_amount") - expected) > CENT
    wrong = amounts.join(plan, "loan_id").agg(F.coalesce(F.sum(F.when(off, F.col("_days"))), F.lit(0)).alias("bad_count"))
    owing = loans.agg(F.count_if((F.col("outstanding_amount") <= 0) & (F.col("dpd") > 0)).alias("bad_count"))
    by_case = case_daily_state(wh, loans if given else None).groupBy("stat_date", "customer_id").agg(F.sum("outstanding_amount").alias("_sum"))
    apart = customer_daily_state(wh).join(by_case, ["stat_date", "customer_id"]).agg(
        F.count_if(F.abs(F.col("total_outstanding_amount") - F.col("_sum")) > 2 * CENT).alias("bad_count")
    )
    named = [
        ("outstanding_rises", q.rises(loans, ["loan_id"], "outstanding_amount")), ("outstanding_is_due_less_repaid", wrong),
        ("dpd_when_paid", owing), ("customer_total_is_case_sum", apart),
    ]
    return q.stack([df.select(F.lit(name).alias("check_name"), "bad_count") for name, df in named])


def score_ordering(wh) -> DataFrame:
    return q.group_means_ordered(wh["ods_postloan_c_score"], "score_level", "postloan_c_score", ["D", "C", "B", "A"])
