"""Leakage-safe features and labels for the seven-day recovery models.

Everything on the feature side is looked up as of the observation date; columns that describe the outcome
are listed once and never reach the feature list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.dates import days_between, parse_date
from duewise.functions.rates import clean, clip, log_amount, rate_or_zero
from duewise.operators.joins import asof_anchors, asof_join, assert_unique, trailing_features
from duewise.operators.ordering import dedupe, latest_per_key
from duewise.plans.daily_state import loan_states_at

# The five lists below are fixed values.
FEATURE_COLUMNS = [
    "product_code", "channel_code", "loan_amount", "loan_term", "interest_rate", "mob", "vintage_month", "due_amount",
    "log_due_amount", "days_since_due_date", "dpd_x_log_due_amount", "dpd_bucket", "dpd_at_observation",
    "outstanding_at_observation", "loan_status_at_observation", "case_outstanding_at_observation",
    "case_dpd_bucket_at_observation", "case_status_at_observation", "customer_max_dpd_at_observation",
    "customer_total_outstanding_at_observation", "customer_active_case_count_at_observation", "age_group", "gender",
    "province", "city", "occupation_type", "customer_segment", "risk_level_current", "postloan_c_score",
    "score_x_connect_rate", "score_level", "initial_dpd_bucket", "initial_outstanding_amount",
    "outstanding_to_loan_ratio", "balance_segment", "protect_flag", "sensitive_flag", "current_vendor_id",
    "current_line_id", "action_count_7d", "connected_count_7d", "connect_rate_7d", "ptp_count_7d", "ptp_rate_7d",
    "days_since_last_action", "ai_action_count", "complaint_count", "ai_coverage_rate",
]
TIME_BATCH_COLUMNS = [
    "vintage_month", "first_due_date", "observation_date", "stat_date", "due_date", "case_create_date", "case_create_time",
]
LEAKAGE_COLUMNS = [
    "repaid_amount_d7", "recovery_rate_d7", "outstanding_at_d7", "outstanding_reduction_d7",
    "outstanding_reduction_rate_d7", "dpd_at_d7", "dpd_reduction_d7", "loan_status_at_d7", "case_outstanding_at_d7",
    "case_dpd_bucket_at_d7", "case_status_at_d7", "customer_total_outstanding_at_d7", "customer_max_dpd_at_d7",
    "customer_active_case_count_at_d7", "d7_end_date", "loan_state_d7_available", "repay_amount", "repay_date",
    "repay_time", "loan_status", "case_status", "ptp_fulfilled_flag", "ptp_fulfilled_count", "ptp_fulfillment_rate",
    "reduction_recovery_rate",
]
TARGET_COLUMNS = [
    "is_recovered_d7", "is_any_payment_d7", "is_cured_d7", "is_state_recovered_d7", "is_fully_recovered_d7", "case_cured_d7",
]
SENSITIVE_COLUMNS = [
    "customer_id_hash", "mobile_masked", "customer_id", "loan_id", "case_id", "id_card", "phone_no", "customer_name",
]
TARGETS = {"any_payment": "is_recovered_d7", "state_recovery": "is_state_recovered_d7"}
WINDOW_DAYS = 7
PAID_OFF = 0.01


def feature_columns(columns: list[str], exclude_time_batch: bool = False) -> list[str]:
    """Allowed features among ``columns``, less outcome, sensitive, target and (optionally) time-batch names."""
    blocked = {*LEAKAGE_COLUMNS, *SENSITIVE_COLUMNS, *TARGET_COLUMNS}
    if exclude_time_batch:
        blocked |= set(TIME_BATCH_COLUMNS)
    return [c for c in FEATURE_COLUMNS if c in columns and c not in blocked]


def leakage_guard(features: list[str]) -> dict[str, bool]:
    return {
        "pii_features_blocked": set(features).isdisjoint(SENSITIVE_COLUMNS),
        "outcome_features_blocked": set(features).isdisjoint(LEAKAGE_COLUMNS),
    }


def observations(wh) -> DataFrame:
    """One row per loan with the observation date and the any-payment label."""
    paid = (F.coalesce("repaid_amount_d7", F.lit(0.0)) > 0).cast("int")
    return wh["dws_loan_status_snapshot_di"].select(
        "loan_id", "customer_id", "product_code", "dpd_bucket", "due_amount",
        F.to_date("stat_date").alias("observation_date"), "repaid_amount_d7", "recovery_rate_d7",
        paid.alias("is_recovered_d7"), paid.alias("is_any_payment_d7"),
    )


def first_due_dates(wh) -> DataFrame:
    return wh["ods_repayment_plan"].groupBy("loan_id").agg(F.min(F.to_date("due_date")).alias("due_date"))


def main_mapping(wh) -> DataFrame:
    """Main case of each loan: flagged rows only, the latest start wins."""
    flagged = wh["dim_case_loan_mapping"].filter(F.coalesce("main_loan_flag", F.lit(False)))
    return latest_per_key(flagged, ["loan_id"], "mapping_start_date", ["case_id"]).select("loan_id", "case_id")


def score_history(wh) -> DataFrame:
    return wh["ods_postloan_c_score"].select(
        "customer_id", parse_date("score_date").alias("score_date"), "postloan_c_score", "score_level", "score_id"
    )


def score_asof(wh, rows: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Latest score dated on or before the observation; null when the customer has none by then."""
    return asof_join(
        rows, score_history(wh), ["customer_id"], "observation_date", "score_date", ["postloan_c_score", "score_level"],
        tie_break=["score_id"], slice_unit=None, anchors=anchors,
    )


def score_guard_counts(wh, base: DataFrame | None = None) -> DataFrame:
    """One row: loans with no usable score, and loans for which a later score was withheld."""
    base = observations(wh).select("loan_id", "customer_id", "observation_date") if base is None else base
    reach = score_history(wh).groupBy("customer_id").agg(
        F.min("score_date").alias("_first"), F.max("score_date").alias("_last")
    )
    scored = score_asof(wh, base).select("loan_id", "postloan_c_score")
    blocked = base.join(reach, "customer_id").filter(F.col("_last") > F.col("observation_date"))
    usable = base.join(reach, "customer_id").filter(F.col("_first") <= F.col("observation_date"))
    fallback = base.join(usable.select("loan_id"), "loan_id", "left_anti")
    return scored.agg(
        F.count_if(F.col("postloan_c_score").isNull()).alias("score_date_missing_count")
    ).withColumns({
        "score_date_fallback_count": fallback.agg(F.count(F.lit(1))).scalar(),
        "future_score_blocked_count": blocked.agg(F.countDistinct("loan_id")).scalar(),
    })


def recent_actions(wh, base: DataFrame) -> DataFrame:
    """Seven-day action counts and rates up to the observation, and days since the last action."""
    anchors = base.select("loan_id", "observation_date").join(main_mapping(wh), "loan_id", "left")
    found = trailing_features(
        anchors, wh["ods_collection_action"], ["case_id"], "observation_date", "action_time",
        {
            "action_count_7d": F.lit(1).cast("long"),
            "connected_count_7d": F.col("connected_flag").cast("long"),
            "ptp_count_7d": F.col("ptp_flag").cast("long"),
        },
        WINDOW_DAYS, last_date="last_action_date",
    )
    counts = ["action_count_7d", "connected_count_7d", "ptp_count_7d"]
    filled = found.select("loan_id", "observation_date", "last_action_date", *(
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in counts
    ))
    since = F.when(F.col("last_action_date").isNotNull(), days_between("observation_date", "last_action_date"))
    return filled.select(
        "loan_id", "action_count_7d", "connected_count_7d",
        rate_or_zero("connected_count_7d", "action_count_7d").alias("connect_rate_7d"),
        "ptp_count_7d", rate_or_zero("ptp_count_7d", "action_count_7d").alias("ptp_rate_7d"),
        since.alias("days_since_last_action"),
    )


PROCESS_SUMS = [
    "action_count", "connected_count", "ai_action_count", "ptp_count", "ptp_fulfilled_count", "complaint_count"
]


def case_features(wh) -> DataFrame:
    """Case attributes per loan, with process sums of the seven days up to the case's creation."""
    case = wh["dim_case"].select(
        "case_id", F.to_date("case_create_time").alias("_created"), "initial_dpd_bucket", "initial_outstanding_amount",
        "balance_segment", "protect_flag", "sensitive_flag", "current_vendor_id", "current_line_id",
    )
    process = trailing_features(
        case.select("case_id", "_created"), wh["dws_collection_process_wide_di"], ["case_id"], "_created", "stat_date",
        {c: F.col(c) for c in PROCESS_SUMS}, WINDOW_DAYS,
    ).drop("_created")
    joined = main_mapping(wh).join(case, "case_id", "left").join(process, "case_id", "left")
    return joined.select(
        "loan_id", "initial_dpd_bucket", "initial_outstanding_amount", "balance_segment", "protect_flag",
        "sensitive_flag", "current_vendor_id", "current_line_id",
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PROCESS_SUMS),
        rate_or_zero("connected_count", "action_count").alias("connect_rate"),
        rate_or_zero("ai_action_count", "action_count").alias("ai_coverage_rate"),
        rate_or_zero("ptp_fulfilled_count", "ptp_count").alias("ptp_fulfillment_rate"),
    )


def state_targets(wh, base: DataFrame) -> DataFrame:
    """Loan, case and customer state at the observation and seven days later, and the labels they imply."""
    keyed = base.select("loan_id", "customer_id", "observation_date", "repaid_amount_d7").withColumn(
        "d7_end_date", F.date_add("observation_date", WINDOW_DAYS)
    ).join(main_mapping(wh), "loan_id", "left")
    at = {"observation": "observation_date", "d7": "d7_end_date"}
    loan = loan_states_at(wh, keyed, at)
    case = asof_anchors(
        keyed.select("loan_id", "case_id", *at.values()), wh["ods_case_daily_snapshot"], ["case_id"], at, "stat_date",
        ["outstanding_amount", "dpd_bucket", "case_status"], ["loan_id"],
    )
    customer = asof_anchors(
        keyed.select("loan_id", "customer_id", *at.values()), wh["ods_customer_daily_snapshot"], ["customer_id"], at, "stat_date",
        ["max_dpd", "total_outstanding_amount", "active_case_count"], ["loan_id"],
    )
    found = (
        case.withColumnRenamed("state", "case").unionByName(customer.withColumnRenamed("state", "customer"), allowMissingColumns=True)
        .groupBy("loan_id").agg(*(
            F.max(F.when(F.col("anchor") == suffix, F.col(side))).alias(f"{side}_{suffix}") for suffix in at for side in ("case", "customer")
        ))
    )
    out = keyed.join(loan, "loan_id", "left").join(found, "loan_id", "left").select(*keyed.columns, *(c for suffix in at for c in (
        F.col(f"{suffix}.snapshot_date").alias(f"snapshot_date_{suffix}"), F.col(f"{suffix}.dpd").alias(f"dpd_at_{suffix}"),
        F.col(f"{suffix}.outstanding_amount").alias(f"outstanding_at_{suffix}"), F.col(f"{suffix}.loan_status").alias(f"loan_status_at_{suffix}"),
        F.col(f"case_{suffix}.outstanding_amount").alias(f"case_outstanding_at_{suffix}"),
        F.col(f"case_{suffix}.dpd_bucket").alias(f"case_dpd_bucket_at_{suffix}"), F.col(f"case_{suffix}.case_status").alias(f"case_status_at_{suffix}"),
        F.col(f"customer_{suffix}.max_dpd").alias(f"customer_max_dpd_at_{suffix}"),
        F.col(f"customer_{suffix}.total_outstanding_amount").alias(f"customer_total_outstanding_at_{suffix}"),
        F.col(f"customer_{suffix}.active_case_count").alias(f"customer_active_case_count_at_{suffix}"),
    )))
    before, after = F.col("outstanding_at_observation"), F.col("outstanding_at_d7")
    reduction = clip(before - after, 0.0)
    fell = F.coalesce(F.col("outstanding_reduction_d7") > 0, F.lit(False))
    clear = F.coalesce(F.col("dpd_at_d7") == 0, F.lit(False))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return out.withColumn("outstanding_reduction_d7", reduction).withColumns({
        "loan_state_observation_available": F.col("dpd_at_observation").isNotNull(),
        "loan_state_d7_available": F.col("dpd_at_d7").isNotNull(),
        "outstanding_reduction_rate_d7": rate_or_zero("outstanding_reduction_d7", "outstanding_at_observation"),
        "dpd_reduction_d7": F.greatest(F.col("dpd_at_observation") - F.col("dpd_at_d7"), F.lit(0)),
        "is_cured_d7": flag((F.col("dpd_at_observation") > 0) & clear & fell),
        "is_state_recovered_d7": flag(clear & fell & (F.coalesce("repaid_amount_d7", F.lit(0.0)) > 0)),
        "is_fully_recovered_d7": flag((before > 0) & (after <= PAID_OFF)),
        "case_cured_d7": flag(
            F.coalesce(F.col("case_status_at_d7").isin("cured", "closed"), F.lit(False))
            | F.coalesce(F.col("case_outstanding_at_d7") <= PAID_OFF, F.lit(False))
        ),
    })


def snapshot_coverage(wh, states: DataFrame | None = None) -> DataFrame:
    """One row: how many loans have both snapshots, and how many matched on the exact day."""
    rows = state_targets(wh, observations(wh)) if states is None else states
    seen, later = F.col("loan_state_observation_available"), F.col("loan_state_d7_available")
    return rows.agg(
        F.count_if(seen & later).alias("d7_state_complete_count"),
        F.count_if(~(seen & later)).alias("d7_state_missing_count"),
        F.count_if(seen).alias("loan_observation_snapshot_match_count"),
        F.count_if(later).alias("loan_d7_snapshot_match_count"),
        F.count_if(F.col("snapshot_date_observation") == F.col("observation_date")).alias("loan_observation_exact_snapshot_count"),
        F.count_if(F.col("snapshot_date_d7") == F.col("d7_end_date")).alias("loan_d7_exact_snapshot_count"),
    )


def dataset(wh, target: str = "any_payment", exclude_time_batch: bool = False, check_keys: bool = False) -> DataFrame:
    """Model rows: loan, observation date, label and the allowed features."""
    if target not in TARGETS:
        raise ValueError(f"unsupported target: {target}")
    base = observations(wh)
    if check_keys:
        assert_unique(base, ["loan_id"], "loan status")
    rows = base
    if target == "state_recovery":
        states = state_targets(wh, base).drop("repaid_amount_d7", "case_id")
        rows = rows.join(states, ["loan_id", "customer_id", "observation_date"], "left").filter(
            F.col("loan_state_observation_available") & F.col("loan_state_d7_available")
        )
    loan = dedupe(wh["dim_loan"], ["loan_id"], ["customer_id"]).select(
        "loan_id", "channel_code", "loan_amount", "loan_term", "interest_rate", "mob", "vintage_month"
    )
    customer = dedupe(wh["dim_customer"], ["customer_id"], ["customer_segment"]).select(
        "customer_id", "gender", "age_group", "province", "city", "occupation_type", "customer_segment", "risk_level_current"
    )
    rows = (
        rows.join(first_due_dates(wh), "loan_id", "left")
        .join(loan, "loan_id", "left")
        .join(customer, "customer_id", "left")
    )
    rows = score_asof(wh, rows, anchors=base)
    rows = rows.join(case_features(wh), "loan_id", "left").join(recent_actions(wh, base), "loan_id", "left")
    zero_filled = [
        "action_count_7d", "connected_count_7d", "ai_action_count", "ptp_count_7d", "ptp_fulfilled_count", "complaint_count",
        "connect_rate_7d", "ptp_rate_7d", "ai_coverage_rate", "ptp_fulfillment_rate",
    ]
    rows = rows.withColumns({
        "log_due_amount": log_amount("due_amount"),
        "days_since_due_date": days_between("observation_date", "due_date"),
        "score_x_connect_rate": clean("postloan_c_score") / 100.0 * F.coalesce("connect_rate_7d", F.lit(0.0)),
        "outstanding_to_loan_ratio": rate_or_zero("initial_outstanding_amount", "loan_amount"),
        "protect_flag": F.col("protect_flag").cast("double"),
        "sensitive_flag": F.col("sensitive_flag").cast("double"),
        **{c: F.coalesce(c, F.lit(0.0)) for c in zero_filled},
    }).withColumn("dpd_x_log_due_amount", F.col("days_since_due_date") * F.col("log_due_amount"))
    features = feature_columns(rows.columns, exclude_time_batch)
    outcomes = [c for c in [*LEAKAGE_COLUMNS, *TARGET_COLUMNS] if target == "state_recovery" and c in rows.columns]
    keep = list(dict.fromkeys(["loan_id", "observation_date", TARGETS[target], *outcomes, *features]))
    return rows.select(*keep)


def split_features_label(df: DataFrame, target: str = "any_payment", exclude_time_batch: bool = False) -> DataFrame:
    label = TARGETS[target]
    return df.select("loan_id", *feature_columns(df.columns, exclude_time_batch), F.col(label).cast("int").alias(label))


def dataset_summary(df: DataFrame, target: str = "any_payment", exclude_time_batch: bool = False) -> DataFrame:
    """One-row metadata: rows, positive rate and number of features."""
    label = TARGETS[target]
    return df.agg(
        F.count(F.lit(1)).alias("sample_count"), F.coalesce(F.avg(label), F.lit(0.0)).alias("positive_rate"),
        F.lit(len(feature_columns(df.columns, exclude_time_batch))).alias("feature_count"),
    ).withColumns({"target": F.lit(target), "target_column": F.lit(label), "exclude_time_batch": F.lit(exclude_time_batch)})


def readiness(wh) -> DataFrame:
    """Rows and positive rate of the three candidate labels."""
    first = observations(wh).agg(
        F.lit("d7_any_payment_response").alias("target_id"), F.lit("selected_for_baseline").alias("decision"),
        F.lit("loan_id").alias("grain"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.avg("is_recovered_d7"), F.lit(0.0)).alias("positive_rate"),
    )
    states = state_targets(wh, observations(wh)).filter("loan_state_observation_available and loan_state_d7_available")
    second = states.agg(
        F.lit("d7_state_recovery_proxy").alias("target_id"), F.lit("feasibility_only").alias("decision"),
        F.lit("loan_id").alias("grain"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.avg("is_state_recovered_d7"), F.lit(0.0)).alias("positive_rate"),
    )
    promised = wh["ods_collection_action"].filter(F.coalesce("ptp_flag", F.lit(False)))
    third = promised.agg(
        F.lit("ptp_fulfillment").alias("target_id"), F.lit("defer").alias("decision"),
        F.lit("collection_action").alias("grain"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.avg(F.col("ptp_fulfilled_flag").cast("int")), F.lit(0.0)).alias("positive_rate"),
    )
    return first.unionByName(second).unionByName(third)


def state_feasibility(wh) -> DataFrame:
    """One row: sample size, positives of the three state labels and snapshot coverage."""
    states = state_targets(wh, observations(wh))
    usable = F.col("loan_state_observation_available") & F.col("loan_state_d7_available")

    def positives(label: str) -> Column:
        return F.count_if(usable & (F.col(label) == 1))

    return states.agg(
        F.count_if(usable).alias("sample_count"),
        positives("is_state_recovered_d7").alias("positive_count"),
        F.coalesce(F.avg(F.when(usable, F.col("is_state_recovered_d7"))), F.lit(0.0)).alias("positive_rate"),
        positives("is_cured_d7").alias("strict_cure_positive_count"),
        positives("is_state_recovered_d7").alias("state_recovery_positive_count"),
        positives("is_fully_recovered_d7").alias("full_recovery_positive_count"),
        F.count_if(usable).alias("d7_state_complete_count"),
        F.count_if(~usable).alias("d7_state_missing_count"),
    ).withColumn("decision", F.lit("feasibility_only_skip_training"))
