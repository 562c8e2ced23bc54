"""Features, labels, classifier evaluation and baseline models."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add
from duewise.operators import evaluation as ev
from duewise.operators.joins import asof_join, trailing_features
from duewise.operators.ordering import average_percent_rank, exact_median
from duewise.oracle import features_sql  # noqa: F401
from duewise.plans import features as ft
from duewise.plans import models as md

LOANS = ("dws_loan_status_snapshot_di",)
STATES = ("dws_loan_status_snapshot_di",)
NUMBERS = (
    "loan_amount loan_term interest_rate mob due_amount log_due_amount days_since_due_date dpd_x_log_due_amount postloan_c_score "
    "score_x_connect_rate initial_outstanding_amount outstanding_to_loan_ratio protect_flag sensitive_flag action_count_7d "
    "connected_count_7d connect_rate_7d ptp_count_7d ptp_rate_7d days_since_last_action ai_action_count complaint_count ai_coverage_rate"
).split()


def scaled_sql() -> str:
    """Median fill and standardisation by the training part, one expression for each column."""
    medians = ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in NUMBERS)
    filled = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), m.{c}) AS {c}" for c in NUMBERS)
    moments = ", ".join(f"avg({c}) AS {c}_a, stddev_samp({c}) AS {c}_d" for c in NUMBERS)
    out = ", ".join(f"CASE WHEN {c}_d > 1e-12 THEN ({c} - {c}_a) / {c}_d ELSE 0.0 END AS {c}" for c in NUMBERS)
    return f"""
        SELECT loan_id, is_test, {out}
        FROM (SELECT loan_id, is_test, {filled} FROM model_split s, (SELECT {medians} FROM model_split WHERE NOT is_test) m),
             (SELECT {moments} FROM (SELECT {filled} FROM model_split s, (SELECT {medians} FROM model_split WHERE NOT is_test) m WHERE NOT is_test))"""


def scored_labels(wh):
    """Recovery label with a fixed score derived from the amount due."""
    return ft.observations(wh).select(
        "loan_id", F.col("is_recovered_d7").alias("label"), (F.floor(F.col("due_amount") / 1000) / 500.0).alias("score")
    )


def event_asof(wh):
    """Latest sign-up of the same user at or before each purchase, on the original event times."""
    events = wh.source.raw("events")
    bought = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    signed = events.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    return asof_join(bought, signed, ["user_id"], "ts", "signup_ts", ["signup_id", "signup_value"], tie_break=["signup_id"], slice_unit="week")


def event_trailing(wh):
    """Seven-day activity of each case up to every complaint."""
    complaints = wh["dwd_complaint_detail_di"].select("complaint_id", "case_id", "complaint_date")
    return trailing_features(
        complaints, wh["ods_collection_action"], ["case_id"], "complaint_date", "action_time",
        {"actions": F.lit(1).cast("long"), "connected": F.col("connected_flag").cast("long")}, 7, last_date="last_action_date",
    )


def robustness(wh):
    prepared, split = md.split_rows(wh)
    one = md.run_split(prepared, split, ("logistic",)).metrics()
    two = md.run_split(*md.without_time_batch(prepared, split), ("logistic",)).metrics()
    return md.robustness(one, two)


def register() -> None:
    add("join_asof_events", event_asof, """
        SELECT b.event_id, b.user_id, b.ts, s.event_id AS signup_id, s.value AS signup_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b LEFT JOIN (
            SELECT b.event_id AS bid, s.* FROM events b JOIN events s ON s.user_id = b.user_id AND s.ts <= b.ts
            WHERE b.event_type = 'purchase' AND s.event_type = 'signup'
            QUALIFY row_number() OVER (PARTITION BY b.event_id ORDER BY s.ts DESC, s.event_id DESC) = 1) s ON s.bid = b.event_id""")
    add("join_interval_actions", event_trailing, """
        SELECT c.complaint_id, c.case_id, c.complaint_date, nullif(count(action_id) FILTER (d >= complaint_date - 6), 0) AS actions,
               count(*) FILTER (connected_flag AND d >= complaint_date - 6) * CASE WHEN count(action_id) FILTER (d >= complaint_date - 6) > 0 THEN 1 END AS connected,
               max(d) AS last_action_date
        FROM dwd_complaint_detail_di c LEFT JOIN (SELECT *, CAST(action_time AS DATE) AS d FROM ods_collection_action) a
             ON a.case_id = c.case_id AND d <= c.complaint_date GROUP BY 1, 2, 3""")
    add("features_score_asof", lambda wh: ft.score_asof(wh, ft.observations(wh).select("loan_id", "customer_id", "observation_date")),
        "SELECT * FROM score_asof", shared=LOANS)
    add("features_score_guard", ft.score_guard_counts, """
        SELECT count(*) FILTER (postloan_c_score IS NULL) AS score_date_missing_count,
               count(*) FILTER (postloan_c_score IS NULL) AS score_date_fallback_count,
               (SELECT count(DISTINCT loan_id) FROM observation o JOIN ods_postloan_c_score s ON s.customer_id = o.customer_id
                AND CAST(s.score_date AS DATE) > observation_date) AS future_score_blocked_count
        FROM score_asof""", shared=LOANS)
    add("features_first_due_date", ft.first_due_dates, "SELECT loan_id, min(due_date) AS due_date FROM ods_repayment_plan GROUP BY 1")
    add("features_main_case", ft.main_mapping, "SELECT * FROM main_case")
    add("features_recent_actions", lambda wh: ft.recent_actions(wh, ft.observations(wh)), "SELECT * FROM recent_action", shared=LOANS,
        connect_rate_7d=6, ptp_rate_7d=6)
    add("features_case", ft.case_features, "SELECT * FROM case_feature", initial_outstanding_amount=4, connect_rate=6,
        ai_coverage_rate=6, ptp_fulfillment_rate=6)
    add("features_dataset", ft.dataset, "SELECT * FROM model_dataset", shared=LOANS, loan_amount=4, interest_rate=6,
        log_due_amount=6, initial_outstanding_amount=4, score_x_connect_rate=6, outstanding_to_loan_ratio=6, connect_rate_7d=6,
        ptp_rate_7d=6, ai_coverage_rate=6, postloan_c_score=4)
    add("features_dataset_without_time_batch", lambda wh: ft.dataset(wh, exclude_time_batch=True),
        "SELECT * EXCLUDE (vintage_month) FROM model_dataset", shared=LOANS, loan_amount=4, interest_rate=6,
        log_due_amount=6, initial_outstanding_amount=4, score_x_connect_rate=6, outstanding_to_loan_ratio=6, connect_rate_7d=6,
        ptp_rate_7d=6, ai_coverage_rate=6, postloan_c_score=4)
    add("features_label_split", lambda wh: ft.split_features_label(ft.dataset(wh)).select("loan_id", "due_amount", "dpd_bucket", "is_recovered_d7"),
        "SELECT loan_id, due_amount, dpd_bucket, is_recovered_d7 FROM model_dataset", shared=LOANS)
    add("features_dataset_summary", lambda wh: ft.dataset_summary(ft.dataset(wh)), """
        SELECT count(*) AS sample_count, avg(is_recovered_d7) AS positive_rate, 39 AS feature_count, 'any_payment' AS target,
               'is_recovered_d7' AS target_column, false AS exclude_time_batch FROM model_dataset""", shared=LOANS, positive_rate=6)
    add("features_state_targets", lambda wh: ft.state_targets(wh, ft.observations(wh)), "SELECT * FROM state_target",
        shared=STATES, repaid_amount_d7=4, outstanding_reduction_d7=4, outstanding_reduction_rate_d7=6,
        case_outstanding_at_observation=4, case_outstanding_at_d7=4, customer_total_outstanding_at_observation=4,
        customer_total_outstanding_at_d7=4)
    add("features_state_coverage", ft.snapshot_coverage, """
        SELECT count(*) FILTER (loan_state_observation_available AND loan_state_d7_available) AS d7_state_complete_count,
               count(*) FILTER (NOT (loan_state_observation_available AND loan_state_d7_available)) AS d7_state_missing_count,
               count(*) FILTER (loan_state_observation_available) AS loan_observation_snapshot_match_count,
               count(*) FILTER (loan_state_d7_available) AS loan_d7_snapshot_match_count,
               count(*) FILTER (snapshot_date_observation = observation_date) AS loan_observation_exact_snapshot_count,
               count(*) FILTER (snapshot_date_d7 = d7_end_date) AS loan_d7_exact_snapshot_count FROM state_target""", shared=STATES)
    add("features_state_dataset", lambda wh: ft.dataset(wh, "state_recovery").select(
        "loan_id", "observation_date", "is_state_recovered_d7", "outstanding_at_observation", "dpd_at_observation", "due_amount"), """
        SELECT t.loan_id, t.observation_date, is_state_recovered_d7, outstanding_at_observation, dpd_at_observation, due_amount
        FROM state_target t JOIN observation o ON o.loan_id = t.loan_id
        WHERE loan_state_observation_available AND loan_state_d7_available""", shared=STATES)
    add("features_readiness", ft.readiness, """
        SELECT 'd7_any_payment_response' AS target_id, 'selected_for_baseline' AS decision, 'loan_id' AS grain, count(*) AS row_count,
               avg(is_recovered_d7) AS positive_rate FROM observation
        UNION ALL SELECT 'd7_state_recovery_proxy', 'feasibility_only', 'loan_id', count(*), avg(is_state_recovered_d7) FROM state_target
                  WHERE loan_state_observation_available AND loan_state_d7_available
        UNION ALL SELECT 'ptp_fulfillment', 'defer', 'collection_action', count(*), avg(CAST(ptp_fulfilled_flag AS INTEGER))
                  FROM ods_collection_action WHERE ptp_flag""", shared=STATES, positive_rate=6)
    add("features_state_feasibility", ft.state_feasibility, """
        SELECT count(*) FILTER (u) AS sample_count, count(*) FILTER (u AND is_state_recovered_d7 = 1) AS positive_count,
               avg(is_state_recovered_d7) FILTER (u) AS positive_rate, count(*) FILTER (u AND is_cured_d7 = 1) AS strict_cure_positive_count,
               count(*) FILTER (u AND is_state_recovered_d7 = 1) AS state_recovery_positive_count,
               count(*) FILTER (u AND is_fully_recovered_d7 = 1) AS full_recovery_positive_count,
               count(*) FILTER (u) AS d7_state_complete_count, count(*) FILTER (NOT u) AS d7_state_missing_count,
               'feasibility_only_skip_training' AS decision
        FROM (SELECT *, loan_state_observation_available AND loan_state_d7_available AS u FROM state_target)""", shared=STATES, positive_rate=6)
    add("evaluate_split", lambda wh: ev.stratified_split(scored_labels(wh), "label", "loan_id"), """
        SELECT loan_id, label, score, rn <= round(n * 0.25) AS is_test
        FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
                     row_number() OVER (PARTITION BY label ORDER BY md5(loan_id || '-20260521'), loan_id) AS rn FROM scored_label)""", shared=LOANS)
    add("evaluate_threshold_sweep", lambda wh: ev.threshold_sweep(scored_labels(wh), "label", "score"), "SELECT * FROM sweep",
        shared=LOANS, tpr=6, fpr=6, precision=6)
    add("evaluate_classification", lambda wh: ev.classification_metrics(scored_labels(wh), "label", "score"), """
        SELECT tn, fp, fn, tp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6)::DOUBLE AS precision,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6)::DOUBLE AS recall,
               round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6)::DOUBLE AS f1, 0.5::DOUBLE AS threshold, auc, ks, pr_auc
        FROM (SELECT count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
                     count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM scored_label), ranking""",
        shared=LOANS)
    add("evaluate_lift_table", lambda wh: ev.lift_table(scored_labels(wh), "label", "score", "loan_id"), """
        SELECT decile, sample_count, positive_count, round(r, 6) AS positive_rate, round(a, 6) AS avg_score, round(r / (p / n), 6) AS lift,
               CAST(sum(positive_count) OVER (ORDER BY decile) AS BIGINT) AS cumulative_positive_count,
               round(sum(positive_count) OVER (ORDER BY decile) / p, 6) AS cumulative_capture_rate
        FROM (SELECT CAST(d AS INTEGER) AS decile, count(*) AS sample_count, CAST(sum(label) AS BIGINT) AS positive_count, avg(label) AS r, avg(score) AS a,
                     any_value(n) AS n, any_value(p) AS p
              FROM (SELECT *, ntile(10) OVER (ORDER BY score DESC, loan_id) AS d, count(*) OVER ()::DOUBLE AS n, sum(label) OVER ()::DOUBLE AS p FROM scored_label)
              GROUP BY 1)""", shared=LOANS)
    add("order_exact_median", lambda wh: exact_median(wh["dws_customer_status_snapshot_di"], "total_outstanding_amount"),
        "SELECT median(total_outstanding_amount) AS median FROM dws_customer_status_snapshot_di", median=4)
    add("order_average_percent_rank", lambda wh: average_percent_rank(scored_labels(wh), "score"), """
        SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct_rank
        FROM scored_label""", shared=LOANS, pct_rank=6)
    add("model_training_medians", md.training_medians, " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS \"values\", median(CAST({c} AS DOUBLE)) AS median FROM model_split WHERE NOT is_test" for c in NUMBERS),
        shared=LOANS, median=6)
    add("model_scaled_features", md.scaled_features, scaled_sql(), shared=LOANS, **dict.fromkeys(NUMBERS, 6))
    add("model_baseline_metrics", lambda wh: md.run_baseline(wh).metrics(), None, shared=LOANS)
    add("model_best", lambda wh: md.run_baseline(wh, ("logistic",)).best(), None, shared=LOANS)
    add("model_feature_importance", lambda wh: md.run_baseline(wh, ("logistic",)).importance("logistic"), None, shared=LOANS)
    add("model_feature_diagnostics", lambda wh: md.run_baseline(wh, ("logistic",)).diagnostics("logistic"), None, shared=LOANS)
    add("model_lift_table", lambda wh: md.run_baseline(wh, ("logistic",)).lift("logistic"), None, shared=LOANS)
    add("model_robustness", robustness, None, shared=LOANS)
