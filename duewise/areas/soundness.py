"""Source tables, data-quality checks, documented SQL and small relational operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duewise.catalog import add
from duewise.functions.buckets import channel_name, score_bucket
from duewise.functions.dates import parse_date
from duewise.operators.ordering import top_per_key
from duewise.operators.windows import date_range, last_days, latest_partition
from duewise.plans import checks, documented_sql
from duewise.plans.metrics import METRIC_CODES, RATIO_CODES, date_spine
from duewise.plans.warehouse import SHARED_TABLES
from duewise.schemas import PRIMARY_KEYS, without_personal_fields
from duewise.session import ensure_checkpoint_dir
from duewise.sources.domain import ANCHOR_DATE
from duewise.sources.tables import LayeredFolder, write_table

SOURCES = {
    "dim_customer": {"account_balance": 4}, "dim_loan": {"loan_amount": 4, "interest_rate": 6}, "dim_collector": {}, "dim_collection_line": {},
    "dim_vendor": {}, "dim_case": {"initial_outstanding_amount": 4}, "dim_case_loan_mapping": {}, "ods_repayment_plan": {"due_amount": 4},
    "ods_repayment_detail": {"repay_amount": 4}, "ods_collection_action": {}, "ods_call_record": {"duration_seconds": 4},
    "ods_sms_send_log": {}, "ods_complaint": {}, "ods_reduction_application": {"approved_amount": 4},
    "ods_postloan_c_score": {"postloan_c_score": 4}, "ods_case_flow": {}, "ods_case_daily_snapshot": {"outstanding_amount": 4},
    "ods_customer_daily_snapshot": {"total_outstanding_amount": 4},
}


def written_and_read(wh, fmt: str):
    """A table written to a layered folder and read back through the reader."""
    root = f"{ensure_checkpoint_dir(wh.spark).rstrip('/')}/layers-{uuid.uuid4().hex}"
    table = wh["dwd_due_plan_detail_di"]
    write_table(table, root, "dwd_due_plan_detail_di", fmt, ["stat_date"] if fmt == "partitioned" else None)
    folder = LayeredFolder(wh.spark, root, {"dwd_due_plan_detail_di": table.schema})
    return folder.table("dwd_due_plan_detail_di").select("plan_id", "stat_date", "dpd_bucket", "due_amount")


def expressions(wh):
    """Bins, value maps, lenient parsing and formats over the score table."""
    return wh["ods_postloan_c_score"].select(
        "score_id",
        score_bucket("postloan_c_score", [(310, "LOW"), (350, "MID"), (400, "UPPER")], "TOP").alias("score_bin"),
        channel_name(F.when(F.col("score_level") == "A", " AI_Outbound ").when(F.col("score_level") == "B", "CALL").otherwise("Sms")).alias("channel"),
        parse_date(F.when(F.col("score_level") == "D", "not a date").otherwise(F.col("score_date"))).alias("parsed"),
        F.expr("try_cast(CASE WHEN score_level = 'C' THEN 'n/a' ELSE cast(score_id AS string) END AS double)").alias("coerced"),
        F.sha2(F.col("customer_id").cast("string"), 256).alias("hashed"),
        F.concat_ws("~", F.date_format(F.col("score_date").cast("date"), "yyyy-MM"), "score_level").alias("label"),
    )


# What the rules by column name must find; written out, so that the twin does not share the code that finds it.
AMOUNTS = {
    "dim_loan": ["loan_amount"], "dim_case": ["initial_outstanding_amount"], "ods_repayment_plan": ["due_amount"],
    "ods_repayment_detail": ["repay_amount"], "ods_reduction_application": ["approved_amount"], "ods_case_daily_snapshot": ["outstanding_amount"],
    "ods_customer_daily_snapshot": ["total_outstanding_amount"], "ods_loan_daily_snapshot": ["outstanding_amount"],
    "dwd_due_plan_detail_di": ["due_amount", "outstanding_amount"], "dwd_repayment_detail_di": ["repay_amount"],
    "dws_case_status_snapshot_di": ["outstanding_amount", "repaid_amount"], "dws_customer_profile_di": ["total_outstanding_amount"],
    "dws_customer_status_snapshot_di": ["total_outstanding_amount"], "dws_loan_status_snapshot_di": ["due_amount", "repaid_amount_d7"],
    "ads_postloan_dashboard_di": ["due_total_amount"], "ads_reduction_roi_di": ["approved_reduction_amount"],
}
RATES = {
    "dws_customer_postloan_tag_di": ["strategy_tag"],  # its name holds "rate"; a text that is no number breaks nothing
    "dws_collection_process_wide_di": ["connect_rate", "ptp_fulfillment_rate", "ai_coverage_rate"], "dws_collector_profile_di": ["connect_rate"],
    "dws_loan_status_snapshot_di": ["recovery_rate_d7"], "ads_collector_performance_di": ["connect_rate", "ptp_keep_rate"],
    "ads_compliance_qc_di": ["complaint_rate", "risk_phrase_hit_rate", "qa_fail_rate", "over_frequency_contact_rate"],
    "ads_postloan_dashboard_di": [
        "collection_entry_rate", "recovery_rate_d7", "recovery_rate_d15", "recovery_rate_d30", "m1_recovery_rate", "call_coverage_rate",
        "valid_coverage_rate", "connect_rate", "valid_contact_rate", "ptp_rate", "ptp_keep_rate", "complaint_rate", "risk_phrase_hit_rate",
        "qa_fail_rate", "over_frequency_contact_rate", "reduction_usage_rate", "reduction_recovery_rate",
    ],
    "ads_recovery_attribution_di": ["contribution_pct"], "ads_reduction_roi_di": ["reduction_usage_rate", "reduction_recovery_rate"],
    "ads_vendor_performance_di": ["call_coverage_rate", "connect_rate", "ptp_rate", "ptp_keep_rate", "complaint_rate"],
}
LAYER_TABLES = {
    "dim": ["dim_case", "dim_case_loan_mapping", "dim_collection_line", "dim_collector", "dim_customer", "dim_loan", "dim_vendor"],
    "ods": ["ods_call_record", "ods_case_daily_snapshot", "ods_case_flow", "ods_collection_action", "ods_complaint", "ods_customer_daily_snapshot",
            "ods_loan_daily_snapshot", "ods_postloan_c_score", "ods_reduction_application", "ods_repayment_detail", "ods_repayment_plan", "ods_sms_send_log"],
    "dwd": ["dwd_case_flow_detail_di", "dwd_collection_action_detail_di", "dwd_complaint_detail_di", "dwd_due_plan_detail_di", "dwd_repayment_detail_di"],
    "dws": ["dws_case_status_snapshot_di", "dws_collection_process_wide_di", "dws_collector_profile_di", "dws_customer_postloan_tag_di",
            "dws_customer_profile_di", "dws_customer_status_snapshot_di", "dws_loan_status_snapshot_di", "dws_vendor_line_capacity_di"],
    "ads": ["ads_collector_performance_di", "ads_compliance_qc_di", "ads_postloan_dashboard_di", "ads_recovery_attribution_di", "ads_reduction_roi_di",
            "ads_vendor_performance_di"],
}
#: Tables whose SQL has another name.
SQL_NAMES = {"ods_loan_daily_snapshot": "loan_daily_state"}


def constraints_sql(layer: str) -> str:
    """One row per rule of each table of a layer."""
    rows = []
    for t in LAYER_TABLES[layer]:
        source, keys = SQL_NAMES.get(t, t), PRIMARY_KEYS.get(t, [])
        rules = [("non_negative", c, f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) < 0)") for c in AMOUNTS.get(t, [])]
        rules += [("unit_range", c, f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) NOT BETWEEN 0 AND 1)") for c in RATES.get(t, [])]
        if keys:
            named = ",".join(keys)
            rules.append(("key_present", named, f"count(*) FILTER ({' OR '.join(f'{k} IS NULL' for k in keys)})"))
            rules.append(("unique_key", named, f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {named} FROM {source}))"))
        rules += [("column_present", c, "0") for c in (METRIC_CODES if t == "ads_postloan_dashboard_di" else ())]
        if layer in ("dwd", "dws", "ads"):
            rules.append(("no_personal_field", "", "0"))
        rows += [
            f"SELECT '{t}' AS table_name, '{name}' AS constraint_name, '{column}' AS column_name, count(*) AS row_count, CAST({bad} AS BIGINT) AS bad_count FROM {source}"
            for name, column, bad in rules or [("none", "", "0")]
        ]
    return " UNION ALL ".join(rows)


def references_sql() -> str:
    rows = []
    for c, ck, p, pk in checks.FOREIGN_KEYS:
        if c in ("ods_collection_note", "ods_assignment_decision_log"):  # the data has no such tables
            rows.append(f"SELECT '{c}.{ck}' AS check_name, false AS checked, CAST(NULL AS BIGINT) AS missing_count, CAST(NULL AS BIGINT) AS orphan_rows")
        else:
            rows.append(
                f"SELECT '{c}.{ck}' AS check_name, true AS checked, count(DISTINCT coalesce(CAST({ck} AS VARCHAR), '')) AS missing_count, count(*) AS orphan_rows"
                f" FROM {c} WHERE {ck} IS NULL OR {ck} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)")
    return " UNION ALL ".join(rows)


def register() -> None:
    for name, digits in SOURCES.items():
        add(f"source_{name}", lambda wh, name=name: without_personal_fields(wh[name]), f"SELECT * FROM {name}", **digits)
    for fmt in ("parquet", "csv"):
        add(f"source_written_{fmt}", lambda wh, fmt=fmt: written_and_read(wh, fmt),
            "SELECT plan_id, stat_date, dpd_bucket, due_amount FROM dwd_due_plan_detail_di", due_amount=4)
    add("source_latest_partition", lambda wh: latest_partition(wh["dws_vendor_line_capacity_di"]), """
        SELECT * FROM dws_vendor_line_capacity_di WHERE stat_date = (SELECT max(stat_date) FROM dws_vendor_line_capacity_di)""")
    add("filter_date_range", lambda wh: date_range(wh["dwd_due_plan_detail_di"], "2001-07-01", "2001-07-15").select("plan_id", "stat_date", "dpd_bucket"), """
        SELECT plan_id, stat_date, dpd_bucket FROM dwd_due_plan_detail_di WHERE stat_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'""")
    add("filter_last_days", lambda wh: last_days(wh["dwd_due_plan_detail_di"], 30).select("plan_id", "stat_date"), """
        SELECT plan_id, stat_date FROM dwd_due_plan_detail_di WHERE stat_date > (SELECT max(stat_date) FROM dwd_due_plan_detail_di) - 30""")
    add("set_date_spine", lambda wh: date_spine(wh["dwd_due_plan_detail_di"], wh["dws_collection_process_wide_di"]), """
        SELECT stat_date FROM dwd_due_plan_detail_di UNION SELECT stat_date FROM dws_collection_process_wide_di""")
    add("expressions_scores", expressions, """
        SELECT score_id, CASE WHEN postloan_c_score <= 310 THEN 'LOW' WHEN postloan_c_score <= 350 THEN 'MID' WHEN postloan_c_score <= 400 THEN 'UPPER' ELSE 'TOP' END AS score_bin,
               CASE score_level WHEN 'A' THEN 'ai_call' WHEN 'B' THEN 'manual' ELSE 'sms' END AS channel,
               CASE WHEN score_level <> 'D' THEN CAST(score_date AS DATE) END AS parsed, CASE WHEN score_level <> 'C' THEN CAST(score_id AS DOUBLE) END AS coerced,
               sha256(CAST(customer_id AS VARCHAR)) AS hashed, score_date[1:7] || '~' || score_level AS label FROM ods_postloan_c_score""")
    add("window_top_two_lines", lambda wh: top_per_key(wh["dws_vendor_line_capacity_di"], ["stat_date", "vendor_id"],
        [F.col("active_case_count").desc(), F.col("line_id").asc()], 2).select("stat_date", "vendor_id", "line_id", "active_case_count"), """
        SELECT stat_date, vendor_id, line_id, active_case_count FROM dws_vendor_line_capacity_di
        QUALIFY row_number() OVER (PARTITION BY stat_date, vendor_id ORDER BY active_case_count DESC, line_id) <= 2""")
    # ---- data quality
    for layer in LAYER_TABLES:
        add(f"quality_constraints_{layer}", lambda wh, layer=layer: checks.constraints(wh, layer), constraints_sql(layer),
            shared=SHARED_TABLES if layer in ("dws", "ads") else ())
    add("quality_references", checks.references, references_sql())
    add("quality_primary_keys", checks.primary_keys, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(PRIMARY_KEYS[t])})"
        for t in checks.KEYED))
    add("quality_foreign_keys", checks.foreign_keys, " UNION ALL ".join(
        f"SELECT '{c}.{ck}' AS check_name, count(DISTINCT coalesce(CAST({ck} AS VARCHAR), '')) AS missing_count FROM {c} WHERE {ck} IS NULL OR {ck} NOT IN (SELECT {pk} FROM {p})"
        for c, ck, p, pk in checks.FOREIGN_KEYS if c not in ("ods_collection_note", "ods_assignment_decision_log")))
    amounts = {
        "dim_loan": ["loan_amount"], "dim_case": ["initial_outstanding_amount"], "ods_repayment_plan": ["due_amount"],
        "ods_repayment_detail": ["repay_amount"], "ods_reduction_application": ["approved_amount"],
        "dws_customer_status_snapshot_di": ["total_outstanding_amount"], "dws_case_status_snapshot_di": ["outstanding_amount", "repaid_amount"],
    }
    add("quality_negative_amounts", checks.amounts, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} < 0) AS bad_count FROM {t}" for t, cs in amounts.items() for c in cs))
    add("quality_date_order", checks.date_order, """
        SELECT 'repay_time' AS check_name, count(*) FILTER (repay_time < CAST(disburse_time AS TIMESTAMP)) AS bad_count FROM ods_repayment_detail r JOIN dim_loan l ON l.loan_id = r.loan_id
        UNION ALL SELECT 'due_date', count(*) FILTER (due_date < disburse_time) FROM ods_repayment_plan r JOIN dim_loan l ON l.loan_id = r.loan_id""")
    rates = {
        "dws_loan_status_snapshot_di": ["recovery_rate_d7"], "dws_collection_process_wide_di": ["connect_rate", "ptp_fulfillment_rate", "ai_coverage_rate"],
        "ads_vendor_performance_di": ["call_coverage_rate", "connect_rate", "ptp_rate", "ptp_keep_rate", "complaint_rate"],
    }
    add("quality_rates", checks.rates, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} < 0 OR {c} > 1) AS bad_count FROM {t}" for t, cs in rates.items() for c in cs))
    board = "ads_postloan_dashboard_di"
    add("quality_dashboard_ratios", checks.dashboard_ratios, " UNION ALL ".join(
        f"SELECT '{board}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} < 0 OR {c} > 1) AS bad_count FROM {board}" for c in RATIO_CODES), shared=SHARED_TABLES)
    add("quality_core_metrics", checks.core_metrics_present, " UNION ALL ".join(
        f"SELECT '{board}' AS table_name, '{c}' AS column_name, count({c}) = 0 AS empty FROM {board}" for c in METRIC_CODES), shared=SHARED_TABLES)
    add("quality_unmapped_cases", checks.unmapped_cases, """
        SELECT 'dim_case.case_id' AS check_name, count(*) AS missing_count FROM dim_case WHERE case_id NOT IN (SELECT case_id FROM dim_case_loan_mapping)""")
    add("quality_snapshot_gaps", checks.snapshot_gaps, " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, CAST(d AS DATE) AS day FROM (SELECT min(stat_date) AS a, max(stat_date) AS b FROM {t}), range(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d)
            WHERE CAST(d AS DATE) NOT IN (SELECT stat_date FROM {t})""" for t in [*checks.SNAPSHOTS, "dws_loan_status_snapshot_di"]))
    tail = """SELECT '{n}' AS series, count(*) AS observations, avg(v) FILTER (rn > 30) AS prior_mean, avg(v) FILTER (rn <= 30) AS recent_mean,
              avg(v) FILTER (rn <= 30) < avg(v) FILTER (rn > 30) AS falling
              FROM (SELECT {c} AS v, row_number() OVER (ORDER BY stat_date DESC) AS rn FROM {t}) WHERE rn <= 60"""
    add("quality_trends", checks.trends, " UNION ALL ".join([
        tail.format(n="m1_recovery_rate", c="m1_recovery_rate", t=board),
        tail.format(n="connect_rate V_EUROPE", c="connect_rate", t="ads_vendor_performance_di WHERE vendor_id = 'V_EUROPE'"),
        tail.format(n="reduction_usage_rate", c="reduction_usage_rate", t=board)]), shared=SHARED_TABLES, prior_mean=6, recent_mean=6)
    add("quality_snapshot_invariants", checks.snapshot_invariants, """
        SELECT 'outstanding_rises' AS check_name, count(*) AS bad_count FROM (SELECT outstanding_amount > lag(outstanding_amount) OVER (PARTITION BY loan_id ORDER BY stat_date) AS up FROM loan_daily_state) WHERE up
        UNION ALL SELECT 'outstanding_is_due_less_repaid', count(*) FROM loan_daily_state s JOIN ods_repayment_plan p ON p.loan_id = s.loan_id
                  WHERE abs(outstanding_amount - greatest(due_amount - cumulative_repaid, 0)) > 0.005
        UNION ALL SELECT 'dpd_when_paid', count(*) FROM loan_daily_state WHERE outstanding_amount <= 0 AND dpd > 0
        UNION ALL SELECT 'customer_total_is_case_sum', count(*) FROM customer_daily_state c JOIN (SELECT stat_date, customer_id, sum(outstanding_amount) AS s FROM case_daily_state GROUP BY 1, 2) k
                  ON k.stat_date = c.stat_date AND k.customer_id = c.customer_id WHERE abs(total_outstanding_amount - s) > 0.01""")
    add("quality_score_ordering", checks.score_ordering, """
        SELECT score_level, CAST(o AS INTEGER) AS group_order, m AS mean_value, coalesce(m > lag(m) OVER (ORDER BY o), true) AS in_order
        FROM (SELECT score_level, list_position(['D', 'C', 'B', 'A'], score_level) AS o, avg(postloan_c_score) AS m FROM ods_postloan_c_score GROUP BY 1, 2)""", mean_value=6)
    # ---- documented SQL
    d = f"DATE '{ANCHOR_DATE}'"
    period = f"CASE WHEN CAST({{c}} AS DATE) >= {d} - 29 THEN 'recent_30d' ELSE 'baseline' END"

    def doc(name, vendor="V_B"):
        return lambda wh: documented_sql.run(wh, name, ANCHOR_DATE, vendor)

    add("sql_high_balance_share", doc("high_balance_share"), f"""
        SELECT {period.format(c='case_create_time')} AS period, count(DISTINCT case_id) AS case_count, count(*) FILTER (balance_segment = 'HIGH') AS high_balance_cases,
               count(*) FILTER (balance_segment = 'HIGH')::DOUBLE / count(*) AS high_balance_rate FROM dim_case GROUP BY 1""", high_balance_rate=6)
    add("sql_connect_and_ai_coverage", doc("connect_and_ai_coverage", "V_ASIA"), f"""
        SELECT {period.format(c='action_time')} AS period, CASE WHEN vendor_id = 'V_ASIA' THEN 'V_ASIA' ELSE 'OTHER' END AS vendor_group, count(*) AS action_count,
               count(*) FILTER (connected_flag)::DOUBLE / count(*) AS connect_rate, count(*) FILTER (ai_outbound_flag)::DOUBLE / count(*) AS ai_coverage_rate
        FROM ods_collection_action GROUP BY 1, 2""", connect_rate=6, ai_coverage_rate=6)
    add("sql_template_complaint_rate", doc("template_complaint_rate"), """
        SELECT g AS template_group, sms_count, coalesce(c, 0) AS complaint_count, coalesce(c, 0) / sms_count::DOUBLE AS complaint_rate
        FROM (SELECT CASE WHEN template_id = 'TPL_RISK_NOTICE' THEN template_id ELSE 'OTHER' END AS g, count(*) AS sms_count FROM ods_sms_send_log GROUP BY 1)
        LEFT JOIN (SELECT CASE WHEN template_id = 'TPL_RISK_NOTICE' THEN template_id ELSE 'OTHER' END AS g, count(*) AS c FROM ods_complaint GROUP BY 1) USING (g)""", complaint_rate=6)
    add("sql_reduction_use", doc("reduction_use"), f"""
        SELECT {period.format(c='case_create_time')} AS period, count(DISTINCT c.case_id) AS case_count, count(reduction_id) AS reduction_case_count,
               count(*) FILTER (approval_status = 'APPROVED') AS approved_count, sum(coalesce(approved_amount, 0)) AS approved_amount,
               count(reduction_id) / count(DISTINCT c.case_id)::DOUBLE AS reduction_case_rate
        FROM dim_case c LEFT JOIN ods_reduction_application r ON r.case_id = c.case_id GROUP BY 1""", approved_amount=4, reduction_case_rate=6)
    add("sql_attribution_factors", doc("attribution_factors"), """
        SELECT factor_code, count(DISTINCT stat_date) AS days, count(*) AS rows, avg(contribution_pct) AS avg_contribution_pct FROM ads_recovery_attribution_di GROUP BY 1""",
        avg_contribution_pct=6)
