"""Attribution of the M1 recovery change."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add
from duewise.oracle import attribution_sql  # noqa: F401
from duewise.plans import anomaly as an
from duewise.plans.attribution import Attribution
from duewise.plans.warehouse import SHARED_TABLES


def target(wh):
    return an.find_target(an.Detection(wh, only=["m1_recovery_rate"]).findings)


def fact(wh):
    return Attribution(wh).fact.drop("total_outstanding_amount")


def segments(wh):
    return Attribution(wh).segments


def scored(wh):
    return Attribution(wh).scored.select(
        "dimension_name", "dimension_value", F.round("recent_weight", 6).alias("recent_weight"),
        F.round("raw_contribution", 6).alias("raw_contribution"), F.round("contribution_score", 6).alias("contribution_score"),
    )


def drivers(wh):
    return Attribution(wh).drivers().select(
        "contribution_rank", "dimension_name", "dimension_value", F.round("contribution_score", 6).alias("contribution_score"),
        F.round("denominator_recent", 4).alias("denominator_recent"),
    )


def linkage(wh):
    return Attribution(wh).drivers().select("contribution_rank", "dimension_name", "dimension_value", F.inline("linkage")).drop("metric_name_cn")


def results(wh):
    return Attribution(wh).results(target(wh)).drop(
        "evidence", "notes", "business_interpretation", "recommended_action", "target_metric_code", "target_metric_name_cn"
    )


def evidence(wh):
    return Attribution(wh).results().select("attribution_id", F.inline("evidence")).drop("metric_name_cn")


def register() -> None:
    add("attribution_fact", fact, "SELECT * FROM recovery_fact", due_amount=4, repaid_amount_d7=4)
    add("attribution_overall", lambda wh: Attribution(wh).overall,
        "SELECT *, recent_total - baseline_total AS total_delta FROM overall_rate", baseline_total=6, recent_total=6, total_delta=6)
    measures = {"numerator": "num", "denominator": "den", "loan_count": "loans", "actions": "actions", "ai_actions": "ai", "manual_actions": "manual",
                "connected": "connected", "promised": "promised", "kept": "kept", "reduced": "reduced", "complained": "complained"}
    amounts = {f"{m}_{p}": 4 for m in ("numerator", "denominator") for p in ("baseline", "recent")}
    columns = ", ".join(
        f"{p[0]}_{short} AS {m}_{p}" if m in ("numerator", "denominator") else f"CAST({p[0]}_{short} AS BIGINT) AS {m}_{p}"
        for p in ("baseline", "recent") for m, short in measures.items())
    add("attribution_segments", segments, f"""
        SELECT dimension_name, dimension_value, {columns}, CAST(in_b AS INTEGER) AS in_baseline, CAST(in_r AS INTEGER) AS in_recent,
               b_value AS value_baseline, r_value AS value_recent, delta FROM segment""",
        **amounts, value_baseline=6, value_recent=6, delta=6)
    add("attribution_scores", scored, """
        SELECT dimension_name, dimension_value, weight AS recent_weight, delta * weight AS raw_contribution, score AS contribution_score
        FROM scored""", recent_weight=6, raw_contribution=6, contribution_score=6)
    add("attribution_drivers", drivers, """
        SELECT contribution_rank, dimension_name, dimension_value, score AS contribution_score, r_den AS denominator_recent FROM driver""",
        contribution_score=6, denominator_recent=4)
    add("attribution_process_linkage", linkage, "SELECT * FROM linkage")
    add("attribution_evidence_rows", evidence, """
        SELECT 'M3B-recovery_rate_d7-' || lpad(CAST(contribution_rank AS VARCHAR), 2, '0') AS attribution_id, 'segment_delta' AS method,
               NULL AS metric_code, round(b_value, 6) AS baseline_value, round(r_value, 6) AS recent_value, round(delta, 6) AS delta,
               b_loans AS baseline_loan_count, r_loans AS recent_loan_count, round(b_den, 2) AS baseline_denominator,
               round(r_den, 2) AS recent_denominator, round(weight, 6) AS recent_weight FROM driver
        UNION ALL SELECT 'M3B-recovery_rate_d7-' || lpad(CAST(contribution_rank AS VARCHAR), 2, '0'), 'driver_linkage', metric_code,
               baseline_value, recent_value, delta, NULL, NULL, NULL, NULL, NULL FROM linkage""")
    add("attribution_results", results, "SELECT * FROM attribution_result", shared=SHARED_TABLES)
