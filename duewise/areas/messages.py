"""Text compliance, contact frequency and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise.catalog import add
from duewise.functions.text import (
    case_id_in, is_metric_code, magnitude, money, normalize_case_id, percent, quoted_in,
)
from duewise.oracle.sql import CTES
from duewise.plans import compliance as cp
from duewise.plans import contact as ct
from duewise.sources.domain import anchor

WORDS = {"notice": ["license", "@"], "pressure": ["free", "the "], "filler": ["que", "rere"]}
_LIST = [(c, w) for c, ws in WORDS.items() for w in ws]

CTES.update({
    "word": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{w}')" for c, w in _LIST) + ") w(category, keyword)",
    "doc_part": """SELECT doc_id, category, keyword, string_split(text, keyword) AS parts FROM documents, word WHERE contains(text, keyword)""",
    "doc_hit": """
        SELECT doc_id, category, keyword,
               CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(keyword) AS INTEGER) AS position
        FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM doc_part)""",
    "doc_scan": """
        SELECT doc_id, n AS violation_count, CASE WHEN n = 0 THEN 'clean' WHEN n <= 2 THEN 'medium' ELSE 'high' END AS risk_level, text_length
        FROM (SELECT d.doc_id, length(text) AS text_length, CAST(coalesce(h.n, 0) AS INTEGER) AS n
              FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_hit GROUP BY 1) h ON h.doc_id = d.doc_id)""",
    "doc_score": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN 40 ELSE 85 END AS red, 20 + 60 * toxic AS risk, 60 + 30 * quality AS overall FROM labels""",
    "merged": """
        SELECT s.doc_id, violation_count, risk_level AS keyword_risk_level, o.doc_id IS NOT NULL AS scored,
               CAST(CASE WHEN violation_count > 0 THEN least(coalesce(red, 70), greatest(0, 20 - violation_count * 10)) ELSE coalesce(red, 70) END AS INTEGER) AS red_line,
               CAST(CASE WHEN violation_count > 0 THEN greatest(coalesce(risk, 70), 60 + violation_count * 10) ELSE coalesce(risk, 70) END AS INTEGER) AS complaint_risk,
               CAST(CASE risk_level WHEN 'high' THEN least(coalesce(overall, 70), 30) WHEN 'medium' THEN least(coalesce(overall, 70), 65)
                    ELSE coalesce(overall, 70) END AS INTEGER) AS overall_compliance_score, violation_count > 0 AS supervisor_review_required
        FROM doc_scan s LEFT JOIN doc_score o ON o.doc_id = s.doc_id""",
    "now": """
        SELECT greatest((SELECT max(CAST(stat_date AS TIMESTAMP)) FROM dws_case_status_snapshot_di),
                        (SELECT max(CAST(stat_date AS TIMESTAMP)) FROM dws_collection_process_wide_di),
                        (SELECT max(send_time) FROM ods_sms_send_log)) AS t""",
    "case_context": """
        SELECT c.case_id, coalesce(customer_id_hash, '') AS customer_id_hash, initial_dpd_bucket,
               coalesce(outstanding_amount, initial_outstanding_amount, 0.0) AS outstanding_amount, coalesce(risk_level_current, '') AS risk_level,
               protect_flag, complaint_flag, sensitive_flag, coalesce(wa, 0) AS recent_action_count_7d, coalesce(ws, 0) AS recent_sms_count_7d,
               CASE WHEN wa > 0 THEN round(wc::DOUBLE / wa, 6) ELSE 0.0 END AS recent_connect_rate, strftime(ptp_day, '%Y-%m-%d') AS last_ptp_date,
               kept > 0 AS ptp_fulfilled, coalesce(vendor_id, current_vendor_id) AS current_vendor_id, coalesce(line_id, current_line_id) AS current_line_id,
               coalesce(ts, 0) AS today_sms, coalesce(wi, 0) AS week_ai, coalesce(ti, 0) AS today_ai,
               greatest(coalesce(wa, 0) - coalesce(wi, 0), 0) AS week_manual, greatest(coalesce(ta, 0) - coalesce(ti, 0), 0) AS today_manual
        FROM dim_case c LEFT JOIN dim_customer u ON u.customer_id = c.customer_id
        LEFT JOIN (SELECT case_id, outstanding_amount, vendor_id, line_id FROM dws_case_status_snapshot_di
                   QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY stat_date DESC, vendor_id DESC, line_id DESC) = 1) s ON s.case_id = c.case_id
        LEFT JOIN (SELECT case_id, CAST(coalesce(sum(action_count) FILTER (w), 0) AS BIGINT) AS wa, CAST(coalesce(sum(connected_count) FILTER (w), 0) AS BIGINT) AS wc,
                          CAST(coalesce(sum(ai_action_count) FILTER (w), 0) AS BIGINT) AS wi, CAST(coalesce(sum(action_count) FILTER (d), 0) AS BIGINT) AS ta,
                          CAST(coalesce(sum(ai_action_count) FILTER (d), 0) AS BIGINT) AS ti
                   FROM (SELECT *, stat_date BETWEEN CAST(t AS DATE) - 6 AND CAST(t AS DATE) AS w, stat_date = CAST(t AS DATE) AS d
                         FROM dws_collection_process_wide_di, now) GROUP BY 1) p ON p.case_id = c.case_id
        LEFT JOIN (SELECT case_id, stat_date AS ptp_day, ptp_fulfilled_count AS kept FROM dws_collection_process_wide_di WHERE ptp_count > 0
                   QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY stat_date DESC, collector_id DESC, ptp_fulfilled_count DESC) = 1) q ON q.case_id = c.case_id
        LEFT JOIN (SELECT case_id, count(*) FILTER (send_time BETWEEN t - INTERVAL 6 DAY AND t + INTERVAL 1 DAY) AS ws,
                          count(*) FILTER (CAST(send_time AS DATE) = CAST(t AS DATE)) AS ts FROM ods_sms_send_log, now GROUP BY 1) m ON m.case_id = c.case_id""",
    "frequency": """
        SELECT case_id, channel, today_count, week_count, daily_limit, weekly_limit,
               NOT (today_count >= daily_limit OR week_count >= weekly_limit) AS allowed,
               CASE WHEN today_count >= daily_limit THEN case_id || ' ' || channel || ' 今日触达 ' || today_count || ' 次，已达到上限 ' || daily_limit || ' 次'
                    WHEN week_count >= weekly_limit THEN case_id || ' ' || channel || ' 近7日触达 ' || week_count || ' 次，已达到上限 ' || weekly_limit || ' 次' END AS block_reason
        FROM (SELECT case_id, 'sms' AS channel, today_sms AS today_count, recent_sms_count_7d AS week_count, 2 AS daily_limit, 5 AS weekly_limit FROM case_context
              UNION ALL SELECT case_id, 'ai_call', today_ai, week_ai, 3, 10 FROM case_context
              UNION ALL SELECT case_id, 'manual', today_manual, week_manual, 5, 20 FROM case_context)""",
    "message": """
        SELECT *, CASE WHEN protect_flag OR complaint_flag OR sensitive_flag THEN 'complaint_sensitive' WHEN outstanding_amount <= 0 THEN 'post_payment'
               WHEN ptp_fulfilled = false THEN 'ptp_followup' WHEN last_ptp_date IS NOT NULL THEN 'ptp_reminder'
               WHEN recent_connect_rate <= 0 AND recent_action_count_7d >= 3 THEN 'lost_contact'
               WHEN upper(risk_level) IN ('D', 'HIGH') OR initial_dpd_bucket = 'M3+' THEN 'high_risk_manual' WHEN initial_dpd_bucket = 'M2' THEN 'd15_reduction'
               WHEN initial_dpd_bucket = 'M1' THEN 'd7_solution' WHEN initial_dpd_bucket = 'CURRENT' THEN 'post_payment' ELSE 'first_overdue' END AS script_type
        FROM case_context""",
})


def documents(wh):
    return wh.source.raw("documents").select("doc_id", "text")


def scanned(wh):
    return cp.scan(documents(wh), "text", WORDS)


def conversation_levels(wh):
    turns = wh.source.raw("conversations").select("conv_id", "turn", "role", "text")
    return cp.scan(turns, "text", WORDS).groupBy("role").agg(
        F.count(F.lit(1)).alias("turn_count"), F.sum("violation_count").alias("hits"),
        F.count_if(F.col("risk_level") == "high").alias("high_count"),
    )


def outside_scores(wh):
    """A score per labelled document, standing in for an outside scorer."""
    return wh.source.raw("labels").select(
        "doc_id",
        F.create_map(
            F.lit(cp.RED_LINE), F.when(F.col("toxic") == 1, 40).otherwise(85), F.lit(cp.COMPLAINT_RISK), 20 + 60 * F.col("toxic"),
        ).alias("dimensions"),
        (60 + 30 * F.col("quality")).alias("overall_compliance_score"),
        F.lit(False).alias("supervisor_review_required"),
    )


def merged(wh):
    return cp.merge_scores(scanned(wh), outside_scores(wh), ["doc_id"]).select(
        "doc_id", "violation_count", "keyword_risk_level", "scored", F.col("dimensions")[cp.RED_LINE].alias("red_line"),
        F.col("dimensions")[cp.COMPLAINT_RISK].alias("complaint_risk"), "overall_compliance_score", "supervisor_review_required",
    )


def axes(wh):
    rows = cp.merge_scores(scanned(wh), outside_scores(wh), ["doc_id"]).withColumn(
        "stat_date", F.date_sub(anchor(), (F.col("doc_id") % 60).cast("int"))
    ).withColumn("dimensions", F.map_concat(
        F.map_filter(cp.neutral_scores(), lambda k, _: ~k.isin(cp.RED_LINE, cp.COMPLAINT_RISK)),
        F.map_filter("dimensions", lambda k, _: k.isin(cp.RED_LINE, cp.COMPLAINT_RISK)),
    ))
    return cp.quality_axes(rows)


def identifiers(wh):
    key = F.col("case_id").cast("string")
    return wh["dim_case"].select(
        "case_id", normalize_case_id(F.concat(F.lit(" CASE-"), key)).alias("normalized"),
        normalize_case_id(F.concat(F.lit("X"), key)).alias("kept"),
        case_id_in(F.concat(F.lit("see case-"), key, F.lit(" now"))).alias("mentioned"),
        quoted_in(F.concat(F.lit('say " hello '), key, F.lit('" please'))).alias("quoted"),
        is_metric_code(F.concat(F.lit("metric_"), key)).alias("snake"), is_metric_code(F.concat(F.lit("M-"), key)).alias("not_snake"),
    )


def amounts(wh):
    return wh["dim_case"].select(
        "case_id", money("initial_outstanding_amount").alias("money"), percent(F.col("case_id") / 128.0, True).alias("signed_percent"),
        magnitude(F.col("case_id") / 4.0).alias("shown"), magnitude(-F.col("case_id") / 4.0, True).alias("signed"),
    )


def flat_context(wh):
    counts = F.col("frequency_counts")
    return ct.case_context(wh).select(
        "*", counts["sms"]["today"].alias("today_sms"), counts["ai_call"]["week"].alias("week_ai"),
        counts["ai_call"]["today"].alias("today_ai"), counts["manual"]["week"].alias("week_manual"),
        counts["manual"]["today"].alias("today_manual"),
    ).drop("frequency_counts")


def register() -> None:
    add("text_scan_levels", lambda wh: scanned(wh).select("doc_id", "text_length", "violation_count", "risk_level"), "SELECT * FROM doc_scan")
    add("text_scan_hits", lambda wh: scanned(wh).select("doc_id", F.inline("violations")), "SELECT * FROM doc_hit")
    add("text_scan_default_dictionary", lambda wh: cp.scan(documents(wh)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")), f"""
        SELECT CASE WHEN n = 0 THEN 'clean' WHEN n <= 2 THEN 'medium' ELSE 'high' END AS risk_level, count(*) AS n
        FROM (SELECT doc_id, {' + '.join(f"len(string_split(text, '{w}')) - 1" for ws in cp.VIOLATION_WORDS.values() for w in ws)} AS n FROM documents) GROUP BY 1""")
    add("text_scan_conversations", conversation_levels, f"""
        SELECT role, count(*) AS turn_count, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 2) AS high_count
        FROM (SELECT role, {' + '.join(f"len(string_split(text, '{w}')) - 1" for _, w in _LIST)} AS n FROM conversations) GROUP BY 1""")
    add("text_level_summary", lambda wh: cp.level_summary(scanned(wh)), """
        SELECT risk_level, count(doc_id) AS text_count FROM (VALUES ('clean'), ('medium'), ('high')) l(risk_level)
        LEFT JOIN doc_scan USING (risk_level) GROUP BY 1""")
    add("text_rule_score", lambda wh: cp.rule_score(scanned(wh)).select("doc_id", "score"), """
        SELECT doc_id, CAST(CASE WHEN violation_count = 0 THEN 100 WHEN risk_level = 'high' THEN 30
               ELSE greatest(60, 90 - violation_count * 15) END AS INTEGER) AS score FROM doc_scan""")
    add("text_rule_dimensions", lambda wh: cp.rule_dimensions(scanned(wh), ["doc_id"], ["notice", "pressure", "filler", "privacy"]), """
        SELECT d.doc_id, dimension, CASE WHEN h.doc_id IS NULL THEN 100 ELSE 30 END AS score
        FROM documents d CROSS JOIN (VALUES ('notice'), ('pressure'), ('filler'), ('privacy')) n(dimension)
        LEFT JOIN (SELECT DISTINCT doc_id, category FROM doc_hit) h ON h.doc_id = d.doc_id AND h.category = dimension""")
    add("text_score_merge", merged, "SELECT * FROM merged")
    add("text_quality_axes", axes, """
        SELECT axis, CASE axis WHEN '合规性' THEN r ELSE 70.0 END AS score
        FROM (SELECT avg(red_line) AS r FROM merged WHERE doc_id % 60 = (SELECT min(doc_id % 60) FROM documents)),
             (VALUES ('合规性'), ('强度'), ('清晰度'), ('同理'), ('完整'), ('流程')) a(axis)""", score=6)
    add("text_identifiers", identifiers, """
        SELECT case_id, 'CASE' || lpad(CAST(case_id AS VARCHAR), 8, '0') AS normalized, 'X' || case_id AS kept, 'CASE-' || case_id AS mentioned,
               'hello ' || case_id AS quoted, true AS snake, false AS not_snake FROM dim_case""")
    add("text_amount_formats", amounts, """
        SELECT case_id, CASE WHEN initial_outstanding_amount = floor(initial_outstanding_amount) THEN format('{:,.0f}', initial_outstanding_amount)
                             ELSE format('{:,.2f}', initial_outstanding_amount) END AS money,
               printf('%+.2f%%', case_id / 128.0::DOUBLE * 100) AS signed_percent,
               CASE WHEN case_id <= 4 THEN printf('%.2f%%', case_id / 4.0::DOUBLE * 100) ELSE format('{:,.2f}', case_id / 4.0::DOUBLE) END AS shown,
               CASE WHEN case_id = 0 THEN '+0.00%' WHEN case_id <= 4 THEN printf('%+.2f%%', -case_id / 4.0::DOUBLE * 100) ELSE '-' || format('{:,.2f}', case_id / 4.0::DOUBLE) END AS signed
        FROM dim_case""")
    add("contact_case_context", flat_context, "SELECT * FROM case_context", outstanding_amount=4)
    add("contact_frequency", lambda wh: ct.check_frequency(ct.case_context(wh)).select(
        "case_id", "channel", "today_count", "week_count", "daily_limit", "weekly_limit", "allowed", "block_reason"), "SELECT * FROM frequency")
    add("contact_message_type", lambda wh: ct.case_context(wh).select("case_id", ct.message_type().alias("script_type")),
        "SELECT case_id, script_type FROM message")
    draft = "CASE script_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ct.DRAFTS.items()) + " END"
    add("contact_drafts", lambda wh: ct.drafts(wh), f"""
        SELECT m.case_id, 'sms' AS channel, script_type, replace(replace({draft}, '{{company}}', 'XX金融'), '{{amount}}',
               CASE WHEN outstanding_amount = floor(outstanding_amount) THEN format('{{:,.0f}}', outstanding_amount) ELSE format('{{:,.2f}}', outstanding_amount) END) AS draft_content,
               'clean' AS scan_level, 0 AS violation_count, allowed, block_reason, CASE WHEN allowed THEN 'low' ELSE 'high' END AS risk_level,
               protect_flag AS supervisor_review_required, 'pending' AS approval_status
        FROM message m JOIN frequency f ON f.case_id = m.case_id AND f.channel = 'sms'""")
