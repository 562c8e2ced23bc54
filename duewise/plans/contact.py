"""Contact context of every case, frequency limits, message choice and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.buckets import channel_name
from duewise.functions.rates import safe_rate
from duewise.functions.text import fill_template, money
from duewise.operators.ordering import dedupe, latest_per_key
from duewise.plans.compliance import scan

LIMITS = {"sms": (2, 5), "ai_call": (3, 10), "manual": (5, 20)}  # fixed values: daily, weekly
COMPANY = "XX金融"  # fixed value
DRAFTS = {  # fixed values
    "first_overdue": "【{company}】尊敬的客户，您有一笔借款已进入逾期，应还金额 ¥{amount}。请尽快联系我们安排还款，避免影响信用记录。如已还款请忽略。",
    "d1_gentle": "【{company}】您好，您的借款 ¥{amount} 已逾期1天。如有困难可联系我们申请方案。",
    "d7_solution": "【{company}】您的借款 ¥{amount} 已逾期7天。现可申请分期减免（最高20%），请于今日18:00前联系 4001234567 或回复1协商。",
    "d15_reduction": "【{company}】您的借款 ¥{amount} 已逾期较长时间。当前可提交减免或分期申请，请在工作时间联系 4001234567 协商还款安排。",
    "ptp_reminder": "【{company}】温馨提醒，您此前约定的还款安排即将到期，应还金额 ¥{amount}。如需调整方案，请及时联系 4001234567。",
    "ptp_followup": "【{company}】您此前约定的还款安排尚未完成，应还金额 ¥{amount}。如遇困难，请联系 4001234567 重新确认可行方案。",
    "lost_contact": "【{company}】您好，关于您名下借款 ¥{amount} 的还款安排，我们需要与您确认。请在方便时联系 4001234567。",
    "complaint_sensitive": "【{company}】您好，关于您名下借款 ¥{amount}，如需还款协商或服务支持，请通过官方渠道 4001234567 联系我们。",
    "high_risk_manual": "【{company}】您好，您的借款 ¥{amount} 需进一步人工核实还款安排。请联系 4001234567，我们将由专员协助处理。",
    "post_payment": "【{company}】您好，系统已关注到您的还款处理状态。如已完成还款请忽略；如需凭证确认，请联系 4001234567。",
}


def reference_time(wh) -> Column:
    """The newest moment in case status, process and message log, as a scalar."""
    moments = (
        wh["dws_case_status_snapshot_di"].agg(F.max("stat_date").cast("timestamp_ntz").alias("t"))
        .union(wh["dws_collection_process_wide_di"].agg(F.max("stat_date").cast("timestamp_ntz").alias("t")))
        .union(wh["ods_sms_send_log"].agg(F.max("send_time").cast("timestamp_ntz").alias("t")))
    )
    return moments.agg(F.max("t")).scalar()


def case_context(wh) -> DataFrame:
    """One row per case: latest status, contact counts of today and of seven days, last promise, flags.

    The message window starts six days before the reference time to the second, the process window on whole
    days. Clear personal fields are never read.
    """
    now = reference_time(wh)
    today = F.to_date(now)
    status = latest_per_key(
        wh["dws_case_status_snapshot_di"].select("case_id", "stat_date", "outstanding_amount", "vendor_id", "line_id"),
        ["case_id"], "stat_date", ["vendor_id", "line_id"],
    ).drop("stat_date")

    in_week = F.col("stat_date").between(F.date_sub(today, 6), today)
    is_today = F.col("stat_date") == today
    promise = F.col("ptp_count") > 0

    def summed(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0).cast("long"))

    process = wh["dws_collection_process_wide_di"].groupBy("case_id").agg(
        summed("action_count", in_week).alias("week_actions"), summed("connected_count", in_week).alias("week_connected"),
        summed("ai_action_count", in_week).alias("week_ai"), summed("action_count", is_today).alias("today_actions"),
        summed("ai_action_count", is_today).alias("today_ai"),
        F.max(F.when(promise, F.struct("stat_date", "collector_id", "ptp_fulfilled_count"))).alias("_ptp"),
    )
    week_ago = now - F.expr("INTERVAL 6 DAYS")
    sms = wh["ods_sms_send_log"].groupBy("case_id").agg(
        F.count_if(F.col("send_time").between(week_ago, now + F.expr("INTERVAL 1 DAY"))).alias("week_sms"),
        F.count_if(F.to_date("send_time") == today).alias("today_sms"),
    )
    customer = dedupe(
        wh["dim_customer"].select("customer_id", "customer_id_hash", "risk_level_current"), ["customer_id"], ["customer_id_hash"]
    )
    rows = (
        wh["dim_case"].join(customer, "customer_id", "left").join(status, "case_id", "left")
        .join(process, "case_id", "left").join(sms, "case_id", "left")
    )
    zero = F.lit(0).cast("long")
    counts = ["week_actions", "week_connected", "week_ai", "today_actions", "today_ai", "week_sms", "today_sms"]
    filled = rows.withColumns({c: F.coalesce(c, zero) for c in counts})
    return filled.select(
        "case_id", F.coalesce("customer_id_hash", F.lit("")).alias("customer_id_hash"), "initial_dpd_bucket",
        F.coalesce("outstanding_amount", "initial_outstanding_amount", F.lit(0.0)).alias("outstanding_amount"),
        F.coalesce("risk_level_current", F.lit("")).alias("risk_level"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("protect_flag", "complaint_flag", "sensitive_flag")),
        F.col("week_actions").alias("recent_action_count_7d"),
        F.col("week_sms").alias("recent_sms_count_7d"),
        safe_rate("week_connected", "week_actions", clipped=False).alias("recent_connect_rate"),
        F.date_format("_ptp.stat_date", "yyyy-MM-dd").alias("last_ptp_date"),
        (F.col("_ptp.ptp_fulfilled_count") > 0).alias("ptp_fulfilled"),
        F.coalesce("vendor_id", "current_vendor_id").alias("current_vendor_id"),
        F.coalesce("line_id", "current_line_id").alias("current_line_id"),
        F.map_from_entries(F.array(*(
            F.struct(F.lit(channel).alias("channel"), F.struct(day.alias("today"), week.alias("week")).alias("counts"))
            for channel, day, week in (
                ("sms", F.col("today_sms"), F.col("week_sms")),
                ("ai_call", F.col("today_ai"), F.col("week_ai")),
                ("manual", F.greatest(F.col("today_actions") - F.col("today_ai"), zero),
                 F.greatest(F.col("week_actions") - F.col("week_ai"), zero)),
            )
        ))).alias("frequency_counts"),
    )


def check_frequency(contexts: DataFrame, channel: Column | str | None = None) -> DataFrame:
    """Limit check per case and channel (all three when none is given); the daily limit speaks first."""
    limits = F.array(*(
        F.struct(F.lit(c).alias("channel"), F.lit(day).alias("daily_limit"), F.lit(week).alias("weekly_limit"))
        for c, (day, week) in LIMITS.items()
    ))
    wanted = limits if channel is None else F.filter(
        limits, lambda x: x["channel"] == channel_name(F.lit(channel) if isinstance(channel, str) else channel)
    )
    rows = contexts.select("*", F.inline(wanted)).withColumns({
        "today_count": F.coalesce(F.col("frequency_counts")[F.col("channel")]["today"], F.lit(0)),
        "week_count": F.coalesce(F.col("frequency_counts")[F.col("channel")]["week"], F.lit(0)),
    })
    case = F.col("case_id").cast("string")
    reason = F.when(
        F.col("today_count") >= F.col("daily_limit"),
        F.format_string("%s %s 今日触达 %d 次，已达到上限 %d 次", case, "channel", "today_count", "daily_limit"),
    ).when(
        F.col("week_count") >= F.col("weekly_limit"),
        F.format_string("%s %s 近7日触达 %d 次，已达到上限 %d 次", case, "channel", "week_count", "weekly_limit"),
    )
    return rows.withColumn("block_reason", reason).withColumn("allowed", F.col("block_reason").isNull())


def message_type() -> Column:
    """The ordered choice of one of ten message types."""
    bucket = F.upper(F.coalesce("initial_dpd_bucket", F.lit("")))
    risk = F.upper(F.coalesce("risk_level", F.lit("")))
    return (
        F.when(F.col("protect_flag") | F.col("complaint_flag") | F.col("sensitive_flag"), "complaint_sensitive")
        .when(F.coalesce("outstanding_amount", F.lit(0.0)) <= 0, "post_payment")
        .when(F.col("ptp_fulfilled") == F.lit(False), "ptp_followup")
        .when(F.col("last_ptp_date").isNotNull(), "ptp_reminder")
        .when((F.col("recent_connect_rate") <= 0) & (F.col("recent_action_count_7d") >= 3), "lost_contact")
        .when(risk.isin("D", "HIGH") | (bucket == "M3+"), "high_risk_manual")
        .when(bucket == "M2", "d15_reduction")
        .when(bucket == "M1", "d7_solution")
        .when(bucket == "CURRENT", "post_payment")
        .otherwise("first_overdue")
    )


def drafts(wh, channel: str = "sms", contexts: DataFrame | None = None) -> DataFrame:
    """A draft per case with its phrase scan, frequency check and combined risk. Nothing is ever sent."""
    checked = check_frequency(case_context(wh) if contexts is None else contexts, channel)
    template = None
    for name, text in DRAFTS.items():
        hit = F.col("script_type") == name
        template = F.when(hit, F.lit(text)) if template is None else template.when(hit, F.lit(text))
    filled = checked.withColumn("script_type", message_type()).withColumn(
        "draft_content", fill_template(template, {"company": F.lit(COMPANY), "amount": money("outstanding_amount")})
    ).withColumnRenamed("risk_level", "customer_risk_level")
    scanned = scan(filled, "draft_content").withColumnRenamed("risk_level", "scan_level")
    combined = (
        F.when((F.col("scan_level") == "high") | ~F.col("allowed"), "high").when(F.col("scan_level") == "medium", "medium")
        .otherwise("low")
    )
    return scanned.select(
        "case_id", "channel", "script_type", "draft_content", "scan_level", "violation_count", "allowed", "block_reason",
        combined.alias("risk_level"),
        (F.col("protect_flag") | (F.col("scan_level") == "high")).alias("supervisor_review_required"),
        F.lit("pending").alias("approval_status"),
    )
