"""The collections model (dimension and source tables) derived from star-schema tables.

Orders are loans with one repayment plan each, line items are repayments, events are collection actions,
complaints, concession applications and scores, suppliers are collectors, nations are collection lines and
regions are vendors. Ten consecutive customers share one case. Event dates are folded into the 60 days that
end on ``ANCHOR_DATE``, the last order date, so that daily facts of both kinds meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.functions.dates import months_on_book
from duewise.sources.tables import TableMissing, layer_of

ANCHOR_DATE = "2001-08-01"
PANEL_DAYS = 60
SCORE_START = "1995-01-01"
SCORE_SPAN = 2400


def anchor() -> Column:
    return F.to_date(F.lit(ANCHOR_DATE))


def panel_bounds() -> tuple[Column, Column]:
    """First and last day of the daily snapshots: the model's panel is the last 60 days."""
    return F.date_sub(anchor(), PANEL_DAYS - 1), anchor()


def on_panel_days(df: DataFrame, key: str) -> DataFrame:
    """Every row on every panel day, as ``stat_date``.

    A product with the few days, not an exploded array: the planner's size estimate of it grows with the days, so that no
    snapshot is taken for a small table and broadcast, and a filter on the day is applied to the days alone. Rows are dealt
    by ``key`` first: a table of one file or a few row groups would make all its days in as many tasks, and steps by key
    and day then need no shuffle of the days.
    """
    spark, first = df.sparkSession, panel_bounds()[0]
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    days = spark.range(PANEL_DAYS).select(F.date_add(first, F.col("id").cast("int")).alias("stat_date"))
    return df.crossJoin(F.broadcast(days))


class StarSchemaDomain:
    """Source tables of the model, built lazily from ``<root>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.notes: list[str] = []
        self._made: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}
        self.panel = panel_bounds()

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._raw[name]

    def has(self, name: str) -> bool:
        return name in BUILDERS

    def table(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise TableMissing(f"missing table: {layer_of(name)}/{name}")
        if name not in self._made:
            self._made[name] = BUILDERS[name](self)
        return self._made[name]

    @cached_property
    def lines(self) -> DataFrame:
        """Nation with its region. Both tables are fixed at 25 and 5 rows whatever the scale."""
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)

    @cached_property
    def case_events(self) -> DataFrame:
        """Events with the columns that actions, complaints and applications share."""
        back = F.expr("cast(event_id % 60 as int)")
        day = F.date_sub(anchor(), back)
        return self.raw("events").select(
            "event_id",
            "event_type",
            "value",
            F.col("user_id").alias("case_id"),
            (F.col("user_id") * 10).alias("customer_id"),
            F.expr("(2 * user_id + event_id % 2) div 3").alias("collector_id"),
            day.alias("event_date"),
            F.expr(
                f"cast(date_sub(date'{ANCHOR_DATE}', cast(event_id % 60 as int)) as timestamp_ntz)"
                " + make_dt_interval(0, hour(ts), minute(ts), extract(SECOND FROM ts))"
            ).alias("event_time"),
            F.when(F.col("event_id") % 4 == 0, F.lit("TPL_RISK_NOTICE"))
            .otherwise(F.concat(F.lit("TPL_"), (F.col("event_id") % 3).cast("string")))
            .alias("template"),
        )

    def repayments_of(self, plans: DataFrame) -> DataFrame:
        """The repayments of ``plans``, with every row that shares a ``repay_id`` with one of them.

        The id is written here from the plan and three more keys, so rows of one id have one plan. Only where a key is
        missing can ids of several plans be equal, and then to ids that also miss one: those rows all come along.
        """
        lines, odd = self.raw("lineitem"), F.lit(False)
        for key in REPAY_ID:
            odd = odd | F.col(key).isNull()
        own = lines.filter(~odd).join(plans.select(F.col("plan_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        return repayment_rows(own.unionByName(lines.filter(odd)))

    def with_collector_place(self, df: DataFrame) -> DataFrame:
        """Add vendor and line of the collector."""
        place = self.table("dim_collector").select("collector_id", "vendor_id", "line_id")
        return df.join(place, "collector_id", "left")


BUILDERS: dict[str, Callable[[StarSchemaDomain], DataFrame]] = {}


def builds(name: str):
    def register(func: Callable[[StarSchemaDomain], DataFrame]):
        BUILDERS[name] = func
        return func

    return register


@builds("dim_customer")
def dim_customer(d: StarSchemaDomain) -> DataFrame:
    key = F.col("c_custkey")
    home = d.lines.select("n_nationkey", "n_name")
    risk = F.when(F.col("c_acctbal") < 0, "high").when(F.col("c_acctbal") < 5000, "medium").otherwise("low")
    return (
        d.raw("customer")
        .join(F.broadcast(home), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("customer_id"),
            F.sha2(key.cast("string"), 256).alias("customer_id_hash"),
            F.concat(F.lit("1******"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("mobile_masked"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
            F.concat(F.lit("AGE_"), (key % 5).cast("string")).alias("age_group"),
            F.col("n_name").alias("province"),
            F.concat_ws("-", "n_name", (key % 3).cast("string")).alias("city"),
            F.concat(F.lit("OCC_"), (key % 7).cast("string")).alias("occupation_type"),
            F.col("c_mktsegment").alias("customer_segment"),
            risk.alias("risk_level_current"),
            F.col("c_name").alias("customer_name"),
            F.col("c_acctbal").alias("account_balance"),
        )
    )


@builds("dim_loan")
def dim_loan(d: StarSchemaDomain) -> DataFrame:
    key = F.col("o_orderkey")
    disbursed = F.date_sub(F.to_date("o_orderdate"), 30)
    channel = d.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return (
        d.raw("orders")
        .join(channel, "o_custkey", "left")
        .select(
            key.alias("loan_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("product_code"),
            F.when(key % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("channel_code"),
            (F.col("o_totalprice") * 1.25).alias("loan_amount"),
            (12 + 12 * (key % 3)).cast("int").alias("loan_term"),
            (0.08 + (key % 5) / 100.0).alias("interest_rate"),
            disbursed.alias("disburse_time"),
            months_on_book(anchor(), disbursed).alias("mob"),
            F.date_format(disbursed, "yyyy-MM").alias("vintage_month"),
        )
    )


@builds("dim_collector")
def dim_collector(d: StarSchemaDomain) -> DataFrame:
    skill = F.when(F.col("s_acctbal") < 0, "JUNIOR").when(F.col("s_acctbal") < 5000, "MIDDLE").otherwise("SENIOR")
    return (
        d.raw("supplier")
        .join(F.broadcast(d.lines), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("collector_id"),
            F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("line_id"),
            F.concat(F.lit("V_"), F.col("r_name")).alias("vendor_id"),
            skill.alias("skill_level"),
        )
    )


@builds("dim_collection_line")
def dim_collection_line(d: StarSchemaDomain) -> DataFrame:
    return d.lines.select(
        F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("line_id"),
        F.concat(F.lit("Line "), F.col("n_name")).alias("line_name"),
        F.concat(F.lit("V_"), F.col("r_name")).alias("vendor_id"),
        F.col("r_name").alias("region"),
    )


@builds("dim_vendor")
def dim_vendor(d: StarSchemaDomain) -> DataFrame:
    return d.raw("region").select(
        F.concat(F.lit("V_"), F.col("r_name")).alias("vendor_id"),
        F.concat(F.lit("Vendor "), F.col("r_name")).alias("vendor_name"),
    )


@builds("dim_case")
def dim_case(d: StarSchemaDomain) -> DataFrame:
    base = (
        d.raw("customer")
        .groupBy(F.expr("c_custkey div 10").alias("case_id"))
        .agg(
            F.min("c_custkey").alias("customer_id"),
            F.round(F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0))), 2).alias("initial_outstanding_amount"),
        )
        .withColumn(
            "case_create_date", F.expr(f"date_sub(date'{ANCHOR_DATE}', cast(case_id % 60 as int))")
        )
        .withColumn("collector_id", F.expr("(2 * case_id) div 3"))
    )
    key = F.col("case_id")
    bucket = (
        F.when(key % 5 < 2, "M1").when(key % 5 == 2, "M2").when(key % 5 == 3, "M3+").otherwise(F.lit(None).cast("string"))
    )
    segment = F.when(key % 6 == 5, F.lit(None).cast("string")).when(
        F.col("initial_outstanding_amount") >= 35000, "HIGH"
    ).otherwise("NORMAL")
    return d.with_collector_place(base).select(
        "case_id",
        "customer_id",
        F.expr("cast(case_create_date as timestamp_ntz) + make_dt_interval(0, 9, 30, 0)").alias("case_create_time"),
        bucket.alias("initial_dpd_bucket"),
        "initial_outstanding_amount",
        segment.alias("balance_segment"),
        (key % 11 == 0).alias("protect_flag"),
        (key % 13 == 0).alias("sensitive_flag"),
        (key % 17 == 0).alias("complaint_flag"),
        F.col("vendor_id").alias("current_vendor_id"),
        F.col("line_id").alias("current_line_id"),
        "collector_id",
    )


@builds("dim_case_loan_mapping")
def dim_case_loan_mapping(d: StarSchemaDomain) -> DataFrame:
    return d.raw("orders").select(
        F.expr("o_custkey div 10").alias("case_id"),
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_orderkey") % 7 != 0).alias("main_loan_flag"),
        F.to_date("o_orderdate").alias("mapping_start_date"),
    )


@builds("ods_repayment_plan")
def ods_repayment_plan(d: StarSchemaDomain) -> DataFrame:
    return d.raw("orders").select(
        F.col("o_orderkey").alias("plan_id"),
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("due_date"),
        F.col("o_totalprice").alias("due_amount"),
    )


REPAY_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def repayment_rows(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat_ws("-", *REPAY_ID).alias("repay_id"),
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_orderkey").alias("loan_id"),
        F.col("l_shipdate").alias("repay_time"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100) / 100.0).alias("repay_amount"),
        F.when(F.col("l_returnflag") == "R", "REVERSED").otherwise("SUCCESS").alias("repay_status"),
    )


@builds("ods_repayment_detail")
def ods_repayment_detail(d: StarSchemaDomain) -> DataFrame:
    return repayment_rows(d.raw("lineitem"))


@builds("ods_collection_action")
def ods_collection_action(d: StarSchemaDomain) -> DataFrame:
    kind = F.col("event_type")
    actions = d.case_events.filter(kind != "error").select(
        F.col("event_id").alias("action_id"),
        "case_id",
        "customer_id",
        "collector_id",
        F.col("event_time").alias("action_time"),
        F.when(kind == "click", "SMS").when(kind == "signup", "AI_OUTBOUND").otherwise("CALL").alias("action_type"),
        F.when(kind == "click", F.col("template")).alias("template_id"),
        (F.col("value") >= 50).alias("connected_flag"),
        (kind == "purchase").alias("ptp_flag"),
        ((kind == "purchase") & (F.col("value") >= 75)).alias("ptp_fulfilled_flag"),
        (kind == "signup").alias("ai_outbound_flag"),
    )
    return d.with_collector_place(actions)


@builds("ods_call_record")
def ods_call_record(d: StarSchemaDomain) -> DataFrame:
    return d.raw("events").filter(F.col("event_type").isin("view", "purchase", "signup")).select(
        F.col("event_id").alias("action_id"), F.col("value").alias("duration_seconds")
    )


@builds("ods_sms_send_log")
def ods_sms_send_log(d: StarSchemaDomain) -> DataFrame:
    return d.case_events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("sms_id"), "case_id", F.col("event_time").alias("send_time"),
        F.col("template").alias("template_id"),
    )


@builds("ods_complaint")
def ods_complaint(d: StarSchemaDomain) -> DataFrame:
    level = F.when(F.col("value") < 40, "LOW").when(F.col("value") < 80, "MEDIUM").otherwise("HIGH")
    rows = d.case_events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("complaint_id"),
        "case_id",
        "customer_id",
        "collector_id",
        F.when(F.col("event_id") % 5 != 0, F.col("template")).alias("template_id"),
        F.col("event_time").alias("complaint_time"),
        F.concat(F.lit("T"), (F.col("event_id") % 3).cast("string")).alias("complaint_type"),
        level.alias("complaint_level"),
    )
    return d.with_collector_place(rows)


@builds("ods_reduction_application")
def ods_reduction_application(d: StarSchemaDomain) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    return d.case_events.filter((F.col("event_type") == "signup") & (F.col("value") >= 80)).select(
        F.col("event_id").alias("reduction_id"),
        "case_id",
        "customer_id",
        F.col("event_time").alias("apply_time"),
        F.when(even, F.col("value")).otherwise(F.lit(0.0)).alias("approved_amount"),
        F.when(even, "APPROVED").otherwise("REJECTED").alias("approval_status"),
    )


@builds("ods_postloan_c_score")
def ods_postloan_c_score(d: StarSchemaDomain) -> DataFrame:
    value = F.col("value")
    level = F.when(value >= 100, "A").when(value >= 60, "B").when(value >= 25, "C").otherwise("D")
    day = F.expr(f"date_add(date'{SCORE_START}', cast((event_id * 7919) % {SCORE_SPAN} as int))")
    return d.raw("events").select(
        F.col("event_id").alias("score_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("customer_id"),
        F.date_format(day, "yyyy-MM-dd").alias("score_date"),
        (300 + value).alias("postloan_c_score"),
        level.alias("score_level"),
    )


@builds("ods_case_flow")
def ods_case_flow(d: StarSchemaDomain) -> DataFrame:
    return d.case_events.filter(F.col("event_type").isin("view", "purchase")).select(
        F.col("event_id").alias("flow_id"),
        "case_id",
        F.lit("assigned").alias("from_status"),
        F.when(F.col("value") >= 50, "in_collection").otherwise("assigned").alias("to_status"),
        F.col("event_time").alias("flow_time"),
        F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string")).alias("strategy_id"),
    )


@builds("ods_case_daily_snapshot")
def ods_case_daily_snapshot(d: StarSchemaDomain) -> DataFrame:
    """Every case on every panel day; one spine row per case and day, generated in place."""
    age = F.datediff(anchor(), F.col("stat_date"))
    rows = (
        on_panel_days(
            d.table("dim_case").select("case_id", "customer_id", "initial_dpd_bucket", "initial_outstanding_amount"), "case_id"
        )
        .withColumn("collector_id", (F.expr("2 * case_id") + F.expr(f"datediff(date'{ANCHOR_DATE}', stat_date) % 2")))
        .withColumn("collector_id", F.expr("collector_id div 3"))
        .withColumn(
            "outstanding_amount", F.col("initial_outstanding_amount") * ((F.col("case_id") + age) % 4) / 4.0
        )
    )
    status = (
        F.when(F.col("outstanding_amount") <= 0, "cured").when(age > 30, "assigned").otherwise("in_collection")
    )
    return d.with_collector_place(rows).select(
        "stat_date", "case_id", "customer_id", "vendor_id", "line_id", "collector_id",
        status.alias("case_status"),
        F.coalesce(F.col("initial_dpd_bucket"), F.lit("CURRENT")).alias("dpd_bucket"),
        "outstanding_amount",
    )


@builds("ods_customer_daily_snapshot")
def ods_customer_daily_snapshot(d: StarSchemaDomain) -> DataFrame:
    key = F.col("c_custkey")
    age = F.datediff(anchor(), F.col("stat_date"))
    rows = on_panel_days(d.raw("customer").select("c_custkey", "c_acctbal"), "c_custkey").select(
        "stat_date",
        key.alias("customer_id"),
        (1 + key % 3).cast("int").alias("active_loan_count"),
        (1 + key % 2).cast("int").alias("active_case_count"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * (1 + (key + age) % 3) * 4).alias("total_outstanding_amount"),
        F.when(key % 50 != 7, ((key * 7 + age) % 95).cast("int")).alias("max_dpd"),
    )
    risk = (
        F.when(F.col("total_outstanding_amount") <= 0, "low")
        .when(F.col("max_dpd") <= 30, "low")
        .when(F.col("max_dpd") <= 60, "medium")
        .otherwise("high")
    )
    return rows.withColumn("risk_level", risk)
