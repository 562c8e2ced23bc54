"""Detail (DWD), subject (DWS) and application (ADS) layers over any table source.

``Warehouse.table`` returns a table of any layer: the source's own when it has one, otherwise the dataset
built here. Everything is lazy, so a query reads only the columns and tables it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.functions.dates import day_ceiling
from duewise.functions.rates import flag_sum, safe_rate, total
from duewise.operators.joins import met
from duewise.operators.ordering import dedupe, drop_null_keys, latest_per_key, first_per_key, last_observations
from duewise.operators.windows import cap_at, max_date
from duewise.session import stage
from duewise.sources.dated import DatedSource
from duewise.sources.tables import LAYERS, TableMissing, layer_of, write_table

HIGH_BALANCE = 35_000  # fixed value
RECOVERY_FACTORS = [  # fixed values: code, name
    ("CAPACITY_EAST", "华东线路人均案量"),
    ("VENDOR_B_CONNECT", "供应商 B 接通率"),
    ("HIGH_BALANCE_SHARE", "高余额客群占比"),
    ("AI_COVERAGE", "AI 外呼覆盖率"),
    ("REDUCTION_PTP", "减免与 PTP"),
    ("SMS_COMPLAINT", "短信模板投诉"),
]

BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {}


# Tables that several branches of one plan read; staged on first use when a warehouse is opened for that.
SHARED_TABLES = (
    "dwd_due_plan_detail_di",
    "dwd_repayment_detail_di",
    "dwd_collection_action_detail_di",
    "dws_case_status_snapshot_di",
)


class Warehouse:
    """``shared``: built tables to stage on first use, because more than one branch will read them."""

    def __init__(self, source, *, strict: bool = False, shared: Sequence[str] = ()) -> None:
        self.source = source
        self.spark = source.spark
        self.strict = strict
        self.shared = set(shared)
        self.notes: list[str] = []
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if self.source.has(name):
                self._made[name] = self.source.table(name)
            elif name in BUILDERS and not self.strict:
                built = BUILDERS[name](self)
                self._made[name] = stage(built, name) if name in self.shared else built
            else:
                raise TableMissing(f"missing table: {layer_of(name)}/{name}")
        return self._made[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def has(self, name: str) -> bool:
        try:
            self.table(name)
        except TableMissing:
            return False
        return True

    @property
    def dated(self) -> bool:
        """Whether the source shows the days of some windows only."""
        return isinstance(self.source, DatedSource)

    def repayments(self, due: DataFrame) -> DataFrame:
        """Repayment details that hold all those of the plans in ``due``.

        Windows have few plans, so repayments of other plans are left out before ids are made unique, where the source
        can tell that this leaves no id half seen.
        """
        name, finder = "dwd_repayment_detail_di", getattr(self.source, "repayments_of", None)
        if not self.dated or finder is None or self.strict or self.source.has(name):
            return self[name]
        return repayment_rows(finder(due))

    def optional(self, name: str, columns: dict[str, T.DataType]) -> DataFrame:
        """The table when it exists with ``columns``; otherwise an empty one and a note."""
        if self.has(name) and set(columns) <= set(self.table(name).columns):
            return self.table(name)
        self.notes.append(f"missing {layer_of(name)}/{name} or its columns: dependent columns are degraded")
        schema = T.StructType([T.StructField(c, t, True) for c, t in columns.items()])
        return self.spark.createDataFrame([], schema)

    def write(self, root: str, layers: Sequence[str] = LAYERS, fmt: str = "parquet") -> list[str]:
        """Write the built tables of some layers; daily tables are partitioned by date."""
        paths = []
        for name in BUILDERS:
            if layer_of(name) not in layers:
                continue
            df = self.table(name)
            keys = ["stat_date"] if "stat_date" in df.columns and layer_of(name) == "dws" and fmt == "parquet" else None
            paths.append(write_table(df, root, name, fmt, keys))
        return paths


def builds(name: str):
    def register(func: Callable[[Warehouse], DataFrame]):
        BUILDERS[name] = func
        return func

    return register


# --------------------------------------------------------------------------- detail layer


@builds("dwd_due_plan_detail_di")
def due_plan_detail(wh: Warehouse) -> DataFrame:
    """One row per plan: product and channel of the loan, first bucket of its case (CURRENT when none)."""
    plan = dedupe(
        wh["ods_repayment_plan"].withColumn("stat_date", F.to_date("due_date")),
        ["stat_date", "plan_id"],
        ["loan_id", "due_amount"],
    )
    order = [c for c in ("mapping_start_date", "case_id") if c in wh["dim_case_loan_mapping"].columns]
    mapping = wh["dim_case_loan_mapping"].select("loan_id", *order)
    loan = wh["dim_loan"].select("loan_id", "product_code", "channel_code")
    if wh.dated:
        # The plans of some days are few: written once, their size is known, and only their loans are looked up.
        plan = stage(plan, "window-plans")
        mapping, loan = met(mapping, plan, ["loan_id"]), met(loan, plan, ["loan_id"])
    buckets = wh["dim_case"].select("case_id", "initial_dpd_bucket")
    first_case = first_per_key(mapping, ["loan_id"], [F.col(c).asc() for c in order])
    bucket_of_loan = first_case.join(buckets, "case_id", "left").select("loan_id", "initial_dpd_bucket")
    return (
        plan.join(loan, "loan_id", "left")
        .join(bucket_of_loan, "loan_id", "left")
        .select(
            "stat_date", "plan_id", "loan_id", "customer_id", "product_code", "channel_code",
            F.to_date("due_date").alias("due_date"), "due_amount", F.col("due_amount").alias("outstanding_amount"),
            F.coalesce("initial_dpd_bucket", F.lit("CURRENT")).alias("dpd_bucket"),
        )
    )


def repayment_rows(repay: DataFrame) -> DataFrame:
    repay = dedupe(repay, ["repay_id"], ["repay_time", "repay_amount"])
    keep = [c for c in ("repay_id", "plan_id", "loan_id", "customer_id") if c in repay.columns]
    return repay.select(
        *keep, "repay_time", F.to_date("repay_time").alias("repay_date"), "repay_amount", "repay_status"
    )


@builds("dwd_repayment_detail_di")
def repayment_detail(wh: Warehouse) -> DataFrame:
    return repayment_rows(wh["ods_repayment_detail"])


@builds("dwd_collection_action_detail_di")
def collection_action_detail(wh: Warehouse) -> DataFrame:
    action = dedupe(wh["ods_collection_action"], ["action_id"], ["action_time", "case_id"])
    return action.select(
        "action_id", "case_id", "customer_id", "vendor_id", "line_id", "collector_id", "action_time",
        F.to_date("action_time").alias("action_date"), "action_type", "template_id", "connected_flag", "ptp_flag",
        "ptp_fulfilled_flag", "ai_outbound_flag",
    )


@builds("dwd_case_flow_detail_di")
def case_flow_detail(wh: Warehouse) -> DataFrame:
    flow = dedupe(wh["ods_case_flow"], ["flow_id"], ["flow_time", "case_id"])
    return flow.select(
        "flow_id", "case_id", "from_status", "to_status", "flow_time", F.to_date("flow_time").alias("flow_date"),
        "strategy_id",
    )


@builds("dwd_complaint_detail_di")
def complaint_detail(wh: Warehouse) -> DataFrame:
    complaint = dedupe(wh["ods_complaint"], ["complaint_id"], ["complaint_time", "case_id"])
    return complaint.select(
        "complaint_id", "case_id", "customer_id", "vendor_id", "collector_id", "template_id", "complaint_time",
        F.to_date("complaint_time").alias("complaint_date"), "complaint_type", "complaint_level",
    )


# --------------------------------------------------------------------------- subject layer


def plan_recoveries(due: DataFrame, repay: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per plan: amount repaid by midnight of due date + N days, for each N; early payments count.

    Payments are summed per (plan, day) first, which both makes the plan's payments few and keeps a plan
    with several payments from repeating its due amount. The rest of ``due`` is kept, one row per plan.
    """
    daily = (
        repay.select("plan_id", day_ceiling("repay_time").alias("_by"), "repay_amount")
        .dropna(subset=["plan_id", "_by"])
        .groupBy("plan_id", "_by")
        .agg(F.sum("repay_amount").alias("_paid"))
    )
    sums = [
        total(F.when(F.col("_by") <= F.date_add(F.to_date("due_date"), n), F.col("_paid"))).alias(f"repaid_amount_d{n}")
        for n in horizons
    ]
    return due.join(daily, "plan_id", "left").groupBy(*due.columns).agg(*sums)


@builds("dws_loan_status_snapshot_di")
def loan_status_snapshot(wh: Warehouse) -> DataFrame:
    due = wh["dwd_due_plan_detail_di"].select(
        "plan_id", "stat_date", "loan_id", "customer_id", "product_code", "dpd_bucket", "due_date", "due_amount"
    )
    paid = plan_recoveries(due, wh.repayments(due), [7])
    return paid.select(
        "stat_date", "loan_id", "customer_id", "product_code", "dpd_bucket", "due_amount", "repaid_amount_d7",
        safe_rate("repaid_amount_d7", "due_amount").alias("recovery_rate_d7"),
    )


def repaid_by_case(wh: Warehouse) -> DataFrame:
    """Amount repaid per (date, case). Summed per loan and day before the mapping is joined."""
    loan_day = (
        drop_null_keys(wh["dwd_repayment_detail_di"], ["repay_date", "loan_id"])
        .groupBy("loan_id", "repay_date")
        .agg(total("repay_amount").alias("_paid"))
    )
    mapping = wh["dim_case_loan_mapping"].select("case_id", "loan_id")
    return (
        drop_null_keys(loan_day.join(mapping, "loan_id", "inner"), ["case_id"])
        .groupBy(F.col("repay_date").alias("stat_date"), "case_id")
        .agg(total("_paid").alias("repaid_amount"))
    )


@builds("dws_case_status_snapshot_di")
def case_status_snapshot(wh: Warehouse) -> DataFrame:
    actions = (
        drop_null_keys(wh["dwd_collection_action_detail_di"], ["action_date", "case_id"])
        .groupBy(F.col("action_date").alias("stat_date"), "case_id")
        .agg(
            F.count("action_id").alias("action_count"),
            flag_sum("connected_flag").alias("connected_count"),
            flag_sum("ptp_flag").alias("ptp_count"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        wh["ods_case_daily_snapshot"]
        .join(actions, ["stat_date", "case_id"], "left")
        .join(repaid_by_case(wh), ["stat_date", "case_id"], "left")
        .select(
            "stat_date", "case_id", "customer_id", "vendor_id", "line_id", "collector_id", "dpd_bucket",
            "outstanding_amount",
            *(F.coalesce(c, zero).alias(c) for c in ("action_count", "connected_count", "ptp_count")),
            F.coalesce("repaid_amount", F.lit(0.0)).alias("repaid_amount"),
        )
    )


@builds("dws_customer_status_snapshot_di")
def customer_status_snapshot(wh: Warehouse) -> DataFrame:
    return wh["ods_customer_daily_snapshot"].select(
        "stat_date", "customer_id", "active_loan_count", "active_case_count", "total_outstanding_amount", "max_dpd",
        "risk_level",
    )


PROCESS_GRAIN = ["stat_date", "case_id", "vendor_id", "line_id", "collector_id"]


@builds("dws_collection_process_wide_di")
def collection_process_wide(wh: Warehouse) -> DataFrame:
    """Daily process counts. The real grain is the five columns of ``PROCESS_GRAIN``.

    Complaints are known per (date, case) only, so a case worked by two collectors on one day shows its
    complaints on both rows.
    """
    complaints = (
        drop_null_keys(wh["dwd_complaint_detail_di"], ["complaint_date", "case_id"])
        .groupBy(F.col("complaint_date").alias("stat_date"), "case_id")
        .agg(F.count("complaint_id").alias("complaint_count"))
    )
    actions = wh["dwd_collection_action_detail_di"].withColumn("stat_date", F.col("action_date"))
    process = (
        drop_null_keys(actions, PROCESS_GRAIN)
        .groupBy(*PROCESS_GRAIN)
        .agg(
            F.count("action_id").alias("action_count"),
            flag_sum("ai_outbound_flag").alias("ai_action_count"),
            flag_sum("connected_flag").alias("connected_count"),
            flag_sum("ptp_flag").alias("ptp_count"),
            flag_sum("ptp_fulfilled_flag").alias("ptp_fulfilled_count"),
        )
        .join(complaints, ["stat_date", "case_id"], "left")
    )
    return process.select(
        *PROCESS_GRAIN, "action_count", "ai_action_count", "connected_count", "ptp_count", "ptp_fulfilled_count",
        F.coalesce("complaint_count", F.lit(0).cast("long")).alias("complaint_count"),
        safe_rate("connected_count", "action_count").alias("connect_rate"),
        safe_rate("ptp_fulfilled_count", "ptp_count").alias("ptp_fulfillment_rate"),
        safe_rate("ai_action_count", "action_count").alias("ai_coverage_rate"),
    )


@builds("dws_vendor_line_capacity_di")
def vendor_line_capacity(wh: Warehouse) -> DataFrame:
    daily = (
        drop_null_keys(wh["ods_case_daily_snapshot"], ["stat_date", "vendor_id", "line_id"])
        .groupBy("stat_date", "vendor_id", "line_id")
        .agg(
            F.countDistinct("case_id").alias("active_case_count"),
            F.countDistinct("collector_id").alias("active_collector_count"),
        )
    )
    return daily.join(wh["dim_collection_line"].select("line_id", "region"), "line_id", "left").select(
        "stat_date", "vendor_id", "line_id", "region", "active_case_count", "active_collector_count",
        safe_rate("active_case_count", "active_collector_count", clipped=False, scale=4).alias("case_per_collector"),
    )


@builds("dws_customer_profile_di")
def customer_profile(wh: Warehouse) -> DataFrame:
    status = wh["dws_customer_status_snapshot_di"]
    latest = latest_per_key(
        status.select("customer_id", "stat_date", "total_outstanding_amount"),
        ["customer_id"], "stat_date", ["total_outstanding_amount"],
    ).select("customer_id", "total_outstanding_amount")
    return wh["dim_customer"].join(latest, "customer_id", "left").select(
        max_date(status).alias("stat_date"), "customer_id", "customer_id_hash", "mobile_masked", "province",
        "customer_segment", "risk_level_current",
        F.coalesce("total_outstanding_amount", F.lit(0.0)).alias("total_outstanding_amount"),
    )


def first_by_case(column: str) -> Column:
    """First non-null value in (case, vendor, line) order inside a group."""
    order = F.struct("case_id", "vendor_id", "line_id")
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


@builds("dws_collector_profile_di")
def collector_profile(wh: Warehouse) -> DataFrame:
    daily = wh["dws_collection_process_wide_di"].groupBy("stat_date", "collector_id").agg(
        first_by_case("vendor_id").alias("vendor_id"),
        first_by_case("line_id").alias("line_id"),
        F.sum("action_count").alias("action_count"),
        F.sum("connected_count").alias("connected_count"),
        F.sum("complaint_count").alias("complaint_count"),
    )
    return daily.join(wh["dim_collector"].select("collector_id", "skill_level"), "collector_id", "left").select(
        "stat_date", "collector_id", "vendor_id", "line_id", "skill_level", "action_count",
        safe_rate("connected_count", "action_count").alias("connect_rate"), "complaint_count",
    )


@builds("dws_customer_postloan_tag_di")
def customer_postloan_tag(wh: Warehouse) -> DataFrame:
    """Tags per customer and day; a missing DPD falls through to M3+."""
    return wh["dws_customer_status_snapshot_di"].select(
        "stat_date", "customer_id",
        F.when(F.col("max_dpd") <= 30, "M1").when(F.col("max_dpd") <= 60, "M2").otherwise("M3+").alias("dpd_tag"),
        F.when(F.col("total_outstanding_amount") >= HIGH_BALANCE, "HIGH").otherwise("NORMAL").alias("balance_tag"),
        F.when(F.col("active_case_count") > 1, "MULTI_CASE").otherwise("SINGLE_CASE").alias("behavior_tag"),
        F.lit("TOUCH_PENDING").alias("touch_tag"), F.lit("NORMAL").alias("compliance_tag"),
        F.lit("BASE").alias("strategy_tag"),
    )


@builds("ods_loan_daily_snapshot")
def loan_daily_snapshot(wh: Warehouse) -> DataFrame:
    from duewise.plans.daily_state import loan_daily_state

    return loan_daily_state(wh)


# --------------------------------------------------------------------------- application layer


@builds("ads_postloan_dashboard_di")
def postloan_dashboard(wh: Warehouse) -> DataFrame:
    from duewise.plans.metrics import dashboard

    return dashboard(wh)


@builds("ads_recovery_attribution_di")
def recovery_attribution(wh: Warehouse) -> DataFrame:
    """The last 30 dashboard dates, each with the fixed list of factors (placeholder values by design)."""
    factors = F.array(*(
        F.struct(
            F.lit(code).alias("factor_code"), F.lit(name).alias("factor_name"),
            F.lit(idx / 10.0).alias("factor_value"),
            F.lit(round(min(1.0, 0.08 + idx * 0.035), 6)).alias("contribution_pct"),
        )
        for idx, (code, name) in enumerate(RECOVERY_FACTORS, start=1)
    ))
    dates = last_observations(wh["ads_postloan_dashboard_di"].select("stat_date"), "stat_date", 30)
    return dates.select("stat_date", F.inline(factors))


@builds("ads_vendor_performance_di")
def vendor_performance(wh: Warehouse) -> DataFrame:
    process = wh["dws_collection_process_wide_di"].groupBy("stat_date", "vendor_id").agg(
        F.sum("action_count").alias("action_count"),
        F.countDistinct("case_id").alias("called_case_count"),
        F.sum("connected_count").alias("connected_count"),
        F.sum("ptp_count").alias("ptp_count"),
        F.sum("ptp_fulfilled_count").alias("ptp_fulfilled_count"),
        F.sum("complaint_count").alias("complaint_count"),
    )
    assigned = (
        drop_null_keys(wh["dws_case_status_snapshot_di"], ["stat_date", "vendor_id"])
        .groupBy("stat_date", "vendor_id")
        .agg(F.countDistinct("case_id").alias("assigned_case_count"))
    )
    return process.join(assigned, ["stat_date", "vendor_id"], "left").select(
        "stat_date", "vendor_id", "action_count",
        safe_rate("called_case_count", "assigned_case_count").alias("call_coverage_rate"),
        safe_rate("connected_count", "action_count").alias("connect_rate"),
        safe_rate("ptp_count", "connected_count").alias("ptp_rate"),
        safe_rate("ptp_fulfilled_count", "ptp_count").alias("ptp_keep_rate"),
        safe_rate("complaint_count", "assigned_case_count").alias("complaint_rate"),
    )


COLLECTOR_DAILY = [
    "first_contact_hours", "avg_call_duration_per_call", "avg_call_duration_per_collector", "collector_productivity"
]


@builds("ads_collector_performance_di")
def collector_performance(wh: Warehouse) -> DataFrame:
    daily = wh["dws_collection_process_wide_di"].groupBy("stat_date", "collector_id").agg(
        first_by_case("vendor_id").alias("vendor_id"),
        F.sum("action_count").alias("action_count"),
        F.sum("connected_count").alias("connected_count"),
        F.sum("ptp_count").alias("ptp_count"),
        F.sum("ptp_fulfilled_count").alias("ptp_fulfilled_count"),
        F.sum("complaint_count").alias("complaint_count"),
    )
    board = wh["ads_postloan_dashboard_di"].select("stat_date", *COLLECTOR_DAILY)
    return daily.join(board, "stat_date", "left").select(
        "stat_date", "collector_id", "vendor_id", "action_count",
        safe_rate("connected_count", "action_count").alias("connect_rate"),
        safe_rate("ptp_fulfilled_count", "ptp_count").alias("ptp_keep_rate"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in COLLECTOR_DAILY),
        "complaint_count",
    )


@builds("ads_reduction_roi_di")
def reduction_roi_daily(wh: Warehouse) -> DataFrame:
    applications = cap_at(
        wh["ods_reduction_application"].withColumn("stat_date", F.to_date("apply_time")),
        max_date(wh["dws_case_status_snapshot_di"]),
    )
    used = applications.groupBy("stat_date").agg(
        F.countDistinct("case_id").alias("reduction_case_count"),
        total("approved_amount").alias("approved_reduction_amount"),
    )
    board = wh["ads_postloan_dashboard_di"].select(
        "stat_date", "reduction_usage_rate", "reduction_recovery_rate", "reduction_roi"
    )
    return board.join(used, "stat_date", "left").select(
        "stat_date",
        F.coalesce("reduction_case_count", F.lit(0).cast("long")).alias("reduction_case_count"),
        F.coalesce("approved_reduction_amount", F.lit(0.0)).alias("approved_reduction_amount"),
        "reduction_usage_rate", "reduction_recovery_rate", "reduction_roi",
    )


COMPLIANCE_DAILY = [
    "complaint_rate", "complaint_per_10k_cases", "risk_phrase_hit_rate", "qa_fail_rate", "over_frequency_contact_rate"
]


@builds("ads_compliance_qc_di")
def compliance_qc(wh: Warehouse) -> DataFrame:
    active = wh["dws_case_status_snapshot_di"].groupBy("stat_date").agg(F.countDistinct("case_id").alias("active_case_count"))
    complaints = (
        drop_null_keys(wh["dwd_complaint_detail_di"], ["complaint_date"])
        .groupBy(F.col("complaint_date").alias("stat_date"))
        .agg(F.count("complaint_id").alias("complaint_count"))
    )
    board = wh["ads_postloan_dashboard_di"].select("stat_date", *COMPLIANCE_DAILY)
    zero = F.lit(0).cast("long")
    return board.join(active, "stat_date", "left").join(complaints, "stat_date", "left").select(
        "stat_date", F.lit("ALL").alias("template_id"),
        F.coalesce("active_case_count", zero).alias("active_case_count"),
        F.coalesce("complaint_count", zero).alias("complaint_count"),
        *COMPLIANCE_DAILY,
    )
