"""State of loans, cases and customers over time, rebuilt from plans and repayments.

Loan states are kept interval-coded: one row per change, valid over a half-open range of dates. Rows grow with
payments, never with days; days are made only for the dates that a caller asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duewise.functions.buckets import dpd_bucket
from duewise.functions.rates import clip


def panel(wh) -> tuple[Column, Column]:
    """First and last date of the daily panel: what the source states, else the range of the case snapshots."""
    stated = getattr(wh.source, "panel", None)
    if stated is not None:
        return stated
    dates = wh["ods_case_daily_snapshot"].select(F.to_date("stat_date").alias("d"))
    return dates.agg(F.min("d")).scalar(), dates.agg(F.max("d")).scalar()


def loan_changes(wh) -> DataFrame:
    """One row per loan and change of what has been repaid, from the due date on: ``[valid_from, valid_to)``.

    The last row of a loan has a null ``valid_to`` and holds for good. Payments made before the due date count in
    the first row. Only successful repayments count, so outstanding never rises; payments without a plan are left out.
    """
    plan = wh["ods_repayment_plan"].groupBy("loan_id").agg(F.struct(
        F.min("customer_id").alias("customer_id"), F.min(F.to_date("due_date")).alias("due_date"), F.sum("due_amount").alias("due_amount"),
    ).alias("_plan"))
    paid = wh["dwd_repayment_detail_di"].filter(F.col("repay_status") == "SUCCESS").select(
        "loan_id", F.col("repay_date").alias("_day"), F.col("repay_amount").alias("_paid")
    )
    events = (
        paid.unionByName(plan.select("loan_id", F.col("_plan.due_date").alias("_day"), "_plan"), allowMissingColumns=True)
        .dropna(subset=["loan_id", "_day"])
        .groupBy("loan_id", "_day").agg(F.coalesce(F.sum("_paid"), F.lit(0.0)).alias("_paid"), F.max("_plan").alias("_plan"))
    )
    by_day = W.partitionBy("loan_id").orderBy("_day")
    to_date = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    coded = events.select(
        "loan_id", "_day", F.sum("_paid").over(to_date).alias("cumulative_repaid"), F.lead("_day").over(by_day).alias("valid_to"),
        F.max("_plan").over(W.partitionBy("loan_id")).alias("_plan"),
    )
    owed = clip(F.col("_plan.due_amount") - F.col("cumulative_repaid"), 0.0)
    return coded.filter(F.col("_plan").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_plan.due_date")))).select(
        "loan_id", "_plan.customer_id", "_plan.due_date", F.greatest("_day", "_plan.due_date").alias("valid_from"), "valid_to",
        "cumulative_repaid", F.round(owed, 2).alias("outstanding_amount"),
    )


def holds_on(date: Column | str) -> Column:
    """Whether a change is the one in force on ``date``."""
    day = F.col(date) if isinstance(date, str) else date
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def dpd_on(date: Column | str) -> Column:
    """Days past due on a date; 0 where nothing is owed."""
    return F.when(F.col("outstanding_amount") <= 0, F.lit(0)).otherwise(F.greatest(F.datediff(date, "due_date"), F.lit(0)))


def status_of(dpd: Column | str) -> Column:
    days = F.col(dpd) if isinstance(dpd, str) else dpd
    return (
        F.when(F.col("outstanding_amount") <= 0, "closed").when(days == 0, "current")
        .when(days <= 30, "overdue").otherwise("in_collection")
    )


def loan_daily_state(wh, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Outstanding, days past due, bucket and status of every loan on each date from ``first`` to ``last`` that is not
    before its due date; the panel's dates by default."""
    start, end = panel(wh)
    start, end = start if first is None else first, end if last is None else last
    changes = loan_changes(wh)
    begins = F.greatest("valid_from", start)
    ends = F.least(F.coalesce(F.date_sub("valid_to", 1), end), end)
    days = (
        changes.filter(begins <= ends).select("*", F.explode(F.sequence(begins, ends)).alias("stat_date"))
        .withColumn("dpd", dpd_on("stat_date"))
    )
    return days.select(
        "stat_date", "loan_id", "customer_id", "dpd", dpd_bucket("dpd").alias("dpd_bucket"), "outstanding_amount",
        status_of("dpd").alias("loan_status"), "cumulative_repaid",
    )


def loan_states_at(wh, asked: DataFrame, dates: dict[str, str]) -> DataFrame:
    """loan_id and a struct (snapshot_date, dpd, outstanding_amount, loan_status) for each of several dates per loan.

    ``asked`` has one row per loan, ``dates`` names its date columns. A loan has a state on every date from its
    due date on, so the state is that of the date itself; before, the struct is null. No panel is made.
    """
    rows = asked.select("loan_id", *dates.values()).join(loan_changes(wh), "loan_id")
    states = {
        suffix: F.max(F.when(holds_on(at), F.struct(
            F.col(at).alias("snapshot_date"), dpd_on(at).alias("dpd"), F.col("outstanding_amount").alias("outstanding_amount"),
            status_of(dpd_on(at)).alias("loan_status"),
        ))).alias(suffix)
        for suffix, at in dates.items()
    }
    return rows.groupBy("loan_id").agg(*states.values())


def _cases(wh) -> DataFrame:
    return wh["dim_case"].select(
        "case_id", F.col("customer_id").alias("case_customer_id"), "current_vendor_id", "current_line_id",
        "collector_id", F.to_date("case_create_time").alias("case_create_date"),
    )


def active_case_loans(wh, loans: DataFrame) -> DataFrame:
    """Loan states attached to cases that exist on that date; the customer is the case's."""
    return (
        loans.join(wh["dim_case_loan_mapping"].select("loan_id", "case_id"), "loan_id")
        .join(_cases(wh), "case_id")
        .filter(F.col("case_create_date") <= F.col("stat_date"))
    )


def active_case_changes(wh) -> DataFrame:
    """Loan changes attached to cases, each from ``_from`` to ``_to``, the dates of the panel on which both hold.

    Rows are few next to their days, so they are joined and dealt by customer before days are made of them: all days of a
    case or customer are then made in one task, and roll-ups of them need no shuffle.
    """
    start, end = panel(wh)
    changes = loan_changes(wh).select(
        "loan_id", "due_date", "cumulative_repaid", "outstanding_amount", F.greatest("valid_from", start).alias("_from"),
        F.least(F.coalesce(F.date_sub("valid_to", 1), end), end).alias("_to"),
    ).filter(F.col("_from") <= F.col("_to"))
    attached = wh["dim_case_loan_mapping"].select("loan_id", "case_id").join(_cases(wh), "case_id")
    rows = changes.join(attached, "loan_id").filter(F.col("case_create_date") <= F.col("_to"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_from", F.greatest("_from", "case_create_date")).repartition(tasks, "case_customer_id")


def on_days(rows: DataFrame) -> DataFrame:
    """One row for each date from ``_from`` to ``_to``."""
    return rows.withColumn("stat_date", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def case_daily_state(wh, loans: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Roll-up of loan states per (date, case); a case cured for over 30 days of age is closed.

    Of the states in ``loans``, or else of the changes attached to cases.
    """
    if loans is not None:
        rows = active_case_loans(wh, loans)
    else:
        rows = on_days(active_case_changes(wh) if changes is None else changes).withColumn("dpd", dpd_on("stat_date"))
    rolled = (
        rows.groupBy(
            "stat_date", "case_id", F.col("case_customer_id").alias("customer_id"),
            F.col("current_vendor_id").alias("vendor_id"), F.col("current_line_id").alias("line_id"), "collector_id",
            "case_create_date",
        )
        .agg(
            F.round(F.sum("outstanding_amount"), 2).alias("outstanding_amount"),
            F.max("dpd").alias("_dpd"),
            F.sum("cumulative_repaid").alias("_repaid"),
        )
        .withColumn("case_dpd", F.when(F.col("outstanding_amount") <= 0, F.lit(0)).otherwise(F.col("_dpd")))
    )
    old = F.datediff("stat_date", "case_create_date") > 30
    status = (
        F.when((F.col("outstanding_amount") <= 0) & old, "closed").when(F.col("outstanding_amount") <= 0, "cured")
        .when(F.col("_repaid") > 0, "partially_paid").when(F.col("case_dpd") > 0, "in_collection").otherwise("assigned")
    )
    return rolled.select(
        "stat_date", "case_id", "customer_id", "vendor_id", "line_id", "collector_id", status.alias("case_status"),
        dpd_bucket("case_dpd").alias("dpd_bucket"), "outstanding_amount", "case_dpd",
    )


def customer_daily_state(wh) -> DataFrame:
    """Roll-up of case states per (date, customer), with the number of loans still owed."""
    changes = active_case_changes(wh)
    cases = case_daily_state(wh, changes=changes).groupBy("stat_date", "customer_id").agg(
        F.count_if(F.col("outstanding_amount") > 0).alias("active_case_count"),
        F.round(F.sum("outstanding_amount"), 2).alias("total_outstanding_amount"),
        F.max("case_dpd").alias("_dpd"),
    )
    # A loan has one change on a date; in several cases of a customer that change differs in its first date at most.
    owed = (
        on_days(
            changes.filter(F.col("outstanding_amount") > 0).groupBy("case_customer_id", "loan_id", "_to").agg(F.min("_from").alias("_from"))
        )
        .groupBy("stat_date", F.col("case_customer_id").alias("customer_id"))
        .agg(F.count("loan_id").alias("active_loan_count"))
    )
    dpd = F.when(F.col("total_outstanding_amount") <= 0, F.lit(0)).otherwise(F.col("_dpd"))
    risk = F.when((F.col("total_outstanding_amount") <= 0) | (dpd <= 30), "low").otherwise("medium")
    return cases.join(owed, ["stat_date", "customer_id"], "left").select(
        "stat_date", "customer_id", F.coalesce("active_loan_count", F.lit(0).cast("long")).alias("active_loan_count"),
        "active_case_count", "total_outstanding_amount", dpd.alias("max_dpd"), risk.alias("risk_level"),
    )
