"""Warehouse tables of every built layer."""

from __future__ import annotations

from duewise.catalog import add
from duewise.oracle import warehouse_sql  # noqa: F401  (defines the expressions)
from duewise.plans.warehouse import SHARED_TABLES

AMOUNT = 4

TABLES = {
    "dwd_due_plan_detail_di": {"due_amount": AMOUNT, "outstanding_amount": AMOUNT},
    "dwd_repayment_detail_di": {"repay_amount": AMOUNT},
    "dwd_collection_action_detail_di": {},
    "dwd_case_flow_detail_di": {},
    "dwd_complaint_detail_di": {},
    "dws_loan_status_snapshot_di": {"due_amount": AMOUNT, "repaid_amount_d7": AMOUNT},
    "dws_case_status_snapshot_di": {"outstanding_amount": AMOUNT, "repaid_amount": AMOUNT},
    "dws_customer_status_snapshot_di": {"total_outstanding_amount": AMOUNT},
    "dws_collection_process_wide_di": {},
    "dws_vendor_line_capacity_di": {},
    "dws_customer_profile_di": {"total_outstanding_amount": AMOUNT},
    "dws_collector_profile_di": {},
    "dws_customer_postloan_tag_di": {},
    "ads_postloan_dashboard_di": {"due_total_amount": AMOUNT},
    "ads_recovery_attribution_di": {},
    "ads_vendor_performance_di": {},
    "ads_collector_performance_di": {},
    "ads_reduction_roi_di": {"approved_reduction_amount": AMOUNT},
    "ads_compliance_qc_di": {},
}


def register() -> None:
    for name, digits in TABLES.items():
        shared = SHARED_TABLES if name.startswith("ads_") else ()
        add(f"table_{name}", lambda wh, name=name: wh[name], f"SELECT * FROM {name}", shared=shared, **digits)
