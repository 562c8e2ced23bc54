"""Types, privacy levels and keys of the warehouse columns.

Column types follow from the name, so one rule set covers every layer; ``schema_of`` turns a list of column
names into a ``StructType`` whose field metadata carries the privacy level and key flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns in clear personal form, which never reach detail or later layers.
CLEAR_PERSONAL = ("customer_name", "id_no", "mobile_no", "bank_card_no", "address")
MASKED_PERSONAL = ("mobile_masked", "id_no_masked")
HASHED_PERSONAL = ("customer_id_hash",)
NULLABLE = (  # fixed values
    "mapping_end_date", "effective_end_date", "template_id", "collector_id",
)
PRIMARY_KEYS = {  # fixed values
    "dim_customer": ["customer_id"], "dim_loan": ["loan_id"], "dim_case": ["case_id"], "dim_vendor": ["vendor_id"],
    "dim_collection_line": ["line_id"], "dim_collector": ["collector_id"], "dim_case_loan_mapping": ["case_id", "loan_id"],
    "ods_repayment_plan": ["plan_id"], "ods_collection_action": ["action_id"], "ods_complaint": ["complaint_id"],
    "ods_reduction_application": ["reduction_id"], "ods_postloan_c_score": ["score_id"],
    "ods_case_daily_snapshot": ["stat_date", "case_id"], "ods_customer_daily_snapshot": ["stat_date", "customer_id"],
    "dwd_due_plan_detail_di": ["stat_date", "plan_id"], "dwd_repayment_detail_di": ["repay_id"],
    "dwd_collection_action_detail_di": ["action_id"], "dwd_complaint_detail_di": ["complaint_id"],
    "dws_case_status_snapshot_di": ["stat_date", "case_id"],
    "dws_collection_process_wide_di": ["stat_date", "case_id", "vendor_id", "line_id", "collector_id"],
    "dws_vendor_line_capacity_di": ["stat_date", "vendor_id", "line_id"], "dws_customer_profile_di": ["customer_id"],
    "ads_postloan_dashboard_di": ["stat_date"], "ads_vendor_performance_di": ["stat_date", "vendor_id"],
    "ads_collector_performance_di": ["stat_date", "collector_id"],
}


def type_of(column: str) -> T.DataType:
    """DATE for dates, naive TIMESTAMP for times, BOOLEAN for flags, LONG for counts, DOUBLE for measures."""
    if column.endswith("_date") or column == "date":
        return T.DateType()
    if column.endswith("_time"):
        return T.TimestampNTZType()
    if column.endswith("_flag"):
        return T.BooleanType()
    if column.endswith("_count") or column in ("dpd", "max_dpd", "mob", "loan_term"):
        return T.LongType()
    measures = ("_amount", "_rate", "_pct", "_share", "_fee", "_principal", "_interest", "_hours", "_seconds", "_score", "_roi")
    if column.endswith(measures) or "amount" in column or "_per_" in column:
        return T.DoubleType()
    return T.StringType()


def privacy_of(column: str) -> str:
    if column in CLEAR_PERSONAL:
        return "P4"
    if column in MASKED_PERSONAL:
        return "P3"
    if column in HASHED_PERSONAL or column == "customer_id":
        return "P2"
    return "P1" if column.endswith("_id") else "P0"


def schema_of(table: str, columns: list[str]) -> T.StructType:
    keys = PRIMARY_KEYS.get(table, [])
    return T.StructType([
        T.StructField(c, type_of(c), c in NULLABLE or c not in keys, {"privacy": privacy_of(c), "primary_key": c in keys})
        for c in columns
    ])


def personal_fields(df: DataFrame) -> list[str]:
    """Clear personal columns of a frame, by field metadata where present, else by name."""
    return [f.name for f in df.schema.fields if (f.metadata or {}).get("privacy", privacy_of(f.name)) == "P4"]


def without_personal_fields(df: DataFrame) -> DataFrame:
    return df.drop(*personal_fields(df))
