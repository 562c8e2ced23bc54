"""A table source seen from a day on."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The day that decides in which daily window a source row counts. Repayments are not listed: a plan of the window
#: may have been paid before it.
DAY_COLUMNS = {
    "ods_repayment_plan": "due_date", "ods_collection_action": "action_time", "ods_complaint": "complaint_time",
    "ods_reduction_application": "apply_time", "ods_case_daily_snapshot": "stat_date", "ods_customer_daily_snapshot": "stat_date",
    "dwd_due_plan_detail_di": "stat_date", "dwd_collection_action_detail_di": "action_date", "dwd_complaint_detail_di": "complaint_date",
    "dws_loan_status_snapshot_di": "stat_date", "dws_case_status_snapshot_di": "stat_date", "dws_customer_status_snapshot_di": "stat_date",
    "dws_collection_process_wide_di": "stat_date", "dws_vendor_line_capacity_di": "stat_date", "ads_postloan_dashboard_di": "stat_date",
    "ads_vendor_performance_di": "stat_date", "ads_reduction_roi_di": "stat_date",
}


class DatedSource:
    """``source`` whose dated tables start at ``first``, as a literal predicate that reaches the scans.

    Columns that hold dates as text are left whole: the predicate must not decide how such text is read.
    """

    def __init__(self, source, first: datetime.date) -> None:
        self.whole, self.first = source, first

    def __getattr__(self, name: str):
        return getattr(self.whole, name)

    def table(self, name: str) -> DataFrame:
        df = self.whole.table(name)
        day = DAY_COLUMNS.get(name)
        if day in df.columns and isinstance(df.schema[day].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return df.filter(F.col(day) >= F.lit(self.first))
        return df
