"""The daily metrics, one query each."""

from __future__ import annotations

from duewise.catalog import add
from duewise.oracle.warehouse_sql import METRIC_SOURCE
from duewise.plans import metrics


def register() -> None:
    for code, source in METRIC_SOURCE.items():
        digits = {code: 4} if code == "due_total_amount" else {}
        add(f"metric_{code}", lambda wh, code=code: metrics.metric(wh, code), f"SELECT stat_date, {code} FROM {source}", **digits)
