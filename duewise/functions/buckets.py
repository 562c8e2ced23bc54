"""Right-closed bins and value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duewise.functions.rates import col


def bin_right_closed(value: Column | str, edges: list[tuple[float, str]], last: str) -> Column:
    """Label of the first edge with ``value <= edge``; above all edges the last label."""
    c = col(value)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(c <= edge, F.lit(label))
    return out.otherwise(F.lit(last))


def dpd_bucket(dpd: Column | str) -> Column:
    return bin_right_closed(dpd, [(0, "CURRENT"), (30, "M1"), (60, "M2")], "M3+")


def score_bucket(score: Column | str, edges: list[tuple[float, str]], last: str) -> Column:
    return bin_right_closed(score, edges, last)


def mapped(value: Column | str, pairs: dict[str, str], default: Column | str | None = None) -> Column:
    """Replace a value by its entry, or by the default (the value itself when none is given)."""
    c = col(value)
    fallback = c if default is None else (F.lit(default) if isinstance(default, str) else default)
    out = None
    for key, label in pairs.items():
        out = F.when(c == key, F.lit(label)) if out is None else out.when(c == key, F.lit(label))
    return fallback if out is None else out.otherwise(fallback)


CHANNEL_ALIASES = {"ai_outbound": "ai_call", "call": "manual"}  # fixed values


def channel_name(value: Column | str) -> Column:
    """Contact channel of an action type: trimmed, lower case, aliases resolved."""
    return mapped(F.lower(F.trim(col(value))), CHANNEL_ALIASES)
