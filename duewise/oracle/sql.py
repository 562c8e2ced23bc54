"""Assemble a query with the common table expressions it needs, in dependency order."""

from __future__ import annotations

import re

from duewise.oracle.domain_sql import DOMAIN

CTES: dict[str, str] = dict(DOMAIN)
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def needed(sql: str, have: list[str]) -> None:
    for word in dict.fromkeys(_WORD.findall(sql)):
        if word in CTES and word not in have:
            needed(CTES[word], have)
            if word not in have:
                have.append(word)


def query(sql: str) -> str:
    """``WITH`` the needed expressions, then ``sql``."""
    names: list[str] = []
    needed(sql, names)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql


def rounded(sql: str, **digits: int) -> str:
    """Round result columns with exact halves going up; adding 0.0 turns a negative zero into zero."""
    items = ", ".join(f"round({c} + 1e-{d + 4}, {d}) + 0.0::DOUBLE AS {c}" for c, d in digits.items())
    return query(f"SELECT * REPLACE ({items}) FROM ({sql}) result_rows")


def rate(num: str, den: str) -> str:
    """Clipped, rounded rate that is 0 for a denominator that is not positive."""
    return (
        f"CASE WHEN coalesce({den}, 0) > 0 THEN round(least(greatest(coalesce({num}, 0)::DOUBLE / ({den})::DOUBLE, 0.0), 1.0) + 1e-10, 6)"
        " ELSE 0.0 END::DOUBLE"
    )


def ratio(num: str, den: str, digits: int | None = None) -> str:
    """Unclipped rate that is 0 for a denominator that is not positive."""
    value = f"coalesce({num}, 0)::DOUBLE / ({den})::DOUBLE"
    value = f"round({value} + 1e-{digits + 4}, {digits})" if digits is not None else value
    return f"CASE WHEN coalesce({den}, 0) > 0 THEN {value} ELSE 0.0 END::DOUBLE"
