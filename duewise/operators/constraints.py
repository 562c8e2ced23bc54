"""Declared constraints, compiled to one aggregate per table and one for all references.

Every result row names a constraint and counts the rows (or keys) that break it, so that a suite is a table which
can be kept, compared and alerted on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.operators.quality import AMOUNT_ENDINGS, RATE_WORDS, stack
from duewise.schemas import personal_fields


@dataclass(frozen=True)
class TableRules:
    """What holds for a table: its key, and columns with values of at least zero, or within zero and one."""

    table: str
    key: Sequence[str] = ()
    non_negative: Sequence[str] = ()
    unit_range: Sequence[str] = ()
    required: Sequence[str] = ()
    no_personal: bool = False


def _measures(df: DataFrame, wanted: Callable[[str], bool]) -> list[str]:
    """Numeric columns, and text columns that may hold numbers, of wanted names."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType)) and wanted(f.name)]


def rules_by_name(df: DataFrame, table: str, key: Sequence[str] = (), *, rates: bool, no_personal: bool, required: Sequence[str] = ()) -> TableRules:
    """Rules that follow from the column names: amounts, fees, principal and interest; rates, shares and percentages."""
    return TableRules(
        table, tuple(key), _measures(df, lambda c: "amount" in c or c.endswith(AMOUNT_ENDINGS)),
        _measures(df, lambda c: any(w in c for w in RATE_WORDS)) if rates else (), tuple(required), no_personal,
    )


def evaluate(df: DataFrame, rules: TableRules) -> DataFrame:
    """table_name, constraint_name, column_name, row_count, bad_count of each rule, from one pass over ``df``.

    Rows combine per key before their shuffle, so a repeated key is one row however often it occurs; a table without a
    key is a plain aggregate. Null keys count as equal. Text that is no number breaks no rule about values; a column
    that is not there breaks ``column_present`` alone, an empty table none.
    """
    have = set(df.columns)
    value = {c: F.col(c).try_cast("double") for c in {*rules.non_negative, *rules.unit_range} & have}
    bad: list[tuple[str, str, Column]] = [("non_negative", c, value[c] < 0) for c in rules.non_negative if c in have]
    bad += [("unit_range", c, (value[c] < 0) | (value[c] > 1)) for c in rules.unit_range if c in have]
    keys = [c for c in rules.key if c in have]
    if keys:
        absent = F.lit(False)
        for c in keys:
            absent = absent | F.col(c).isNull()
        bad.append(("key_present", ",".join(keys), absent))
    counts = [F.count_if(condition).alias(f"_bad{i}") for i, (_, _, condition) in enumerate(bad)]
    narrow = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *counts)

    def sum_of(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    found = [(name, column, sum_of(F.col(f"_bad{i}"))) for i, (name, column, _) in enumerate(bad)]
    if keys:
        found.append(("unique_key", ",".join(keys), sum_of(F.col("_rows") - 1)))
    found += [("column_present", c, F.lit(int(c not in have)).cast("long")) for c in (*rules.required, *(k for k in rules.key if k not in have))]
    if rules.no_personal:
        leaked = personal_fields(df)
        found.append(("no_personal_field", ",".join(leaked), F.lit(len(leaked)).cast("long")))
    whole = narrow.agg(sum_of(F.col("_rows")).alias("row_count"), *(c.alias(f"_found{i}") for i, (_, _, c) in enumerate(found)))
    rows = [
        F.struct(F.lit(name).alias("constraint_name"), F.lit(column).alias("column_name"), F.col(f"_found{i}").alias("bad_count"))
        for i, (name, column, _) in enumerate(found)
    ]
    if not rows:
        rows = [F.struct(F.lit("none").alias("constraint_name"), F.lit("").alias("column_name"), F.lit(0).cast("long").alias("bad_count"))]
    return whole.select(F.lit(rules.table).alias("table_name"), "row_count", F.inline(F.array(*rows))).select(
        "table_name", "constraint_name", "column_name", "row_count", "bad_count"
    )


@dataclass(frozen=True)
class Reference:
    """A column whose values are keys of another table."""

    child: str
    column: str
    parent: str
    parent_column: str

    @property
    def label(self) -> str:
        return f"{self.child}.{self.column}"


def _uses(df: DataFrame, columns: list[tuple[int, str, bool]]) -> DataFrame:
    """check, key, n, met of each (check, column, whether as parent): a table is read once for all its columns."""
    return df.select(F.inline(F.array(*(
        F.struct(
            F.lit(check).alias("check"), F.col(column).cast("string").alias("key"), F.lit(int(not parent)).cast("long").alias("n"),
            (F.lit(parent) & F.col(column).isNotNull()).alias("met"),
        )
        for check, column, parent in columns
    ))))


def unmet_references(tables: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """check_name, checked, missing_count, orphan_rows of each reference.

    Uses of a key as child and as parent meet in one aggregate by (reference, key), which combines before its shuffle, so a
    key with a third of all rows is one row and nothing is joined. A null key is missing. A reference of which a table is absent gives a row
    with ``checked`` false and null counts.
    """
    session = next(iter(tables.values())).sparkSession
    present = [r for r in references if r.child in tables and r.parent in tables]
    names = session.createDataFrame([(i, r.label, r in present) for i, r in enumerate(references)], "check int, check_name string, checked boolean")
    if not present:
        return names.select("check_name", "checked", F.lit(None).cast("long").alias("missing_count"), F.lit(None).cast("long").alias("orphan_rows"))
    by_table: dict[str, list[tuple[int, str, bool]]] = {}
    for i, r in enumerate(references):
        if r in present:
            by_table.setdefault(r.child, []).append((i, r.column, False))
            by_table.setdefault(r.parent, []).append((i, r.parent_column, True))
    uses = stack([_uses(tables[t], columns) for t, columns in by_table.items()])
    keys = uses.groupBy("check", "key").agg(F.sum("n").alias("n"), F.max("met").alias("met"))
    lost = keys.filter((F.col("n") > 0) & ~F.col("met")).groupBy("check").agg(
        F.count(F.lit(1)).alias("missing_count"), F.sum("n").alias("orphan_rows")
    )
    # As many rows as references.
    return names.join(F.broadcast(lost), "check", "left").select(
        "check_name", "checked", *(F.when(F.col("checked"), F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("missing_count", "orphan_rows"))
    )
