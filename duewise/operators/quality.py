"""Checks that return rows, so that a failed check shows what failed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.operators.ordering import last_observations
from duewise.schemas import personal_fields

AMOUNT_ENDINGS = ("_fee", "_principal", "_interest")  # fixed values
RATE_WORDS = ("rate", "share", "pct")  # fixed values


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: how many rows repeat an earlier key (pre-aggregated per key)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicate_count")
    ).select(F.lit(name).alias("table_name"), "duplicate_count")


def missing_parents(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, label: str) -> DataFrame:
    """One row: number of distinct child keys without a parent. Keys are made distinct before the anti-join."""
    keys = child.select(F.col(child_key).alias("k")).distinct()
    lost = keys.join(parent.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("missing_count")).select(F.lit(label).alias("check_name"), "missing_count")


def count_columns(df: DataFrame, columns: Sequence[str], bad, table: str) -> DataFrame:
    """(table, column, bad_count) for a per-value predicate, from one pass over the table."""
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, bad_count long")
    counted = df.agg(F.array(*(
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.count_if(bad(F.col(c).cast("double"))).alias("bad_count"))
        for c in columns
    )).alias("rows"))
    return counted.select(F.inline("rows"))


def numeric_columns(df: DataFrame, wanted) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and wanted(f.name)]


def negative_amounts(df: DataFrame, table: str) -> DataFrame:
    names = numeric_columns(df, lambda c: "amount" in c or c.endswith(AMOUNT_ENDINGS))
    return count_columns(df, names, lambda v: F.coalesce(v, F.lit(0.0)) < 0, table)


def rates_out_of_range(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    names = numeric_columns(df, lambda c: any(w in c for w in RATE_WORDS)) if columns is None else list(columns)
    return count_columns(df, names, lambda v: (v < 0) | (v > 1), table)


def all_null(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """(table, column, empty): columns without a single value."""
    seen = df.agg(F.array(*(
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), (F.count(c) == 0).alias("empty")) for c in columns
    )).alias("rows"))
    return seen.select(F.inline("rows"))


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def leaked_personal_fields(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Clear personal columns per table; a schema check, no data is read."""
    return {name: found for name, df in tables.items() if (found := personal_fields(df))}


def empty_days(df: DataFrame, table: str, date: str = "stat_date") -> DataFrame:
    """Days between the first and the last date of a table that have no row."""
    days = df.select(F.col(date).alias("day")).dropna().distinct()
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left_anti").select(F.lit(table).alias("table_name"), "day")


def tail_means(df: DataFrame, value: str, name: str, recent: int = 30, span: int = 60, date: str = "stat_date") -> DataFrame:
    """One row: mean of the last 30 observations against the 30 before them, counted in observations."""
    tail = last_observations(df.select(date, F.col(value).cast("double").alias("_v")), date, span)
    means = tail.agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.when(F.col("age") > recent, F.col("_v"))).alias("prior_mean"),
        F.avg(F.when(F.col("age") <= recent, F.col("_v"))).alias("recent_mean"),
    )
    return means.select(
        F.lit(name).alias("series"), "observations", "prior_mean", "recent_mean", (F.col("recent_mean") < F.col("prior_mean")).alias("falling")
    )


def rises(df: DataFrame, keys: Sequence[str], value: str, date: str = "stat_date") -> DataFrame:
    """One row: how often ``value`` is above the day before, per key."""
    previous = F.lag(value).over(W.partitionBy(*keys).orderBy(date))
    return df.select((F.col(value) > previous).alias("up")).agg(F.count_if("up").alias("bad_count"))


def group_means_ordered(df: DataFrame, group: str, value: str, order: Sequence[str], ascending: bool = True) -> DataFrame:
    """Mean per group in the given order, and whether each is beyond the one before it."""
    place = F.array_position(F.array(*(F.lit(g) for g in order)), F.col(group))
    means = df.filter(place > 0).groupBy(group).agg(F.avg(value).alias("mean_value")).withColumn("group_order", place)
    before = F.lag("mean_value").over(W.orderBy("group_order"))  # as many rows as groups named
    ahead = F.col("mean_value") > before if ascending else F.col("mean_value") < before
    return means.select(group, F.col("group_order").cast("int").alias("group_order"), "mean_value", F.coalesce(ahead, F.lit(True)).alias("in_order"))
