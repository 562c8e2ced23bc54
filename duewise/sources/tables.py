"""Readers and writers for layered table folders and result files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("dim", "ods", "dwd", "dws", "ads")
DATE_COLUMNS = ("stat_date", "case_create_time", "due_date", "repay_date", "action_date", "score_date")  # fixed values


def layer_of(table: str) -> str:
    return table.split("_", 1)[0]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class TableMissing(LookupError):
    """A table is in neither supported format."""


class LayeredFolder:
    """``<root>/<layer>/<table>.parquet`` with ``.csv`` as the second choice."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType] | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = schemas or {}
        self.notes: list[str] = []

    def table(self, name: str) -> DataFrame:
        base = f"{self.root}/{layer_of(name)}/{name}"
        schema = self.schemas.get(name)
        for suffix in ("parquet", "csv"):
            path = f"{base}.{suffix}"
            if not path_exists(self.spark, path):
                continue
            reader = self.spark.read
            if schema is not None:
                reader = reader.schema(schema)
            if suffix == "parquet":
                return reader.parquet(path)
            reader = reader.option("header", True)
            return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
        raise TableMissing(f"missing table: {layer_of(name)}/{name}")

    def has(self, name: str) -> bool:
        try:
            self.table(name)
        except TableMissing:
            return False
        return True

    def optional(self, name: str, schema: T.StructType) -> DataFrame:
        """The table, or an empty relation of ``schema`` and a note that dependent columns are degraded."""
        try:
            return self.table(name)
        except TableMissing:
            self.notes.append(f"missing {layer_of(name)}/{name}: dependent columns are degraded")
            return self.spark.createDataFrame([], schema)


class FrameSet:
    """Tables given as DataFrames, e.g. fixtures."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]) -> None:
        self.spark = spark
        self.frames = frames
        self.notes: list[str] = []

    def has(self, name: str) -> bool:
        return name in self.frames

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise TableMissing(f"missing table: {layer_of(name)}/{name}")
        return self.frames[name]


def write_table(
    df: DataFrame, root: str, table: str, fmt: str = "parquet", partition_by: Iterable[str] | None = None
) -> str:
    """Write one table of a layer. Daily tables are partitioned by date on request.

    Dates are clustered before a partitioned write so that each task writes few partitions, without
    gathering a whole date in one task: AQE splits a large date over several writers.
    """
    path = f"{root.rstrip('/')}/{layer_of(table)}/{table}.{fmt}"
    keys = list(partition_by or ())
    frame = df.hint("rebalance", *keys) if keys else df
    writer = frame.write.mode("overwrite")
    if keys:
        writer = writer.partitionBy(*keys)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_results_json(df: DataFrame, path: str) -> str:
    """One JSON object per result row; nested evidence stays nested."""
    df.write.mode("overwrite").json(path)
    return path


def write_results_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_results_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read result rows; a line that is not an object of this shape is an error, not a null row."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def date_column_of(df: DataFrame) -> str | None:
    """The first known date column of a table."""
    return next((c for c in DATE_COLUMNS if c in df.columns), None)


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, columns and date range of each table, one small aggregate per table."""
    out: DataFrame | None = None
    for name, df in sorted(tables.items()):
        date = date_column_of(df)

        def bound(agg) -> Column:
            return F.lit(None).cast("date") if date is None else agg(F.col(date).try_cast("date"))

        row = df.agg(
            F.count(F.lit(1)).alias("row_count"), bound(F.min).alias("date_start"), bound(F.max).alias("date_end")
        ).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(", ".join(df.columns)).alias("columns"),
            F.lit(date).cast("string").alias("date_column"),
            "date_start",
            "date_end",
        )
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out
