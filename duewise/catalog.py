"""The named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.functions.rates import steady_round
from duewise.oracle import sql as osql
from duewise.plans.strategy import StrategyLab
from duewise.plans.warehouse import SHARED_TABLES, Warehouse
from duewise.sources.domain import StarSchemaDomain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def open_warehouse(spark: SparkSession, sf_dir: str, shared: Sequence[str] = ()) -> Warehouse:
    return Warehouse(StarSchemaDomain(spark, sf_dir), shared=shared)


def stable(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns so that the order of floating sums cannot show."""
    return df.select(*(steady_round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def add(
    name: str,
    build: Callable[[Warehouse], DataFrame],
    oracle: str | None,
    *,
    shared: Sequence[str] = (),
    **digits: int,
) -> None:
    """Register a query over the warehouse and its SQL; ``digits`` are applied on both sides.

    ``shared`` names the tables that several branches of the query read.
    """
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stable(build(open_warehouse(spark, sf_dir, shared)), **digits)

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = osql.rounded(oracle, **digits) if digits else osql.query(oracle)


_ANALYSES: dict[tuple, StrategyLab] = {}


def _state_of(spark: SparkSession, folder: str) -> tuple:
    """What identifies the content of a folder: newest top-level change, bytes and number of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(path)
    newest = max((s.getModificationTime() for s in fs.listStatus(path)), default=0)
    return newest, summary.getLength(), summary.getFileCount()


def analysis(wh: Warehouse) -> StrategyLab:
    """The findings-and-drivers run of a folder, shared by all reports of a session.

    Detection and attribution are stages whose results the report datasets read; they run once per session
    and folder, and again when the folder's content changes.
    """
    spark, root = wh.spark, wh.source.root
    key = (spark.sparkContext.applicationId, root, _state_of(spark, root))
    if key not in _ANALYSES:
        _ANALYSES[key] = StrategyLab(open_warehouse(spark, root, SHARED_TABLES))
    return _ANALYSES[key]


def forget_analyses() -> None:
    _ANALYSES.clear()


def load() -> None:
    """Import every area once."""
    if QUERIES:
        return
    from duewise import areas

    areas.register_all()
