"""Named queries of the subpackage and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Operator modules, by number.
MODULES = ("token_files", "byte_bpe", "decontamination", "personal_data", "quality_rules", "quality_model", "toxicity", "substring_dedup", "ngram_join", "line_dedup", "language_model", "hard_negatives", "phrases")


def query(name: str, oracle: str | None = None):
    """Register a function of (session, folder of the tables) under ``name``."""

    def keep(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return keep


def load() -> None:
    """Import every operator module once, and the pipeline at the repository top."""
    for module in MODULES:
        importlib.import_module(f"duewise.llm.{module}")
    if "pipeline" not in QUERIES:
        pipeline = importlib.import_module("corpus_pipeline")
        QUERIES["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL is not None:
            ORACLES["pipeline"] = pipeline.ORACLE_SQL
