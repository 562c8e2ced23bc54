"""Quality classifier as a sparse ensemble of rules.

Trees over the statistics of a text are cut into their paths, each a conjunction of thresholds. A lasso logistic
regression weighs the rules; those with a weight become Spark column expressions, so that scoring is a
projection over the statistics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import Workspace, table
from duewise.llm.registry import query
from duewise.llm.text_statistics import STATISTICS, with_statistics

#: Most labelled rows that are used to fit; those with the smallest hash of doc_id.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002

Condition = tuple[str, str, float]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tree_rules(description: str) -> list[tuple[Condition, ...]]:
    """The conditions on the way to each node of the trees of a debug string, without repeats."""
    out: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(found[2])], found[3], float(found[4]))))
        out[_simplified([c for _, c in path])] = None
    return list(out)


def _simplified(conditions: list[Condition]) -> tuple[Condition, ...]:
    """The tightest bound of each statistic and side, in a fixed order."""
    tight: dict[tuple[str, str], float] = {}
    for name, side, bound in conditions:
        best = tight.get((name, side))
        tight[name, side] = bound if best is None else (min if side == "<=" else max)(best, bound)
    return tuple((name, side, bound) for (name, side), bound in sorted(tight.items()))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    """The conjunction as a column expression."""
    out = F.lit(True)
    for name, side, bound in rule:
        out = out & ((F.col(name) <= bound) if side == "<=" else (F.col(name) > bound))
    return out


@dataclass
class RuleModel:
    """A constant and weighted rules; the score is the logistic function of their sum."""

    constant: float = 0.0
    weights: dict[tuple[Condition, ...], float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(float(self.constant))
        for rule, weight in self.weights.items():
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(rows: DataFrame, label: str, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Fit on rows of the statistics and a 0/1 label.

    Without rows the score is one half; with one class it is that class's rate, kept off 0 and 1 by one row of each.
    """
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    n, ones = sum(counts.values()), counts.get(1, 0)
    if n == 0 or ones in (0, n):
        return RuleModel(math.log((ones + 1) / (n - ones + 1)))
    inputs = VectorAssembler(inputCols=list(STATISTICS), outputCol="statistics").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="statistics", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7,
        featureSubsetStrategy="onethird", minInstancesPerNode=5,
    ).fit(inputs)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(math.log(ones / (n - ones)))
    flags = rows.select(F.col(label).cast("double").alias("y"), *(rule_column(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    vectors = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(flags).select("y", "x")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(vectors)
    weights = {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w}
    return RuleModel(float(fitted.intercept), weights)


def train_rows(statistics: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Labelled rows outside the held-out third, at most ``max_rows``: those of the smallest hashes of doc_id.

    Labels that are null or not 0/1 do not count; a doc_id with several labels gives several rows.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "label").limit(max_rows)
    return statistics.join(chosen, "doc_id").select("label", *STATISTICS)


def score_quality(docs: DataFrame, labels: DataFrame, ws: Workspace, max_rows: int = MAX_ROWS) -> tuple[DataFrame, RuleModel]:
    """doc_id, held_out and score of each row of ``docs``, and the model fitted on ``labels`` (doc_id, quality)."""
    statistics = ws.stage(with_statistics(docs.select("doc_id", "text")), "statistics")
    sample = ws.stage(train_rows(statistics, labels, "quality", max_rows).coalesce(8), "sample")
    model = fit_rules(sample, "label")
    return statistics.select("doc_id", held_out().alias("held_out"), model.score().alias("score")), model


@query("op8_quality_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, score of quality 1, predicted (score of one half or more)."""
    scored, _ = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "quality-model"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
