"""Toxicity classifier by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings learns from confirmed toxic texts and from unlabelled ones.
The risk of the negatives is what the unlabelled texts show less the share of positives among them, and is kept
from turning negative; where it does, the step is taken against it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import map_rows, schema_with, table, texts_of
from duewise.llm.hashing import word_hashes
from duewise.llm.quality_model import held_out
from duewise.llm.registry import query

BITS = 18
#: Word beginnings of these lengths, in bytes, are features beside whole words.
STEMS = (4, 5, 6)
#: Most positive and most unlabelled texts that are used to fit; those with the smallest hash of doc_id.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 18_000
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.2, 1e-3
#: A feature gets a weight if it is in at least 3 % of the positive texts, and in three of them, and is so many
#: times as frequent there as in unlabelled texts. Words of ordinary prose stay out.
MIN_ROWS, MIN_SHARE, LIFT = 3, 0.03, 4
#: Every fourth row is kept back to set the scale and the offset of the scores.
KEPT_BACK = 4
#: The score that is to part the classes.
CUT = 0.7

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Numbers of the features that the text has, ascending and once each; empty for a text without words."""
    words = list(set(text.translate(_LETTERS).split()))
    if not words:
        return np.zeros(0, np.int32)
    hashes = [word_hashes(b" ".join(words))]
    for size in STEMS:
        long = [w[:size] for w in words if len(w) >= size]
        if long:
            # A beginning of a word is not the word of these letters.
            hashes.append(word_hashes(b" ".join(set(long))) ^ np.uint64(size))
    return np.unique((np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, the columns of ``keep`` and the features of each whole text as the bytes of 32-bit integers."""
    kept = docs.select("doc_id", *keep)

    def run(batch: pa.RecordBatch) -> dict:
        found = [features(t).tobytes() for t in texts_of(batch)]
        return {c: batch.column(c) for c in ("doc_id", *keep)} | {"features": pa.array(found, pa.binary())}

    return map_rows(docs.select("doc_id", *keep, "text"), run, schema_with(kept, features=T.BinaryType()))


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float

    def logit(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each row, whose features are ``flat[ends[i] : ends[i + 1]]``."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        return total[ends[1:]] - total[ends[:-1]] + self.bias


def _rows(flat: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends)[chosen]
    first = np.cumsum(sizes) - sizes
    places = np.repeat(ends[:-1][chosen] - first, sizes) + np.arange(sizes.sum())
    return flat[places], np.append(0, np.cumsum(sizes))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 11) -> LinearModel:
    """Minimise the non-negative PU risk of the logistic loss by AdaGrad.

    ``prior`` is the share of positives among the unlabelled. With l(z) = log(1 + e**-z), the risk is
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]).
    Scale and offset are set on rows kept back. Without positives or unlabelled rows the model is constant.
    """
    if not positive or not unlabelled:
        return LinearModel(np.zeros(1 << BITS), 6.0 if positive else -6.0)
    fitting = [[r for k, r in enumerate(rows) if k % KEPT_BACK or len(rows) < 2 * KEPT_BACK] for rows in (positive, unlabelled)]
    setting = [rows[::KEPT_BACK] for rows in (positive, unlabelled)]
    model = _descend(*(_flat(rows) for rows in fitting), prior, np.random.default_rng(seed))
    return _calibrated(model, *(model.logit(*_flat(rows)) for rows in setting), prior)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows).astype(np.int64), np.append(0, np.cumsum([len(r) for r in rows]))


def _calibrated(model: LinearModel, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> LinearModel:
    """The model with its logits scaled and moved so that a score of ``CUT`` parts the classes.

    A cut's non-negative PU risk is prior * misses + max(0, unlabelled above - prior * hits). Of the widest range of
    cuts whose risk is within half a per cent of the prior from the least, the middle is taken; the typical
    positive gets a score of 0.99.
    """
    values = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    hits = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = prior * (1 - hits) + np.maximum(0, above - prior * hits)
    good = risk <= risk.min() + 0.005 * prior
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(int)))
    spans = [(cuts[i], cuts[j - 1]) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    low, high = max(spans, key=lambda x: x[1] - x[0])
    cut = (low + high) / 2
    target = math.log(CUT / (1 - CUT))
    typical = np.median(positive[positive > cut]) if (positive > cut).any() else cut + 1.0
    scale = (math.log(99) - target) / max(typical - cut, 1e-6)
    return LinearModel(model.weights * scale, float((model.bias - cut) * scale + target))


def _descend(positive, unlabelled, prior: float, rng: np.random.Generator) -> LinearModel:
    dim, data = 1 << BITS, (positive, unlabelled)
    n_p, n_u = (len(ends) - 1 for _, ends in data)
    held = [np.bincount(flat, minlength=dim) for flat, _ in data]
    enough = min(max(MIN_ROWS, MIN_SHARE * n_p), n_p)
    common = (held[0] >= enough) & (held[0] * n_u >= LIFT * held[1] * n_p)
    weights, bias = np.zeros(dim), -1.0
    seen, seen_bias = np.full(dim, 1e-8), 1e-8
    steps = max(1, -(-n_u // BATCH))
    share = max(1, -(-n_p // steps))
    for _ in range(EPOCHS):
        orders = [rng.permutation(n) for n in (n_p, n_u)]
        for k in range(steps):
            p = orders[0][np.arange(k * share, (k + 1) * share) % n_p]
            u = orders[1][k * BATCH : (k + 1) * BATCH]
            if not len(u):
                continue
            (fp, ep), (fu, eu) = _rows(*data[0], p), _rows(*data[1], u)
            now = LinearModel(weights, bias)
            zp, zu = now.logit(fp, ep), now.logit(fu, eu)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = np.full(len(p), -prior / len(p)), su / len(u)
            else:
                # The negatives' risk fell below nothing: step back along it alone.
                gp, gu = prior * sp / len(p), -su / len(u)
            step = np.zeros(dim)
            for g, f, e in ((gp, fp, ep), (gu, fu, eu)):
                step += np.bincount(f, np.repeat(g, np.diff(e)), minlength=dim)
            touched = np.flatnonzero((step != 0) & common)
            move = step[touched] + DECAY * weights[touched] / steps
            seen[touched] += move * move
            weights[touched] -= RATE * move / np.sqrt(seen[touched])
            slope = gp.sum() + gu.sum()
            seen_bias += slope * slope
            bias -= RATE * slope / np.sqrt(seen_bias)
    return LinearModel(weights, bias)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED
) -> LinearModel:
    """Fit on the texts of ``docs`` by the labels (doc_id, toxic) outside the held-out third.

    Positives are rows labelled toxic; unlabelled are rows of ``docs`` without any label. The prior is the toxic
    share of the labelled rows there. At most ``max_positive`` and ``max_unlabelled`` texts are used, those of the
    smallest hashes of doc_id; without labels every text scores near 0.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = known.where(~held_out())
    n, ones = usable.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    toxic = usable.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    rest = (
        docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).join(labels.select("doc_id"), "doc_id", "left_anti")
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled)
    )
    wanted = toxic.withColumn("positive", F.lit(True)).unionByName(rest.withColumn("positive", F.lit(False)))
    sample = with_features(docs.join(wanted, "doc_id").select("doc_id", "text", "positive"), ["positive"])
    # Some kilobytes a row as plain bytes: the bounded sample stays small on the driver.
    rows = [(r.doc_id, bytes(r.features), r.positive) for r in sample.toLocalIterator()]
    rows.sort()
    split = [[np.frombuffer(f, np.int32) for _, f, positive in rows if positive is kind] for kind in (True, False)]
    return fit_nnpu(*split, (ones or 0) / n if n else 0.0)


def score_toxicity(docs: DataFrame, model: LinearModel) -> DataFrame:
    """doc_id and score of each whole text; null counts as empty, and an empty text has the score of no feature."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batch: pa.RecordBatch) -> dict:
        weights, bias = shared.value
        z = np.array([float(weights[features(t)].sum()) for t in texts_of(batch)]) + bias
        return {"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, score, predicted (score of 0.7 or more)."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
