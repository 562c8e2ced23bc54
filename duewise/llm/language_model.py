"""A log-bilinear language model, learnt by noise-contrastive estimation over the whole corpus.

The next word's vector is predicted as the sum of the previous words' vectors, each scaled by the weights of its
position; the product with a word's own vector plus its bias is the word's score. Every partition descends on its
own training texts from the same start, and the models are averaged by tokens, in rounds of bounded fan-in.
Scoring normalises over the model's words with batched matrix products, one per distinct context.

Words outside the model share its ``rare`` outcome in proportion to their smoothed counts, one slot of which
belongs to words never seen; probabilities therefore sum to one over all known words and that slot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.chunks import Tally, by_bytes
from duewise.llm.common import Workspace, list_array, per_worker, table, texts_of
from duewise.llm.registry import query

#: Outcomes of the model: two fixed ones, the end of a text, and the most frequent words.
MODEL_WORDS = 1024
START, RARE, END = 0, 1, 2
#: Previous words that predict the next one, and the length of a word's vector.
CONTEXT, DIM = 2, 32
#: Noise words drawn for a minibatch, and how many of them count for each true word.
NOISE, NOISE_PER_WORD = 64, 16
#: Contexts whose scores of all words are held at a time.
BLOCK = 2048
MINIBATCH, RATE, START_SLOPE = 4096, 0.05, 1e-6
#: Words with at least this share of all tokens are looked up in the tasks: no more than 2^19 words, whose bytes are at
#: most 2^19 times the mean bytes of a token. All other words meet their counts in a join.
FREQUENT = 1 << 19
#: Models that one task averages.
FAN_IN = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END_WORD = b""


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 1. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.translate(_LOWER).split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each word occurs in the texts; the empty word counts their ends."""

    def rows(counts: dict) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in by_bytes(batch):
                counts = Counter()
                for text in texts_of(part):
                    counts.update(words_of(text))
                counts[_END_WORD] += part.num_rows
                if full := tally.add(counts):
                    yield rows(full)
        if left := tally.take():
            yield rows(left)

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts of the frequent words by falling count, and the totals that smooth all counts."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self):
        #: Model number of each frequent word; the end has its own, words beyond the model are rare.
        self.numbers = np.full(len(self.words) + 1, RARE, np.int32)
        inside = [k for k, w in enumerate(self.words) if w != _END_WORD][: MODEL_WORDS - 3]
        self.numbers[inside] = np.arange(3, 3 + len(inside))
        self.size = 3 + len(inside)
        ends = [k for k, w in enumerate(self.words) if w == _END_WORD]
        self.numbers[ends] = END
        end_count = int(self.counts[ends].sum())
        self.scale = self.tokens + 0.5 * (self.distinct + 1)
        weights = np.zeros(self.size)
        weights[END] = end_count + 0.5 if end_count else 0.0
        weights[3:] = self.counts[inside] + 0.5
        #: Smoothed count of all words that share the rare outcome, with the slot of unseen words.
        self.rare = max(self.scale - float(weights.sum()), 0.5)
        weights[RARE] = self.rare
        weights[END] = max(weights[END], 0.5)
        self.unigram = weights / weights.sum()

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def read_lexicon(counts: DataFrame) -> Lexicon:
    """Totals and the frequent words of a table of ``word, c``; only words of a bounded number reach the driver."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("c") * FREQUENT >= tokens) | (F.col("word") == ""))
    rows = sorted(((r.c, r.word.encode()) for r in top.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    return Lexicon([w for _, w in rows], np.array([c for c, _ in rows], np.int64), tokens, distinct)


class LogBilinear:
    """Vectors of words as contexts and as outcomes, weights of positions, biases; 32-bit floats."""

    NAMES = ("context", "outcome", "position", "bias")

    def __init__(self, values: dict[str, np.ndarray]):
        self.values = values

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 5) -> LogBilinear:
        """Small random vectors, and biases that alone give the unigram distribution."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.05).astype(np.float32)
        size = len(unigram)
        bias = np.log(np.maximum(unigram, 1e-30)).astype(np.float32)
        return cls({"context": small(size, DIM), "outcome": small(size, DIM), "position": np.ones((CONTEXT, DIM), np.float32), "bias": bias})

    def to_bytes(self) -> bytes:
        return b"".join(self.values[n].astype(np.float32).tobytes() for n in self.NAMES)

    @classmethod
    def from_bytes(cls, data: bytes, size: int) -> LogBilinear:
        shapes = {"context": (size, DIM), "outcome": (size, DIM), "position": (CONTEXT, DIM), "bias": (size,)}
        flat, at, values = np.frombuffer(data, np.float32), 0, {}
        for name in cls.NAMES:
            n = math.prod(shapes[name])
            values[name] = flat[at : at + n].reshape(shapes[name]).copy()
            at += n
        return cls(values)

    def predict(self, before: np.ndarray) -> np.ndarray:
        """The predicted vector of each row of previous words, nearest first."""
        v = self.values
        return sum(v["context"][before[:, k]] * v["position"][k] for k in range(CONTEXT))

    def log_probabilities(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's normalised probability after its previous words.

        Normalisers are made once per distinct context of all the words given, a block of contexts at a time.
        """
        v = self.values
        keys, inverse = np.unique(before @ (len(v["bias"]) ** np.arange(CONTEXT)), return_inverse=True)
        place = np.empty(len(keys), np.int64)
        place[inverse] = np.arange(len(inverse))
        predicted = self.predict(before[place])
        outcome, bias, norm = v["outcome"][1:].T.copy(), v["bias"][1:], np.empty(len(keys), np.float32)
        for a in range(0, len(keys), BLOCK):
            scores = predicted[a : a + BLOCK] @ outcome
            scores += bias
            top = scores.max(1)
            scores -= top[:, None]
            np.exp(scores, out=scores)
            norm[a : a + BLOCK] = top + np.log(scores.sum(1))
        own = np.empty(len(words), np.float32)
        for a in range(0, len(words), BLOCK):
            at, word = inverse[a : a + BLOCK], words[a : a + BLOCK]
            own[a : a + BLOCK] = np.einsum("ij,ij->i", predicted[at], v["outcome"][word]) + v["bias"][word]
        return (own - norm[inverse]).astype(np.float64)


def _sum_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``index`` and the sum of the rows of each."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    at = index[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class NoiseContrastive:
    """Steps of AdaGrad on the noise-contrastive loss; all words of a minibatch share their noise words."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.v, self.rng = model.values, np.random.default_rng(seed)
        self.noise = unigram
        self.offset = np.log(NOISE_PER_WORD * np.maximum(unigram, 1e-30)).astype(np.float32)
        self.seen = {n: np.full(x.shape, START_SLOPE, np.float32) for n, x in self.v.items()}
        self.cumulative = np.cumsum(unigram)

    def _move(self, name: str, where, slope: np.ndarray) -> None:
        seen = self.seen[name]
        seen[where] += slope * slope
        self.v[name][where] -= RATE * slope / np.sqrt(seen[where])

    def step(self, before: np.ndarray, words: np.ndarray) -> None:
        """One step on the mean loss of the words after their previous words."""
        v, n = self.v, len(words)
        drawn = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(1, len(self.noise) - 1)
        held = [v["context"][before[:, k]] for k in range(CONTEXT)]
        predicted = sum(h * v["position"][k] for k, h in enumerate(held))
        true_out, noise_out = v["outcome"][words], v["outcome"][drawn]
        true = np.einsum("ij,ij->i", predicted, true_out) + v["bias"][words] - self.offset[words]
        fake = predicted @ noise_out.T + (v["bias"][drawn] - self.offset[drawn])
        share = NOISE_PER_WORD / NOISE
        # Slopes of the mean loss by the scores.
        by_true = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32) / n
        by_fake = (share / (1 + np.exp(np.clip(-fake, -30, 30)))).astype(np.float32) / n
        by_predicted = by_true[:, None] * true_out + by_fake @ noise_out
        outs = np.concatenate([words, drawn])
        rows = np.concatenate([by_true[:, None] * predicted, by_fake.T @ predicted])
        biases = np.concatenate([by_true, by_fake.sum(0)])
        where, slopes = _sum_rows(outs, np.concatenate([rows, biases[:, None]], axis=1))
        inputs = [_sum_rows(before[:, k], by_predicted * v["position"][k]) for k in range(CONTEXT)]
        scales = [(by_predicted * h).sum(0) for h in held]
        self._move("outcome", where, slopes[:, :-1])
        self._move("bias", where, slopes[:, -1])
        for k, (at, slope) in enumerate(inputs):
            self._move("context", at, slope)
            self._move("position", k, scales[k])


def _numbered(texts: list[bytes], index: dict[bytes, int], unknown: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Lexicon numbers of all tokens of the texts with their ends, tokens per text, words outside the lexicon per text."""
    end = index.get(_END_WORD, unknown)
    numbers, sizes, outside = [], [], []
    for text in texts:
        words = words_of(text)
        found = [index.get(w, unknown) for w in words]
        found.append(end)
        outside.append([w for w, k in zip(words, found[:-1], strict=True) if k == unknown] if unknown in found else [])
        numbers.append(np.array(found, np.int32))
        sizes.append(len(found))
    return np.concatenate(numbers), np.array(sizes), outside


def _contexts(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The previous words of each token, nearest first; the start stands before a text's first word."""
    first = np.cumsum(sizes) - sizes
    before = np.full((len(numbers), CONTEXT), START, np.int64)
    for k in range(CONTEXT):
        before[k + 1 :, k] = numbers[: len(numbers) - k - 1]
        for j in range(k + 1):
            starts = first[sizes > j] + j
            before[starts, k] = START
    return before


class _Shared:
    """What tasks need of a lexicon and a model, broadcast once and unpacked once per worker."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon, model: bytes, key: str):
        self.key, self.value = key, spark.sparkContext.broadcast((lexicon, model))

    def get(self):
        return per_worker("language model", self.key, lambda: (*self.value.value, self.value.value[0].index()))


def fit(docs: DataFrame, lexicon: Lexicon, ws: Workspace) -> LogBilinear:
    """One pass over all texts of ``docs``: each partition learns from its own texts, models are averaged by tokens.

    Averaging runs in rounds of tables, each task adding up at most about ``FAN_IN`` models of fixed size; one
    model reaches the driver. Without texts the model is the unigram distribution.
    """
    spark, first = docs.sparkSession, LogBilinear.start(lexicon.unigram)
    shared = _Shared(spark, lexicon, first.to_bytes(), ws.path("start"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, start, index = shared.get()
        model, tokens = LogBilinear.from_bytes(start, lex.size), 0
        steps = NoiseContrastive(model, lex.unigram, TaskContext.get().partitionId())
        for batch in batches:
            for part in by_bytes(batch):
                found, sizes, _ = _numbered(texts_of(part), index, len(lex.words))
                numbers = lex.numbers[found]
                before = _contexts(numbers, sizes)
                for a in range(0, len(numbers), MINIBATCH):
                    steps.step(before[a : a + MINIBATCH], numbers[a : a + MINIBATCH])
                tokens += len(numbers)
        if tokens:
            yield _model_row(model.to_bytes(), tokens)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            for data, tokens in zip(batch.column("model").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                own = np.frombuffer(data, np.float32).astype(np.float64) * tokens
                total, weight = own if total is None else total + own, weight + tokens
        if weight:
            yield _model_row((total / weight).astype(np.float32).tobytes(), weight)

    schema = "model binary, tokens long"
    models = ws.stage(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(learn, schema), "models-0")
    turn = 0
    while (left := models.count()) > 1:
        turn += 1
        models = ws.stage(models.repartition(-(-left // FAN_IN)).mapInArrow(add_up, schema), f"models-{turn}")
        ws.drop(f"models-{turn - 1}")
    last = models.first()
    return LogBilinear.from_bytes(bytes(last.model), lexicon.size) if last else first


def _model_row(data: bytes, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([tokens], pa.int64())], names=["model", "tokens"])


def score_texts(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, model: LogBilinear, ws: Workspace) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text; null counts as empty, repeated rows stay.

    Frequent words are looked up in the tasks; the others meet ``counts`` in a join of (row, word, times) and come
    back as sums per row.
    """
    shared = _Shared(docs.sparkSession, lexicon, model.to_bytes(), ws.path("scoring"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, data, index = shared.get()
        bilinear = LogBilinear.from_bytes(data, lex.size)
        ten, unknown = math.log(10), len(lex.words)
        # The last entry stands for words outside the lexicon, which the join adds.
        base_terms = np.append(np.log10((lex.counts + 0.5) / lex.scale), 0.0)
        rare_terms = np.append(np.log10((lex.counts + 0.5) / lex.rare), 0.0)
        rare_terms[lex.numbers != RARE] = 0.0
        known = np.append(lex.counts > 0, False)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in by_bytes(batch):
                found, sizes, outside = _numbered(texts_of(part), index, unknown)
                numbers = lex.numbers[found]
                before = _contexts(numbers, sizes)
                scores = bilinear.log_probabilities(before, numbers)
                first = np.cumsum(sizes) - sizes
                tallies = [Counter(words) for words in outside]
                lengths = [len(t) for t in tallies]
                words = pa.array([w for t in tallies for w in t], pa.binary()).cast(pa.string())
                times = pa.array([n for t in tallies for n in t.values()], pa.int64())
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(rows), "doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes.astype(np.int64)),
                    "n_known": pa.array(np.add.reduceat(known[found].astype(np.int64), first)),
                    "base_score": pa.array(np.add.reduceat(base_terms[found], first)),
                    "score": pa.array(np.add.reduceat(scores / ten + rare_terms[found], first)),
                    "words": list_array(words, lengths), "times": list_array(times, lengths),
                })

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, words array<string>, times array<long>"
    scored = ws.stage(wanted.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    c = F.coalesce("c", F.lit(0)) + 0.5
    sums = (
        rare.join(counts, rare.words == counts.word, "left")
        .select("row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("k"), (F.col("times") * F.log10(c / lexicon.scale)).alias("b"), (F.col("times") * F.log10(c / lexicon.rare)).alias("s"))
        .groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    )
    more = lambda name, add: (F.col(name) + F.coalesce(add, F.lit(0))).alias(name)
    return scored.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "n_tokens", more("n_known", "k"), more("base_score", "b"), more("score", "s")
    )


def language_model_scores(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Learn from the training rows of ``docs`` and score every row.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Only doc_id and text are read, so further
    columns may have any name. Null texts are empty: one token, the end. Very long texts are scored whole, in pieces
    of tokens. Repeated rows each have a row, and each counts in training. An empty table gives no rows; without
    training rows every word is unseen and both scores treat it as the one unseen slot.
    """
    held = docs.select("doc_id", "text", held_out().alias("held_out"))
    training = held.where("not held_out")
    counts = ws.stage(count_words(training), "counts")
    lexicon = read_lexicon(counts)
    model = fit(training, lexicon, ws)
    scored = score_texts(held, counts, lexicon, model, ws)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op13_language_model")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, token counts, the smoothed unigram score and the model's log10 probability."""
    return language_model_scores(table(spark, sf_dir, "documents"), Workspace(spark, "language-model"))
