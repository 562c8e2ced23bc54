"""Phrases whose words keep together, mined from sorted streams of counts.

Words are known by 64-bit keys, under a seed for which no two words of the corpus share one, so a phrase is a
row of whole numbers. Counts of phrases are kept in two streams: prefix order (first word first) and suffix
order (last word first). In either stream a phrase follows its shorter beginnings and precedes its
extensions, so one lockstep pass over a sorted partition gives each phrase the counts of all its
beginnings, and tells it which phrase it extends; beginnings that lie before a partition's first row, three at
most, are looked up in the counts. Both passes meet in a merge join in the order of the phrases.

Only frequent phrases enter the streams. Longer phrases are counted where all their pairs of words are frequent,
which bitmaps of bounded size tell the tasks; a bit set by another pair costs work, never a wrong count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duewise.llm.chunks import by_bytes
from duewise.llm.common import Workspace, per_worker, table, texts_of
from duewise.llm.hashing import mix, word_spans
from duewise.llm.registry import query

#: Least count of a candidate, most words of one, phrases returned for each language.
LEAST, LONGEST, RETURNED = 30, 4, 2000
#: A candidate goes if a longer candidate with its words has at least 80 hundredths of its count.
KEPT_SHARE = 80
SCALE = 2_000_000
UNKNOWN_LANGUAGE = "und"
#: Bits of the largest bitmap (16 MB) as a power of two; a bitmap has ``SPARE`` bits a key where they fit.
BITS, SPARE = 27, 32
#: Phrases that a task holds; they are added up, and handed on only if more than half as many differ.
ROOM = 3 << 19
#: Seeds that are tried; two of 10^9 words share a key under one seed in forty.
SEEDS = 20

KEYS = ("w1", "w2", "w3", "w4")
#: A-Z become a-z; ends of pieces become line feeds, tabs become spaces.
_TEXT = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def key_table(seed: int) -> tuple[np.ndarray, np.uint64]:
    """Random odd values of the bytes and the base of their polynomial."""
    rng = np.random.default_rng(1000 + seed)
    return rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**62, dtype=np.uint64) * np.uint64(4) + np.uint64(1)


def word_keys(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A key for each word, never 0; equal words have equal keys. Work is by places of letters, not by words."""
    values, base = key_table(seed)
    letters = np.frombuffer(data, np.uint8)
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    if len(lengths):
        order = np.argsort(-lengths, kind="stable")
        first, left = starts[order], np.sort(lengths)
        total = out[order]
        n = len(order)
        for j in range(int(left[-1])):
            n = len(left) - int(np.searchsorted(left, j, "right"))
            total[:n] = total[:n] * base + values[letters[first[:n] + j]]
        out[order] = total
    return np.maximum(mix(out), np.uint64(1))


class Piece:
    """Words of the texts of one language: keys, and for each word the words that follow it in its piece."""

    def __init__(self, data: bytes, language: bytes, seed: int):
        self.data = data.translate(_TEXT)
        self.starts, self.ends = word_spans(self.data)
        own = word_keys(language, np.array([0]), np.array([len(language)]), seed)
        # The language's part is mixed once more, so that language and word cannot change places.
        self.keys = mix(word_keys(self.data, self.starts, self.ends, seed) + mix(own + np.uint64(1)))
        self.keys = np.maximum(self.keys, np.uint64(1))
        breaks = np.cumsum(np.frombuffer(self.data, np.uint8) == 10, dtype=np.int64)
        self.piece = breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def joined(self) -> np.ndarray:
        """Whether each word but the last is followed by a word of its own piece."""
        return self.piece[1:] == self.piece[:-1]


def pieces_of(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, Piece]]:
    """The texts of a batch by language, joined by ends of pieces."""
    for part in by_bytes(batch):
        by_language: dict[str, list[bytes]] = {}
        for language, text in zip(part.column("lang").to_pylist(), texts_of(part), strict=True):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            yield language, Piece(b"\n".join(texts), language.encode(), seed)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, key, n of all words; ``key`` stands for the word of that language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, piece in pieces_of(batch, seed):
                spans = zip(piece.keys.tolist(), piece.starts.tolist(), piece.ends.tolist(), strict=True)
                tally = Counter((piece.data[a:b], key) for key, a, b in spans)
                words, keys = zip(*tally, strict=True) if tally else ((), ())
                counts = tally.values()
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([language] * len(words), pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()),
                    "key": pa.array(np.array(keys, np.uint64).view(np.int64)), "n": pa.array(list(counts), pa.int64()),
                })

    found = _texts(docs).mapInArrow(run, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def keyed_words(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """The word counts under the first seed for which no two words share a key, and the seed.

    Words of one chunk that share a key are told apart by their bytes before they are counted.
    """
    for seed in range(SEEDS):
        words = ws.stage(count_words(docs, seed), f"words-{seed}")
        shared = words.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        if shared.isEmpty():
            return words, seed
        ws.drop(f"words-{seed}")
    raise RuntimeError(f"words share keys under each of {SEEDS} seeds")


class Bitmap:
    """Which keys may be frequent: two bits for each key, by its leading and its last bits, in a size that follows their number.

    Where the largest size has too few bits for that, one bit for each key. So the driver holds and sends no more than the keys need.
    """

    def __init__(self, keys: DataFrame, name: tuple[str, str]):
        """Of a table whose columns are the keys of one word, or of the two words of a pair."""
        n = keys.count()
        self.size = min(BITS, max(16, (SPARE * n).bit_length()))
        self.both = 2 * n < 1 << self.size
        places = self._places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [c.to_numpy().view(np.uint64) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(own[0] if len(own) == 1 else pair_key(*own))) + 1)], names=["bit"])

        # The functions count bits from 1.
        rows = keys.mapInArrow(run, "bit long").select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
        parts = rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
        bits = np.zeros(1 << (self.size - 3), np.uint8)
        for r in parts.toLocalIterator():
            a = 4096 * (int(r.bucket) - 1)
            bits[a : a + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)[: len(bits) - a]
        self.name, self.shared = name, keys.sparkSession.sparkContext.broadcast(bits.tobytes())

    @property
    def _places(self):
        """The places of keys, without the table behind them."""
        size, both = self.size, self.both

        def places(keys: np.ndarray) -> list[np.ndarray]:
            first = (keys >> np.uint64(64 - size)).astype(np.int64)
            return [first, (keys & np.uint64((1 << size) - 1)).astype(np.int64)] if both else [first]

        return places

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        bits = per_worker(f"bitmap {self.name[0]}", self.name, lambda: np.frombuffer(self.shared.value, np.uint8))
        first, *second = self._places(keys)
        out = (bits[first >> 3] >> (first & 7).astype(np.uint8)) & 1 != 0
        for bit in second:
            # Few keys are left to look at once more.
            left = np.flatnonzero(out)
            bit = bit[left]
            out[left] = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
        return out

    def close(self) -> None:
        """Free the bitmap; the tables counted by it are written."""
        self.shared.destroy()


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


class Counts:
    """Phrases of a task as rows of keys with counts. Equal ones are added up whenever ``ROOM`` rows are held.

    What is added up stays until the task's end, unless it fills more than half the room. So a task hands on each phrase once
    if it meets no more than ``ROOM`` / 2 different ones.
    """

    def __init__(self, width: int):
        self.width, self.rows, self.counts, self.held, self.summed = width, [], [], 0, False

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            self.rows.append(rows)
            self.counts.append(np.ones(len(rows), np.int64))
            self.held += len(rows)
            self.summed = False
        if self.held >= ROOM:
            self._sum()
            if self.held > ROOM // 2:
                yield from self.take()

    def _sum(self) -> None:
        if self.summed:
            return
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        self.rows, self.counts = [], []
        # In order of one hash; phrases that share it may stay in several rows, which Spark adds up.
        hashes = rows[:, 0].copy()
        for k in range(1, self.width):
            hashes = pair_key(hashes, rows[:, k])
        order = np.argsort(hashes)
        rows, counts = rows[order], counts[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
        self.rows, self.counts, self.held = [rows[first]], [np.add.reduceat(counts, first)], len(first)
        self.summed = True

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._sum()
        rows, counts = self.rows[0].view(np.int64), self.counts[0]
        self.rows, self.counts, self.held = [], [], 0
        arrays = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(self.width)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts)], names=[*KEYS[: self.width], "n"])


def count_pairs(docs: DataFrame, seed: int, words: Bitmap) -> DataFrame:
    """w1, w2, n of all pairs of neighbours in a piece whose words may both be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(2)
        for batch in batches:
            for _, piece in pieces_of(batch, seed):
                good = words.may_hold(piece.keys)
                at = np.flatnonzero(piece.joined() & good[1:] & good[:-1])
                yield from counts.add(np.stack([piece.keys[at], piece.keys[at + 1]], axis=1))
        yield from counts.take()

    return _texts(docs).mapInArrow(run, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def count_longer(docs: DataFrame, seed: int, words: Bitmap, pairs: Bitmap) -> DataFrame:
    """w1 to w4, n of the phrases of three and four words all of whose pairs may be frequent; w4 is 0 for three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(4)
        for batch in batches:
            for _, piece in pieces_of(batch, seed):
                k, good = piece.keys, words.may_hold(piece.keys)
                link = piece.joined() & good[1:] & good[:-1]
                link[link] = pairs.may_hold(pair_key(k[:-1][link], k[1:][link]))
                three = np.flatnonzero(link[1:] & link[:-1])
                yield from counts.add(np.stack([k[three], k[three + 1], k[three + 2], np.zeros(len(three), np.uint64)], axis=1))
                four = np.flatnonzero(link[2:] & link[1:-1] & link[:-2])
                yield from counts.add(np.stack([k[four + j] for j in range(4)], axis=1))
        yield from counts.take()

    found = _texts(docs).mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, n long")
    return found.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def lockstep(stream: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The stream w1 to w4, n in order, each row with p1, p2, p3, the counts of its beginnings of one to three words.

    The rows are cut into ranges of the order and sorted, so equal beginnings lie together however frequent their
    first word is. A beginning may stand before the first row of a range: those, three a range, are read from the
    counts by a join of that small table and filled in.
    """
    ordered = stream.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Key and count of the last beginning of each length; no key is 0 but that of no word.
        last = [((0,) * k, 0) for k in (1, 2, 3)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in KEYS], axis=1)
            n = batch.column("n").to_numpy()
            length = (rows != 0).sum(1)
            filled = []
            for k in (1, 2, 3):
                key, count = last[k - 1]
                is_own = np.flatnonzero(length == k)
                # Place of the newest row of k words at or before each row; -1 is the one carried over.
                newest = np.searchsorted(is_own, np.arange(len(rows)), "right") - 1
                keys = np.concatenate([np.array([key], np.int64).reshape(1, k), rows[is_own, :k]])
                counts = np.append(count, n[is_own])
                match = (keys[newest + 1] == rows[:, :k]).all(1)
                filled.append(pa.array(counts[newest + 1], mask=~(match & (length > k))))
                last[k - 1] = (tuple(keys[-1].tolist()), int(counts[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "n")), *filled], names=[*KEYS, "n", "p1", "p2", "p3"])

    schema = ", ".join(f"{c} long" for c in (*KEYS, "n", "p1", "p2", "p3"))
    passed = ws.stage(ordered.mapInArrow(run, schema), name)
    # A row whose beginning was not seen: it lies at the head of its range.
    for k in (1, 2, 3):
        own, rest = list(KEYS[:k]), [F.lit(0).cast("long").alias(c) for c in KEYS[k:]]
        missing = passed.where((F.col(KEYS[k]) != 0) & F.col(f"p{k}").isNull()).select(*own).distinct()
        looked = missing.select(*own, *rest).join(stream, list(KEYS)).select(*own, F.col("n").alias("_p"))
        passed = passed.join(F.broadcast(looked), own, "left").withColumn(f"p{k}", F.coalesce(f"p{k}", F.when(F.col(KEYS[k]) != 0, F.col("_p")))).drop("_p")
    return passed


def _decimal(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (left + right)) in whole numbers."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * _decimal(a), _decimal(left) + _decimal(right))


def _length() -> Column:
    return sum(((F.col(c) != 0).cast("int") for c in KEYS[1:]), F.lit(1))


def _reversed() -> list[Column]:
    """w1 to w4 in the order of the last word first, absent words last."""
    turned = F.filter(F.reverse(F.array(*KEYS)), lambda x: x != 0)
    return [F.coalesce(F.get(turned, F.lit(k)), F.lit(0).cast("long")).alias(c) for k, c in enumerate(KEYS)]


def _extended(passed: DataFrame) -> DataFrame:
    """The beginnings, one word shorter, that have at least the share of a candidate that extends them."""
    length = _length()
    parent = F.when(length == 2, F.col("p1")).when(length == 3, F.col("p2")).when(length == 4, F.col("p3"))
    covers = passed.where((length >= 3) & (_decimal(F.col("n")) * 100 >= _decimal(parent) * KEPT_SHARE))
    return covers.select(*(F.when(length > k + 1, F.col(c)).otherwise(0).cast("long").alias(c) for k, c in enumerate(KEYS))).distinct()


def find_phrases(docs: DataFrame, ws: Workspace, returned: int = RETURNED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``returned`` phrases of each language.

    Null texts are empty, a null lang is ``und``. Only lang and text are read, so further columns may have any name.
    Repeated rows count each; very long texts are read whole, in pieces of bytes; ties go by count and then by the
    phrase's bytes. An empty table gives no rows. Arithmetic is on whole numbers, in decimals where products may pass
    64 bits.
    """
    words, seed = keyed_words(docs, ws)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= LEAST)
    key = F.col("key")
    word_bits = Bitmap(frequent.select("key"), ("words", ws.path("words")))
    pairs = ws.stage(count_pairs(docs, seed, word_bits).where(F.col("n") >= LEAST), "pairs")
    pair_bits = Bitmap(pairs.select("w1", "w2"), ("pairs", ws.path("pairs")))
    longer = ws.stage(count_longer(docs, seed, word_bits, pair_bits).where(F.col("n") >= LEAST), "longer")
    word_bits.close()
    pair_bits.close()
    none = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    stream = ws.stage(
        frequent.select(key.alias("w1"), *none("w2", "w3", "w4"), "n")
        .unionByName(pairs.select("w1", "w2", *none("w3", "w4"), "n"))
        .unionByName(longer), "counts",
    )
    ws.drop("pairs", "longer")
    prefix = lockstep(stream, ws, "prefix-order")
    suffix = lockstep(stream.select(*_reversed(), "n"), ws, "suffix-order")
    covered = _extended(prefix).unionByName(_extended(suffix).select(*_reversed())).distinct()
    ends = suffix.select(*_reversed(), *(F.col(f"p{k}").alias(f"s{k}") for k in (1, 2, 3)))
    candidates = prefix.where("w2 != 0").hint("merge").join(ends.where("w2 != 0"), list(KEYS)).join(covered, list(KEYS), "left_anti")
    length = _length()
    # Cut k leaves length - k words at the end.
    cuts = []
    for k in (1, 2, 3):
        rest = F.when(length - k == 1, F.col("s1")).when(length - k == 2, F.col("s2")).when(length - k == 3, F.col("s3"))
        cuts.append(F.when(length > k, F.struct(_score(F.col("n"), F.col(f"p{k}"), rest).alias("score"), F.lit(k).alias("k"), F.col(f"p{k}").alias("l"), rest.alias("r"))))
    lowest = candidates.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())))
    first = frequent.select(key.alias("w1"), "lang")
    ranked = lowest.join(first, "w1").withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("n"))))
    few = ws.stage(ranked.where(F.col("place") <= returned).select("lang", *KEYS, F.col("n").alias("a"), "cut"), "first")
    ws.drop("prefix-order", "suffix-order")
    named = (
        few.select("lang", *KEYS, "a", "cut", F.posexplode(F.filter(F.array(*KEYS), lambda x: x != 0)).alias("at", "key"))
        .join(frequent.select("key", "word"), "key")
        .groupBy(*KEYS).agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("cut").alias("cut"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
        .select("lang", F.array_join("parts.word", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= returned)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), pieces as (
    select row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs
), lists as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
    select lang, sum(len(words))::bigint as n from lists group by lang
), starts as (
    select lang, words, unnest(range(1, len(words) + 1)) as i from lists where len(words) > 0
), grams as (
    select lang, words[i:i + size - 1] as g, count(*) as f from (select *, unnest([1, 2, 3, 4]) as size from starts)
    where i + size - 1 <= len(words) group by all having count(*) >= 30
), halves as (
    select lang, g, f as a, k, g[1:k] as g1, g[k + 1:] as g2 from (select *, unnest(range(1, len(g))) as k from grams)
), cuts as (
    select c.lang, c.g, c.a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
    from halves c join grams x on x.lang = c.lang and x.g = c.g1 join grams y on y.lang = c.lang and y.g = c.g2
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1
), covered as (
    select lang, g[1:len(g) - 1] as g, max(f) as f from grams where len(g) > 2 group by all
    union all select lang, g[2:], max(f) from grams where len(g) > 2 group by all
), most as (
    select lang, g, max(f) as f from covered group by all
), kept as (
    select l.* from lowest l left join most c on c.lang = l.lang and c.g = l.g where c.f is null or 100 * c.f < 80 * l.a
)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, array_to_string(g, ' '))::bigint as rank, array_to_string(g, ' ') as phrase,
    a::bigint as a, l::bigint as l, r::bigint as r, t.n, score::bigint as score
from kept k join totals t on t.lang = k.lang qualify rank <= 2000
"""


@query("op11_phrases", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return find_phrases(table(spark, sf_dir, "documents"), Workspace(spark, "phrases"))
