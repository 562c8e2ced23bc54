"""Benchmark decontamination by one Aho-Corasick automaton over word windows of the items.

Text and items are normalised alike: A-Z lower-cased, everything outside ``[0-9a-z]`` and non-ASCII is a word
break. The normalised text keeps one byte per byte of the original until words are joined, so that hits map
back to offsets of the original.
"""

from __future__ import annotations


import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import map_rows, per_worker, schema_with, table, texts_of
from duewise.llm.registry import query

WINDOW = 13
#: Bytes of item text per automaton; larger benchmarks are scanned part by part.
PART_BYTES = 32 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ADDED = {
    "n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.LongType()),
    "hit_words": T.ArrayType(T.IntegerType()), "spans": T.ArrayType(SPAN),
}


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


class Matcher:
    """The automaton of a set of items: patterns are windows of words with a space at either end."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        import ahocorasick

        owners: dict[str, tuple[int, set[int]]] = {}
        for item, text in items:
            words = folded(text).decode("latin-1").split(" ")
            words = [w for w in words if w]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners.setdefault(f" {' '.join(words[i : i + size])} ", (size, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton() if owners else None
        for pattern, value in owners.items():
            self.automaton.add_word(pattern, value)
        if owners:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> tuple[set[int], np.ndarray]:
        """Items with an occurring window, and the numbers of the words inside any occurrence."""
        line = b" " + b" ".join(folded(text).split()) + b" "
        if self.automaton is None:
            return set(), np.zeros(0, np.int32)
        items: set[int] = set()
        ends, sizes = [], []
        for end, (size, owners) in self.automaton.iter(line.decode("latin-1")):
            ends.append(end)
            sizes.append(size)
            items |= owners
        if not ends:
            return items, np.zeros(0, np.int32)
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        after = np.searchsorted(spaces, ends)
        marks = np.zeros(len(spaces) + 1, np.int32)
        np.add.at(marks, after - np.array(sizes), 1)
        np.add.at(marks, after, -1)
        return items, np.flatnonzero(np.cumsum(marks) > 0).astype(np.int32)


def original_spans(text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the original text that cover runs of the given word numbers."""
    if not len(words):
        return []
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = np.frombuffer(folded(text), np.uint8) == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(words) > 1)
    first, last = words[np.append(0, breaks + 1)], words[np.append(breaks, len(words) - 1)]
    return [(int(a), int(b)) for a, b in zip(points[edges[0::2][first]], points[edges[1::2][last]], strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with the benchmark words in ``text``.

    Adds ``n_words``; ``n_hit`` and ``hit_words``, count and numbers of the words inside an occurrence of a window;
    ``items``, the item_ids with an occurring window, ascending; ``spans``, code-point ranges of the original text.
    Columns of these names are replaced. A null text has no words; an item without words or id is no window; an
    empty benchmark gives no hits; items with equal windows are all reported.
    The benchmark is broadcast in parts of at most about ``part_bytes``; all documents meet each part.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    context = docs.sparkSession.sparkContext
    shared = [
        context.broadcast([(r.item_id, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toLocalIterator()])
        for k in range(parts)
    ]
    kept = docs.drop(*_ADDED)
    out = kept
    for k, part in enumerate(shared):
        out = _scan(out, kept.columns, part, window, first=k == 0)
    return out


def _scan(docs: DataFrame, kept: list[str], part, window: int, first: bool) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = per_worker("matcher", key, lambda: Matcher(part.value, window))
        texts = texts_of(batch)
        found = [matcher.find(t) for t in texts]
        if not first:
            before = zip(batch.column("items").to_pylist(), batch.column("hit_words").to_pylist(), strict=True)
            found = [(x | set(a), np.union1d(y, np.array(b, np.int32))) for (x, y), (a, b) in zip(found, before, strict=True)]
        columns = [
            pa.array([len(folded(t).split()) for t in texts], pa.int64()),
            pa.array([len(y) for _, y in found], pa.int64()),
            pa.array([sorted(x) for x, _ in found], pa.list_(pa.int64())),
            pa.array([y.tolist() for _, y in found], pa.list_(pa.int32())),
            pa.array(
                [[{"start": a, "end": b} for a, b in original_spans(t, y)] for t, (_, y) in zip(texts, found, strict=True)],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
            ),
        ]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], names=[*kept, *_ADDED])

    schema = schema_with(docs.select(kept), **_ADDED)
    return map_rows(docs, run, schema)


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word in twenty lies inside a benchmark window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


ORACLE = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ip as (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from iw where len(w) > 0),
iwin as (select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from ip),
sizes as (select distinct n from iwin),
dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n),
dwin as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from dp),
occ as (select doc_id, item_id, i, n from dwin join iwin using (n, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc_id, cast(item_id as varchar) as s from occ) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join its using (doc_id)
"""


@query("op6_decontamination", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 of the sorted ids, contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[int, str]]) -> tuple[int, int, list[int]]:
    """Words, hit words and items of one text by direct comparison; for tests."""
    words = folded((text or "").encode()).split()
    hit: set[int] = set()
    found = set()
    for item, body in items:
        w = folded(body.encode()).split()
        size = min(WINDOW, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found)
