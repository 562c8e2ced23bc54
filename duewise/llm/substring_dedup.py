"""Removal of long word sequences that occur more than once, by content-defined blocks.

Blocks stand in for relative Lempel-Ziv parsing: no document is factored greedily against a reference and no
factor is extended, since blocks and windows meet by equi-joins that need no sequential pass over a reference.

The reference is the corpus itself, cut into content-defined blocks: of every window of ``WINDOW`` words the
12-gram of least hash is its anchor, and the windows in a row with one anchor form a block together with the
words they reach. Equal windows have equal anchors, so a document meets only reference blocks of its anchors.

A block that occurs elsewhere as a whole is found by its anchor and content. Every other window whose anchor is
shared is looked up by itself among those of the blocks with the same anchor.
Hashes have 64 bits; a block is compared by two of them, and windows only after their anchor has matched.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import Workspace, list_array, map_rows, schema_with, table, texts_of
from duewise.llm.hashing import range_hashes, signed, window_hashes, word_hashes
from duewise.llm.registry import query

WINDOW, GRAM = 35, 12


def blocks(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and content hash of each block of a document."""
    grams = window_hashes(words, gram)
    reach = window - gram + 1
    if len(grams) < reach:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    places = sliding_window_view(grams, reach).argmin(axis=1) + np.arange(len(grams) - reach + 1)
    starts = np.append(0, np.flatnonzero(np.diff(places)) + 1)
    ends = np.append(starts[1:], len(places))
    return starts, ends - starts, grams[places[starts]], range_hashes(words, starts, ends + window - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: least), text and two hashes that stand for the text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row_id"), text.alias("text"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"),
    )


def _parsed(docs: DataFrame) -> DataFrame:
    """The blocks of each row of :func:`_keyed`."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [blocks(word_hashes(t)) for t in texts_of(batch)]
        sizes = [len(x[0]) for x in found]
        starts, windows, anchors, contents = (np.concatenate(x) for x in zip(*found, strict=True))
        return {c: batch.column(c) for c in ("row_id", "k1", "k2")} | {
            "starts": list_array(pa.array(starts.astype(np.int32)), sizes), "windows": list_array(pa.array(windows.astype(np.int32)), sizes),
            "anchors": list_array(pa.array(signed(anchors)), sizes), "contents": list_array(pa.array(signed(contents)), sizes),
        }

    return map_rows(docs, run, "row_id long, k1 long, k2 long, starts array<int>, windows array<int>, anchors array<long>, contents array<long>")


def _open_windows(docs: DataFrame) -> DataFrame:
    """One row (class_id, place, hash, asked) for each window of the ranges that need a look at single windows."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text, class_id, ranges in zip(texts_of(batch), batch.column("class_id").to_pylist(), batch.column("open").to_pylist(), strict=True):
            hashes = window_hashes(word_hashes(text), WINDOW)
            for r in ranges:
                places = np.arange(r["start"], r["start"] + r["windows"])
                out.append((np.full(len(places), class_id), places, hashes[places], np.full(len(places), r["state"] == 1)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return {
            "class_id": pa.array(columns[0], pa.int64()), "place": pa.array(columns[1].astype(np.int32)),
            "hash": pa.array(columns[2].astype(np.uint64).view(np.int64)), "asked": pa.array(columns[3].astype(bool)),
        }

    return map_rows(docs, run, "class_id long, place int, hash long, asked boolean")


def repeated_windows(docs: DataFrame, ws: Workspace) -> DataFrame:
    """k1, k2, copies, ranges: for each distinct text with repeats, the ranges of windows that occur elsewhere.

    ``copies`` is the number of rows with the text; if there are several, all its windows occur elsewhere and
    ``ranges`` need not name them.
    """
    keyed = _keyed(docs)
    parsed = ws.stage(_parsed(keyed).withColumn("class_id", F.monotonically_increasing_id()), "parsed")
    # Copies of a whole text stand in for each other: only one of them is parsed against the others.
    classes = ws.stage(
        parsed.groupBy("k1", "k2").agg(F.min("class_id").alias("class_id"), F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    distinct = parsed.where(F.size("anchors") > 0).join(classes.select("class_id"), "class_id", "left_semi")
    one_each = ws.stage(distinct.select("class_id", "starts", "windows", "anchors", "contents"), "distinct")
    ws.drop("parsed")
    zipped = F.explode(F.arrays_zip("starts", "windows", "anchors", "contents")).alias("b")
    all_blocks = one_each.select("class_id", zipped).select(
        "class_id", F.col("b.starts").alias("start"), "b.windows", F.col("b.anchors").alias("anchor"), F.col("b.contents").alias("content")
    )
    shared = ws.stage(
        one_each.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors"
    )
    met = ws.stage(all_blocks.join(shared, "anchor"), "met")
    ws.drop("distinct", "anchors")
    # The index of reference blocks that occur more than once, each with the occurrence that stands for it.
    index = ws.stage(
        met.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("class_id", "start")).alias("first")).where("n > 1"), "index"
    )
    placed = met.join(index, ["anchor", "content"], "left").select(
        "class_id", "start", "windows",
        F.when(F.col("first").isNull(), 1).when((F.col("first.class_id") == F.col("class_id")) & (F.col("first.start") == F.col("start")), 3).otherwise(2).alias("state"),
    )
    # A document's own blocks come together; their number is bounded by its length.
    parse = ws.stage(placed.groupBy("class_id").agg(F.collect_list(F.struct("start", "windows", "state")).alias("blocks")), "parse")
    ws.drop("met", "index")
    factors = F.transform(F.filter("blocks", lambda b: b["state"] > 1), lambda b: F.struct(b["start"], b["windows"]))
    open_ = F.filter("blocks", lambda b: b["state"] != 2)
    asked = parse.where(F.exists("blocks", lambda b: b["state"] == 1) | F.exists("blocks", lambda b: b["state"] == 3)).select("class_id", open_.alias("open"))
    wanted = ws.stage(asked.join(classes, "class_id").select("class_id", "k1", "k2", "row_id", "open"), "wanted")
    edges = ws.stage(_open_windows(keyed.join(wanted, ["k1", "k2", "row_id"]).select("text", "class_id", "open")), "edges")
    known = ws.stage(edges.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "known")
    hits = edges.where("asked").join(known, "hash").groupBy("class_id").agg(
        F.collect_list(F.struct(F.col("place").alias("start"), F.lit(1).alias("windows"))).alias("singles")
    )
    ranges = parse.select("class_id", factors.alias("factors")).join(hits, "class_id", "left").select(
        "class_id", F.concat("factors", F.coalesce("singles", F.array().cast("array<struct<start:int,windows:int>>"))).alias("ranges")
    )
    none = F.array().cast("array<struct<start:int,windows:int>>")
    found = classes.join(ranges, "class_id", "left").select("k1", "k2", "copies", F.coalesce("ranges", none).alias("ranges"))
    out = ws.stage(found.where((F.col("copies") > 1) | (F.size("ranges") > 0)), "ranges")
    ws.drop("classes", "parse", "wanted", "edges", "known")
    return out


def remove_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row.

    A word goes if a window of ``WINDOW`` words over it also starts anywhere else in the input, the same row
    included; all occurrences go. Texts of fewer words, empty and null ones lose nothing. Rows of one doc_id are
    judged one by one; rows with equal texts count as each other's repeats.
    """
    found = repeated_windows(docs, ws)
    joined = _keyed(docs).join(found, ["k1", "k2"], "left").select("doc_id", "text", "copies", "ranges")

    def run(batch: pa.RecordBatch) -> dict:
        sizes, removed, kept = [], [], []
        rows = zip(texts_of(batch), batch.column("copies").to_pylist(), batch.column("ranges").to_pylist(), strict=True)
        for text, copies, ranges in rows:
            words = text.split()
            stay = np.ones(len(words), bool)
            if copies is not None and copies > 1 and len(words) >= WINDOW:
                stay[:] = False
            elif ranges:
                change = np.zeros(len(words) + 1, np.int64)
                starts = np.array([r["start"] for r in ranges])
                ends = starts + np.array([r["windows"] for r in ranges]) + WINDOW - 1
                np.add.at(change, starts, 1)
                np.add.at(change, ends, -1)
                stay = np.cumsum(change)[:-1] == 0
            sizes.append(len(words))
            removed.append(len(words) - int(stay.sum()))
            kept.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s]))
        return {
            "doc_id": batch.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    schema = schema_with(docs.select("doc_id"), n_words=T.LongType(), n_removed=T.LongType(), kept=T.StringType())
    return map_rows(joined, run, schema)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from win) where c > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from rep),
lost as (select doc_id, count(*) as n from gone group by doc_id),
word as (select doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
stay as (select doc_id, string_agg(x, ' ' order by p) as kept from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join lost using (doc_id) left join stay using (doc_id)
"""


@query("op4_substring_dedup", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256."""
    kept = remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "substring-dedup"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
