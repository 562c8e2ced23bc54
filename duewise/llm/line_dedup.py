"""Near-duplicate lines by a segment-partition edit join, and their removal.

A line of length l is cut into ``edits`` + 1 segments. A line within that edit distance of it holds one of its
segments unchanged, at a place that its own length narrows down: each line probes the segment index of the
lengths from its own down to ``edits`` less with the few substrings that can matter. Candidates whose letter
counts allow the distance are verified by a banded bit-parallel edit distance, all pairs of a batch at once.

Lines of one key are first compared with one centre line of the key only, and what links contracts to a group, over
several rounds; pairs are formed only of lines that are still in different groups. So k variants of a line cost k
comparisons a round, and no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import Workspace, list_array, map_rows, schema_with, table
from duewise.llm.components import components
from duewise.llm.hashing import mix, signed
from duewise.llm.phrases import Bitmap
from duewise.llm.registry import query

EDITS = 2
#: Shorter lines only meet equal lines: two edits would change much of them.
MIN_CHARS = 30
#: One line stays of every class that two documents share. With a higher bound, of classes in fewer documents one in each.
MIN_DOCUMENTS = 2
#: Blocks of a line that have letter counts of their own.
BLOCKS = 8

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
#: Code points of the lines whose keys are made at a time: so few that the working arrays stay in the processor's cache.
_PART = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_UP, _DOWN = _powers(_P, _CHUNK + 1), _powers(_P_INVERSE, _CHUNK + 1)
#: Hashes of the first code points.
_LETTERS = mix(np.arange(1, 1 << 12, dtype=np.uint64))


def _letter_hashes(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or codes.max() < len(_LETTERS):
        return _LETTERS[codes]
    return mix(codes.astype(np.uint64) + np.uint64(1))


def _moves(edits: int, less: int, number: int) -> range:
    """Places that a segment can have moved by: edits before it and after it bound them."""
    return range(max(-number, less - (edits - number)), min(number, less + (edits - number)) + 1)


def segment_keys(lines: list[np.ndarray], edits: int = EDITS, indexed_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index keys (one for each segment) and probe keys of each line of code points, as two matrices.

    A key is a hash of the indexed length, the segment's number and its characters. ``indexed_only`` leaves out
    the probes that are not index keys.
    """
    lengths = np.array([len(x) for x in lines])
    codes = np.concatenate(lines)
    total = len(codes)
    up, down = (_UP, _DOWN) if total <= _CHUNK else (_powers(_P, total + 1), _powers(_P_INVERSE, total + 1))
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_letter_hashes(codes) * up[:total], out=sums[1:])
    base = np.cumsum(lengths) - lengths

    def key(indexed: np.ndarray, number: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        start = base + at
        text = (sums[start + size] - sums[start]) * down[start]
        return mix(text ^ mix(indexed.astype(np.uint64) * np.uint64(64) + np.uint64(number)))

    index, probe = [], []
    for less in range(1 if indexed_only else edits + 1):
        indexed = lengths - less
        small, larger = indexed // (edits + 1), indexed % (edits + 1)
        at = np.zeros(len(lines), np.int64)
        for number in range(edits + 1):
            size = small + (number >= edits + 1 - larger)
            for move in (0,) if indexed_only else _moves(edits, less, number):
                probe.append(key(indexed, number, at + move, size))
                if less == 0 and move == 0:
                    index.append(probe[-1])
            at = at + size
    return np.stack(index, axis=1), np.stack(probe, axis=1)


def letter_counts(lines: list[np.ndarray]) -> np.ndarray:
    """Counts of 8 classes of characters, each modulo 16, in 32 bits."""
    owners = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    classes = (mix(np.concatenate(lines).astype(np.uint64)) >> np.uint64(61)).astype(np.int64)
    counts = np.bincount(owners * 8 + classes, minlength=8 * len(lines)).reshape(-1, 8).astype(np.uint32) & np.uint32(15)
    return np.bitwise_or.reduce(counts << (np.arange(8, dtype=np.uint32) * np.uint32(4)), axis=1)


def block_counts(lines: list[np.ndarray], edits: int = EDITS) -> np.ndarray:
    """As :func:`letter_counts` for each of ``BLOCKS`` blocks, by line and by how much shorter the indexed length is.

    Blocks are equal parts of the indexed length, so all lines of a key have blocks at the same places. An edit before
    a block moves one character in and one out, an edit in it does no more.
    """
    lengths = np.array([len(x) for x in lines])
    starts = np.cumsum(lengths) - lengths
    classes = mix(np.concatenate(lines).astype(np.uint64)) >> np.uint64(61)
    shifts = np.arange(8, dtype=np.uint32) * np.uint32(4)
    places = [starts[:, None] + (lengths - less)[:, None] // BLOCKS * np.arange(BLOCKS + 1) for less in range(edits + 1)]
    at = np.stack(places, axis=1)
    out = np.zeros((len(lines), edits + 1, BLOCKS), np.uint32)
    sums = np.zeros(len(classes) + 1, np.int32)
    for k, shift in enumerate(shifts):
        np.cumsum(classes == np.uint64(k), out=sums[1:])
        out |= (np.diff(sums[at], axis=2).astype(np.uint32) & np.uint32(15)) << shift
    return out


def _count_distance(a: Column, b: Column) -> Column:
    """Least sum of changes of the class counts; an edit changes it by at most two."""
    total = F.lit(0)
    for k in range(8):
        d = F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15))
        d = F.abs(d)
        total = total + F.least(d, 16 - d)
    return total


def _alike(x: str, y: str, edits: int) -> Column:
    """Whether the counts of two lines, and of each of their blocks, allow the distance."""
    blocks = F.zip_with(f"{x}.blocks", f"{y}.blocks", lambda a, b: _count_distance(a, b) <= 2 * edits)
    return (_count_distance(F.col(f"{x}.counts"), F.col(f"{y}.counts")) <= 2 * edits) & F.forall(blocks, lambda b: b)


def within(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int = EDITS) -> np.ndarray:
    """Whether the edit distance of each pair of code-point arrays is at most ``edits``.

    Bit r of a word stands for the row j - ``edits`` + r of column j of the distance matrix; one step of the
    loop takes a column of every pair that has one. Lines must be longer than ``edits``.
    """
    out = np.zeros(len(pairs), bool)
    todo = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= edits]
    todo.sort(key=lambda i: -len(pairs[i][1]))
    while todo:
        width = len(pairs[todo[0]][1]) + 3 * edits + 2
        part, todo = todo[: max(1, (1 << 21) // width)], todo[max(1, (1 << 21) // width) :]
        out[part] = _banded([pairs[i] for i in part], edits) <= edits
    return out


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Distances of pairs in descending order of the second length; right where they are at most ``k``."""
    m, n = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    rows = np.full((int(max(m.max(), n.max())) + 2 * k + 2, len(pairs)), -1, np.int64)
    columns = np.full((int(n.max()), len(pairs)), -2, np.int64)
    for i, (a, b) in enumerate(pairs):
        rows[k : k + len(a), i] = a
        columns[: len(b), i] = b
    top = 2 * k
    mask = np.int64((1 << (top + 1)) - 1)
    up = np.full(len(pairs), mask & ~np.int64((1 << k) - 1))
    down = np.zeros(len(pairs), np.int64)
    distance = np.full(len(pairs), k)
    for j in range(1, len(columns) + 1):
        live = int(np.searchsorted(-n, -j, side="right"))
        vp, vn = up[:live], down[:live]
        letter = columns[j - 1, :live]
        match = np.zeros(live, np.int64)
        for r in range(top + 1):
            # Row j - k + r of the matrix is character j - 1 - k + r, kept k places further on.
            match |= (rows[j - 1 + r, :live] == letter).astype(np.int64) << r
        same = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        right_up = (vn | ~(same | vp)) & mask
        right_down = same & vp
        diagonal = j <= m[:live] - k
        last = np.maximum(m[:live] - j + k, 0)
        distance[:live] += np.where(diagonal, 1 - ((same >> top) & 1), ((right_up >> last) & 1) - ((right_down >> last) & 1))
        up[:live] = (right_down | ~((same >> 1) | right_up)) & mask
        down[:live] = (same >> 1) & right_up
    return distance


def _code_points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le"), np.uint32)


def _all_code_points(lines: pa.Array) -> list[np.ndarray]:
    """The code points of each line of a batch; bytes of ASCII lines are not copied."""
    data = lines.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    codes = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if len(codes) and codes.max() >= 128:
        more = np.flatnonzero((codes & 0xC0) == 0x80)
        codes, ends = np.frombuffer(codes.tobytes().decode().encode("utf-32-le"), np.uint32), ends - np.searchsorted(more, ends)
    ends = ends.tolist()
    return [codes[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def line_occurrences(docs: DataFrame) -> DataFrame:
    """row_id, text_key, place, line_id, line of each line with a word; blanks at its ends do not count."""
    lines = _keyed(docs).select("row_id", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    trimmed = lines.select("row_id", "text_key", "place", F.trim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
    return trimmed.where("line != ''").select("*", F.xxhash64("line").alias("line_id"))


def _keys(lines: DataFrame, edits: int, met: Bitmap | None = None) -> DataFrame:
    """key, number, indexed of each segment that a line probes; ``indexed`` marks the line's own segments.

    With ``met``, only of keys that it may hold, with the line's letter counts and those of its blocks, and the line
    itself on its first row.
    """

    # How much shorter than the line the indexed length of each probe is.
    shorter = np.array([less for less in range(edits + 1) for number in range(edits + 1) for _ in _moves(edits, less, number)])

    def run(batch: pa.RecordBatch) -> dict:
        texts = _all_code_points(batch.column("line"))
        numbers = batch.column("number").to_numpy()
        outs, carried, start = [], [], 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop]) <= _PART):
                held += len(texts[stop])
                stop += 1
            index, probe = segment_keys(texts[start:stop], edits)
            own = np.zeros(probe.shape, bool)
            for column in index.T:
                own |= probe == column[:, None]
            rows = np.repeat(np.arange(stop - start), probe.shape[1])
            out = [probe.ravel(), numbers[start:stop][rows], own.ravel()]
            if met is not None:
                kept = met.may_hold(out[0])
                out = [x[kept] for x in out]
                rows = rows[kept]
                first = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
                # Counts only of lines that have a row.
                found, place = rows[first], np.cumsum(first) - 1
                lines = [texts[start + i] for i in found.tolist()]
                if lines:
                    blocks = block_counts(lines, edits)[place, np.tile(shorter, stop - start)[kept]].ravel().view(np.int32)
                    carried.append(list_array(pa.array(blocks), [BLOCKS] * len(rows)))
                    out += [letter_counts(lines)[place].view(np.int32), np.where(first, rows + start, -1)]
                else:
                    out += [rows.astype(np.int32), rows]
            outs.append(out)
            start = stop
        key, number, own, *more = (np.concatenate(x) for x in zip(*outs, strict=True))
        columns = {"key": pa.array(signed(key)), "number": pa.array(number), "indexed": pa.array(own)}
        if more:
            at = pa.array(more[1], pa.int64(), mask=more[1] < 0)
            blocks = pa.concat_arrays(carried) if carried else pa.array([], pa.list_(pa.int32()))
            columns |= {"counts": pa.array(more[0]), "blocks": blocks, "line": batch.column("line").take(at)}
        return columns

    schema = "key long, number long, indexed boolean" + (", counts int, blocks array<int>, line string" if met is not None else "")
    return map_rows(lines.select("number", "line"), run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) whose lines are within the edit distance."""
    both = pairs.join(texts.select(F.col("number").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("number").alias("b"), F.col("line").alias("y")), "b"
    )

    def check(batch: pa.RecordBatch) -> dict:
        sides = [[_code_points(t) for t in batch.column(c).to_pylist()] for c in ("x", "y")]
        kept = batch.filter(pa.array(within(list(zip(*sides, strict=True)), edits)))
        return {"a": kept.column("a"), "b": kept.column("b")}

    return map_rows(both.select("a", "b", "x", "y"), check, "a long, b long")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open_keys(members: DataFrame) -> DataFrame:
    """The rows of keys that still hold different groups, one of them with a line that indexes the key."""
    keys = members.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("indexed").alias("indexed"))
    return members.join(keys.where("low != high and indexed").select("key"), "key")


def near_groups(lines: DataFrame, ws: Workspace, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """node, component of lines (number, line; one row each) that links within the edit distance join, also over others.

    Lines shorter than ``min_chars`` code points, which must exceed ``edits`` * 4, link with nothing.
    """
    long = lines.where(F.length("line") >= max(min_chars, 4 * edits + 1))
    # Keys that two lines meet at: two numbers and a mark for each key, which combine before the shuffle.
    met = ws.stage(
        _keys(long, edits).groupBy("key").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.max("indexed").alias("indexed"))
        .where("low != high and indexed").select("key"), "met",
    )
    bits = Bitmap(met, ("met", ws.path("met")))
    rows = ws.stage(_keys(long, edits, bits), "met-rows", "zstd")
    members = ws.stage(rows.join(met, "key").select("key", "number", "indexed", "counts", "blocks", F.col("number").alias("group")), "members-0")
    texts = rows.where("line is not null").select("number", "line")
    bits.close()
    ws.drop("met")
    alike = _alike("x", "y", edits)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group"))
    links, turn = None, 0
    groups = ws.spark.createDataFrame([], "node long, component long")

    def linked(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        pairs = ws.stage(x.alias("x").join(y.alias("y"), apart & alike).select(*_pair("x.number", "y.number")).distinct(), f"pairs-{name}")
        new = ws.stage(_verified(pairs, texts, edits), f"links-{name}")
        ws.drop(f"pairs-{name}")
        return new

    while True:
        turn += 1
        # Another line of each key is its centre in each round.
        order = F.struct(F.xxhash64("number", F.lit(turn)), "number", "counts", "blocks", "group")
        centres = members.where("indexed").groupBy("key").agg(F.max(order).alias("c")).select("key", "c.number", "c.counts", "c.blocks", "c.group")
        new = linked(centres, members, str(turn))
        found = new.count()
        links = new if links is None else links.unionByName(new)
        if found:
            groups = ws.stage(components(links, ws, f"parts-{turn}"), f"groups-{turn}")
        named = members.drop("group").join(groups.withColumnRenamed("node", "number"), "number", "left")
        named = named.select("key", "number", "indexed", "counts", "blocks", F.coalesce("component", "number").alias("group"))
        members = ws.stage(_open_keys(named), f"members-{turn}")
        ws.drop(f"members-{turn - 1}", f"groups-{turn - 1}")
        # Rounds go on while they contract groups at a fair rate; the pairs of what is left are then few.
        if found * 8 < members.count() or not found:
            break
    links = links.unionByName(linked(members.where("indexed"), members, "rest"))
    groups = components(links, ws, "lines-parts")
    ws.drop(f"members-{turn}", f"groups-{turn}", "met-rows")
    return groups


def line_classes(docs: DataFrame, ws: Workspace, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes): row_id, text_key, place, line_id of every line; line_id, component of linked lines."""
    every = line_occurrences(docs)
    occurrences = ws.stage(every.drop("line"), "occurrences")
    distinct = every.select("line_id", "line").dropDuplicates(["line_id"])
    # Numbers in a row take less room in the segment join than hashes.
    lines = ws.stage(distinct.withColumn("number", F.monotonically_increasing_id()), "lines", "zstd")
    parts = near_groups(lines, ws, edits, min_chars)
    names = lines.select(F.col("number").alias("node"), "line_id")
    # A component takes the hash of its first line, as lines without links have their own.
    firsts = names.select(F.col("node").alias("component"), F.col("line_id").alias("class"))
    classes = ws.stage(parts.join(names, "node").join(firsts, "component").select("line_id", F.col("class").alias("component")), "classes")
    ws.drop("lines")
    return occurrences, classes


def remove_lines(
    docs: DataFrame, ws: Workspace, edits: int = EDITS, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_removed, n_near.

    Equal lines, and lines within ``edits`` edits of each other, also over further lines, form a class. Of a class
    in at least ``min_documents`` documents the first line in order of doc_id and place stays; of other classes
    the first of each document. n_lines counts lines with a word, n_near those of them whose class holds different
    lines. Lines without a word stay where they are; a null text stays null, with counts of 0. Columns of these
    names are replaced. Rows that repeat a row in full are decided alike, as one document; doc_id null comes first.
    """
    occurrences, classes = line_classes(docs, ws, edits, min_chars)
    placed = ws.stage(
        occurrences.distinct().join(classes, "line_id", "left").select(
            "row_id", "text_key", "place", F.coalesce("component", "line_id").alias("class"), F.col("component").isNotNull().alias("near")
        ), "placed",
    )
    # One row for each class and document, then one for each class with repeats.
    by_document = placed.groupBy("class", "row_id", "text_key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    repeated = ws.stage(
        by_document.groupBy("class").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"), F.min(F.struct("row_id", "text_key", "place")).alias("first")
        ).where("n > 1"), "repeated",
    )
    wide = repeated.where(F.col("documents") >= min_documents).select("class", "first")
    narrow = repeated.where((F.col("documents") < min_documents) & (F.col("n") > F.col("documents"))).select("class")
    # Boilerplate: everything but the first line; otherwise everything but the first line of the document.
    gone_wide = placed.join(wide, "class").where(F.struct("row_id", "text_key", "place") != F.col("first")).select("row_id", "text_key", "place")
    own_first = by_document.where("n > 1").join(narrow, "class").select("class", "row_id", "text_key", F.col("place").alias("stays"))
    gone_narrow = placed.join(own_first, ["class", "row_id", "text_key"]).where("place != stays").select("row_id", "text_key", "place")
    gone = gone_wide.unionByName(gone_narrow).groupBy("row_id", "text_key").agg(F.collect_list("place").alias("gone"))
    near = placed.where("near").groupBy("row_id", "text_key").agg(F.count(F.lit(1)).alias("near"))
    changes = ws.stage(gone.join(near, ["row_id", "text_key"], "full"), "changes")
    ws.drop("occurrences", "classes", "placed", "repeated")
    body = F.coalesce("text", F.lit(""))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "n_near")]
    # The document's own columns travel in one struct, so that none can clash with a working column.
    rows = docs.select(
        F.struct(*names).alias("own"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row_id"), F.xxhash64(body).alias("text_key")
    )
    joined = rows.join(changes, ["row_id", "text_key"], "left")
    cut = joined.select("own", "text", "gone", "near")
    added = {"n_lines": T.LongType(), "n_removed": T.LongType(), "n_near": T.LongType()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], ([], [], [])
        rows = zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), batch.column("near").to_pylist(), strict=True)
        for text, gone, near in rows:
            lines = (text or "").split("\n")
            out = set(gone or ())
            texts.append(text if not out else "\n".join(x for i, x in enumerate(lines) if i not in out))
            for values, n in zip(counts, (sum(1 for x in lines if x.strip(" \t\r\x0b\x0c")), len(out), near or 0), strict=True):
                values.append(n)
        arrays = [batch.column("own"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in counts)]
        return pa.RecordBatch.from_arrays(arrays, names=["own", "text", *added])

    out = map_rows(cut, run, schema_with(cut.select("own", "text"), **added))
    return out.select("own.*", "text", *added).select(*(c for c in docs.columns if c not in added), *added)


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: n_lines, n_near, n_removed and kept_sha256 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = remove_lines(docs, Workspace(spark, "line-dedup"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_near", "n_removed", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
