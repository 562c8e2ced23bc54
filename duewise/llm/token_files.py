"""Token ids in word-aligned binary files (Simple-8b).

File: block records, each followed by one newline, in ascending ``doc_id`` order over the sorted file names.
Record, little-endian: magic ``S8B1``; uint32 counts of documents, ids, 64-bit words, escapes; int64 doc_id and
uint8 presence (0: the doc_id is null) and uint32 id count of each document; uint32 offset of the first word of
each block of 1024 ids; the words; the escaped values as uint64.
Word: the low four bits select how many values of how many bits the upper sixty hold. Selector 0 is an escape,
whose upper bits are the place of a value of more than sixty bits in the record's list; selector 1 stands for
120 zeros. The last word of a block may hold fewer values than its selector says.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duewise.llm.byte_bpe import byte_characters
from duewise.llm.common import Workspace, list_array, map_rows, per_worker, table, texts_of
from duewise.llm.registry import query

BLOCK = 1024
RECORD_IDS = 1 << 19
RECORDS_PER_FILE = 16
MAGIC = b"S8B1"

# Values per word and bits per value, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.uint8)


_WIDTHS = _widths(np.arange(1 << 16, dtype=np.uint64))


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector that packs the most values from there."""
    blocks, width = bits.shape
    best = np.zeros((blocks, width), np.uint8)
    padded = np.zeros((blocks, width + 120), np.uint8)
    padded[:, :width] = bits
    # Largest width over the next 2**k values; two overlapping runs give any count.
    runs = [padded]
    while (1 << len(runs)) <= 120:
        last, step = runs[-1], 1 << (len(runs) - 1)
        longer = last.copy()
        np.maximum(last[:, :-step], last[:, step:], out=longer[:, :-step])
        runs.append(longer)
    # Those of fewer, wider values first: what packs more takes their place.
    for selector in range(15, 0, -1):
        count = int(COUNTS[selector])
        k = count.bit_length() - 1
        most = np.maximum(runs[k][:, :width], runs[k][:, count - (1 << k) : count - (1 << k) + width])
        np.copyto(best, np.uint8(selector), where=most <= np.uint8(BITS[selector]))
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = values
    bits = _WIDTHS[grid.astype(np.int64)] if grid.max(initial=0) < len(_WIDTHS) else _widths(grid)
    best = _selectors(bits.reshape(blocks, BLOCK))
    sizes = np.full(blocks, BLOCK)
    if n % BLOCK:
        sizes[-1] = n % BLOCK
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    places, chosen, owners = [], [], []
    while len(rows):
        selector = best[rows, at[rows]]
        places.append(rows * BLOCK + at[rows])
        chosen.append(selector)
        owners.append(rows)
        at[rows] += COUNTS[selector]
        rows = rows[at[rows] < sizes[rows]]
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    place, selector, owner = map(np.concatenate, (places, chosen, owners))
    order = np.argsort(place)
    place, selector, owner = place[order], selector[order], owner[order]
    words = selector.astype(np.uint64)
    # Zeros follow each block: values beyond it belong to the next one.
    reach = np.zeros((blocks, BLOCK + 120), np.uint64)
    reach[:, :BLOCK] = grid.reshape(blocks, BLOCK)
    reach = reach.ravel()
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            at = place[mine] + 120 * owner[mine]
            word = np.full(len(mine), s, np.uint64)
            for k in range(int(COUNTS[s])):
                word |= reach[at + k] << np.uint64(k * int(BITS[s]) + 4)
            words[mine] = word
    escaped = np.flatnonzero(selector == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    return words, np.searchsorted(owner, np.arange(blocks)).astype(np.uint32), grid[place[escaped]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`; every selector's words are decoded at once."""
    selector = (words & np.uint64(15)).astype(np.uint8)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    # Each word's values follow those of the word before, also what the last word of a block holds beyond the block.
    at = ends - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            first, word, low = at[mine], words[mine], np.uint64((1 << int(BITS[s])) - 1)
            for k in range(int(COUNTS[s])):
                out[first + k] = (word >> np.uint64(k * int(BITS[s]) + 4)) & low
    escaped = np.flatnonzero(selector == 0)
    out[at[escaped]] = escapes[(words[escaped] >> np.uint64(4)).astype(np.int64)]
    if len(offsets) > 1:
        starts = at[offsets]
        beyond = np.diff(starts) - BLOCK
        kept = np.ones(len(out), bool)
        places = np.repeat(starts[1:] - np.cumsum(beyond), beyond) + np.arange(int(beyond.sum()))
        kept[places] = False
        out = out[kept]
    return out[:n]


def record(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(escapes)], "<u4")
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    present = np.array([x is not None for x in doc_ids], np.uint8)
    parts = (head, keys, present, np.array(counts, "<u4"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


def records(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents' ids, their id counts and all values of each record of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no record at byte {at}")
        docs, ids, words, escapes = (int(x) for x in np.frombuffer(content, "<u4", 4, at + 4))
        at += 20
        fields = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", -(-ids // BLOCK)), ("<u8", words), ("<u8", escapes)):
            fields.append(np.frombuffer(content, kind, n, at))
            at += fields[-1].nbytes
        keys, present, counts, offsets, packed, rest = fields
        yield [int(k) if p else None for k, p in zip(keys, present, strict=True)], counts, unpack(packed, offsets, rest, ids)
        at += 1


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer drops white space before its merges and lower-cases, so a text's ids are those of its parts
    between ASCII white space, one after another. A part is normalised and then split, as the library does; what
    the split does not cover goes to the library whole. Parts and words met before come from bounded caches: a full
    cache is looked through once more while the next one fills.
    """

    KEEP = 600_000
    #: Visible ASCII without capitals, and without the apostrophe, which the split may take into a piece with letters.
    _VISIBLE = re.compile(rb"[!-&(-@\[-~]+")
    _ASCII = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    #: Lower-case letters that normalising leaves alone, then signs.
    _LATIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
    _PLAIN = re.compile("[!-&(-~]+")
    _PIECES = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
    _SIGNED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        # A part that holds a special token is left whole: the library finds them anywhere in a text.
        special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain_letters = not any(s.isalpha() for s in special)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special) if special else b"(?!)")
        # Whether letters and signs after them can hold no special token.
        self.plain_latin = not any(re.fullmatch(r"[^\W\d_]*[!-/:-@\[-`{-~]*", s) for s in special)
        self.letters = "".join(byte_characters())
        self.parts: dict[bytes, bytes] = _Learnt(self._part)
        self.words: dict[str, bytes] = _Learnt(self._word)

    def _split(self, part: str) -> list[str] | None:
        """The pre-tokens of a normalised part where they are plain to see; else None."""
        if self._PLAIN.fullmatch(part):
            return self._PIECES.findall(part)
        signed = self._SIGNED.fullmatch(part)
        return [w for w in signed.groups() if w] if signed and signed[1].isalpha() else None

    def _word(self, word: str | bytes) -> bytes:
        """Ids of one pre-token of normalised text, by the library's merges."""
        plain = codecs.charmap_decode(word if isinstance(word, bytes) else word.encode(), "strict", self.letters)[0]
        return array("I", [t.id for t in self.merge(plain)]).tobytes()

    def _part(self, part: bytes) -> bytes:
        if self.plain_letters and part.isalpha() and part.islower():
            # ASCII letters are one pre-token, in the model's letters as they are.
            return array("I", [t.id for t in self.merge(part.decode())]).tobytes()
        # Pieces of a part are parts with the same ids and kept as such; one piece is a pre-token.
        latin = self._LATIN.fullmatch(part) if self.plain_latin else None
        if latin:
            return self.parts[latin[1]] + self.parts[latin[2]] if latin[2] else self._word(part)
        if self._VISIBLE.fullmatch(part) and not self.special.search(part):
            pieces = self._ASCII.findall(part)
            return b"".join(map(self.parts.__getitem__, pieces)) if len(pieces) > 1 else self._word(part)
        text = part.decode("utf-8", "replace")
        words = None
        lower = text.lower()
        if not self.special.search(lower.encode()):
            words = self._split(lower if text.isascii() else self.tokenizer.normalizer.normalize_str(text))
        if words is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def data(self, text: bytes) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if len(self.parts) > self.KEEP:
            self.parts = _Learnt(self._part, self.parts)
        if len(self.words) > self.KEEP:
            self.words = _Learnt(self._word, self.words)
        parts = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.parts.__getitem__, parts))

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.data(text), np.uint32)


class _Learnt(dict):
    """A cache that asks ``make`` for what neither it nor the full cache before it has."""

    def __init__(self, make, before: dict | None = None):
        self.make, self.before = make, dict(before or ())

    def __missing__(self, key):
        found = self.before.pop(key, None)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def token_ids(docs: DataFrame, definition: str, end_id: int = 1) -> DataFrame:
    """``doc_id, ids``: the ids of each text of ``docs`` and then ``end_id``; ``definition`` is the tokenizer's JSON.

    A null or empty text has the end id alone. Other columns are not read.
    """
    encode = _encoder(docs.sparkSession, definition, end_id)
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, ids array<int>")


def _encoder(spark: SparkSession, definition: str, end_id: int):
    shared = spark.sparkContext.broadcast(definition)
    key = hashlib.sha256(definition.encode()).hexdigest()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = per_worker("word encoder", key, lambda: WordEncoder(shared.value))
        end = np.array([end_id], np.uint32).tobytes()
        found = [encoder.data(t) + end for t in texts_of(batch)]
        ids = list_array(pa.array(np.frombuffer(b"".join(found), np.int32)), [len(x) // 4 for x in found])
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids})

    return encode


def write_token_files(tokens: DataFrame, path: str, definition: str | None = None, end_id: int = 1) -> None:
    """Write ``doc_id, ids`` to Simple-8b files under ``path``, in ascending ``doc_id`` order; null first.

    With a tokenizer ``definition`` the rows are ``doc_id, text``, encoded on the way as by :func:`token_ids`.

    The rows must be ordered within and over partitions. Spark's writer commits the files, so a lost executor
    leaves no half-written file and any file system of the session will do.
    """
    encode = _encoder(tokens.sparkSession, definition, end_id) if definition else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = record(docs, counts, np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64))
            docs.clear()
            counts.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict({"record": pa.array([out], pa.binary())})

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = encode(batch) if encode else batch
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                docs.append(doc)
                parts.append(values[ends[i] : ends[i + 1]])
                counts.append(len(parts[-1]))
                held += len(parts[-1])
                if held >= RECORD_IDS or len(docs) >= RECORD_IDS // 16:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    blocks = tokens.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    blocks.write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``file, place, doc_id, n_tokens`` and ``ids`` of the documents of the files.

    ``place`` is the first id's place in its file. With ``digest``, ``ids_crc32`` stands for ``ids``: the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    kinds = "file string, place long, doc_id long, n_tokens long, "

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, docs, places, counts, values = [], [], [], [], []
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            at = 0
            for keys, sizes, ids in records(content):
                names += [name] * len(keys)
                docs += keys
                places.append(at + np.cumsum(sizes, dtype=np.int64) - sizes)
                counts.append(sizes)
                values.append(ids.astype(np.int64))
                at += len(ids)
        sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        if digest:
            ends = np.cumsum(sizes)
            data = memoryview(flat.astype("<u4")).cast("B")
            last = pa.array([zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64())
        else:
            last = list_array(pa.array(flat), sizes)
        return pa.RecordBatch.from_pydict({
            "file": pa.array(names, pa.string()), "place": pa.array(np.concatenate(places) if places else [], pa.int64()),
            "doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)),
            "ids_crc32" if digest else "ids": last,
        })

    def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield run(batch.slice(i, 1))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(one_by_one, kinds + ("ids_crc32 long" if digest else "ids array<long>"))


def with_starts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids in front of each document, over all files.

    One row per file (tens of MB each) goes through a running sum; documents only meet their file's row.
    """
    # Folder names and the job's UUID may hold the same patterns.
    number = [
        F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)(?:\.[^/]*)?$", 1).cast("long")
    ]
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    order = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))
    return rows.join(firsts, "file").withColumn("start", F.col("before") + F.col("place"))


def tokenizer_definition(path: str | None = None) -> str:
    """A tokenizer file's JSON; by default the public lower-case word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Rows of one doc_id stay apart, in the order of their texts; an empty table gives no rows.
    """
    ws = Workspace(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_token_files(ordered, ws.path("files"), tokenizer_definition())
    rows = ws.stage(read_token_files(spark, ws.path("files"), digest=True), "digests")
    ws.drop("files")
    return with_starts(spark, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
