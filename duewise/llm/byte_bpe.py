"""Byte-level BPE by a sentencepiece model built from a rank file.

The model is written in sentencepiece's wire format straight from the vocabulary: each byte becomes one
printable character, a piece's score is its negative rank, the normaliser is the identity. Pre-tokens are
encoded one by one, so that no merge crosses them; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from duewise.llm.chunks import by_bytes
from duewise.llm.common import list_array, map_rows, per_worker, schema_with, table
from duewise.llm.registry import query

#: White space of Unicode, which the pre-token pattern means by ``\\s``.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 stands for itself, the rest follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece, never used, comes last."""
    letters = byte_characters()
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = [
        _field(1, _field(1, "".join(letters[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for piece, rank in pieces
    ]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    # Trainer fields 3 model type (2: BPE), 4 size, 40-43 special ids; normaliser fields 1 name,
    # 3 dummy prefix, 4 extra white space, 5 escaped white space.
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encode and decode whole texts as the rank file says.

    A unit is a run of non-white characters with at most one space in front, or a run of white space; no
    pre-token crosses a unit's end, so units met before come from a bounded cache.
    """

    #: Bytes that the cache may take, and units of a text between two looks at it.
    KEEP_BYTES, BLOCK_UNITS = 64 << 20, 1 << 15

    def __init__(self, rank_file: bytes, pattern: str):
        import re

        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.letters = {chr(b): c for b, c in enumerate(byte_characters())}
        self.table = str.maketrans(self.letters)
        self.tokens = regex.compile(pattern)
        self.units = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pieces = [piece for piece, _ in sorted(self.ranks.items(), key=lambda x: x[1])]

    def _characters(self, token: str) -> str:
        return token.encode("utf-8").decode("latin-1").translate(self.table)

    def _learn(self, new: list[str]) -> None:
        split = [self.tokens.findall(unit) for unit in new]
        flat = list({t for tokens in split for t in tokens})
        got = self.processor.encode([self._characters(t) for t in flat], out_type=int, num_threads=1)
        # A pre-token that is itself a piece has that piece's rank, whatever the merges would give.
        coded = {t: [whole] if (whole := self.ranks.get(t.encode())) is not None else ids for t, ids in zip(flat, got, strict=True)}
        for unit, tokens in zip(new, split, strict=True):
            self.known[unit] = ids = np.array([i for t in tokens for i in coded[t]], "<u4").tobytes()
            # Characters take four bytes at most; an entry and its two objects take about 200 more.
            self.held += 4 * len(unit) + len(ids) + 200

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        units, out = (m[0] for m in self.units.finditer(text)), []
        while parts := list(islice(units, self.BLOCK_UNITS)):
            if new := list({x for x in parts if x not in self.known}):
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, parts)))
            if self.held > self.KEEP_BYTES:
                self.known.clear()
                self.held = 0
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _worker(spark: SparkSession, rank_file: bytes, pattern: str):
    """A function that gives each Python worker its own model, from one broadcast of the vocabulary file."""
    shared = spark.sparkContext.broadcast((rank_file, pattern))
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    return lambda: per_worker("byte bpe", key, lambda: ByteBpe(*shared.value))


def bpe_encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``, the ids of each text; all other columns stay. A null or empty text has no ids."""
    get = _worker(docs.sparkSession, rank_file, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = [get().encode(t or "") for t in batch.column(text).to_pylist()]
        ids = pa.array(np.frombuffer(b"".join(coded), np.uint32).astype(np.int32))
        lists = list_array(ids, [len(x) // 4 for x in coded])
        kept = [n for n in batch.schema.names if n != into]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), lists], names=[*kept, into])

    kept = docs.drop(into)
    return map_rows(kept, run, schema_with(kept, **{into: T.ArrayType(T.IntegerType())}))


def bpe_decode(coded: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the bytes that the ids stand for; all other columns stay. Null has no bytes."""
    get = _worker(coded.sparkSession, rank_file, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(ids)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = [get().decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [n for n in batch.schema.names if n != into]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.binary())], names=[*kept, into])

    kept = coded.drop(into)
    return map_rows(kept, run, schema_with(kept, **{into: T.BinaryType()}))


def bpe_round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` in place of ``text``, and the ids as ``ids`` if that is named.

    One pass: each text is encoded, its ids are decoded again and both are digested by one worker, in parts of bounded
    bytes. All other columns stay. A null or empty text has no ids.
    """
    get = _worker(docs.sparkSession, rank_file, pattern)
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if ids:
        added[ids] = T.ArrayType(T.IntegerType())
    kept = docs.drop(text, *added)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text):
                coder, coded, sums = get(), [], []
                for t in part.column(text).to_pylist():
                    data = coder.encode(t or "")
                    sums.append((hashlib.sha256(data).hexdigest(), hashlib.sha256(coder.decode(np.frombuffer(data, "<u4"))).hexdigest()))
                    coded.append(data if ids else len(data) // 4)
                lengths = [len(x) // 4 for x in coded] if ids else coded
                arrays = [*(part.column(n) for n in names), pa.array(lengths, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*sums, strict=True))]
                if ids:
                    arrays.append(list_array(pa.array(np.frombuffer(b"".join(coded), np.uint32).astype(np.int32)), lengths))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    return docs.select(*names, text).mapInArrow(run, schema_with(kept, **added))


def id_digests(coded: DataFrame) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` in place of ``ids`` and ``decoded``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sums = [hashlib.sha256(values[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [n for n in batch.schema.names if n not in ("ids", "decoded")]
        arrays = [*(batch.column(n) for n in kept), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.string())]
        arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = coded.drop("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    schema = schema_with(kept, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())
    return map_rows(coded.select(*kept.columns, "ids", "decoded"), run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A public rank file and the pattern of its pre-tokens."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are decoded after encoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, *public_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
