"""Numeric statistics of whole texts, one Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duewise.llm.common import map_rows, schema_with, texts_of
from duewise.llm.hashing import window_hashes, word_hashes

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "sign": b"#*$%&<>^~=_\\", "bar": b"|", "shout": b"!?", "stop": b".,;:", "quote": b"'\"()[]{}", "dash": b"-/+@",
}
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "line_words", "repeated_lines", "distinct_words", "adjacent_words",
    "top_word", "repeated_windows", *(f"{c}_share" for c in _CLASSES), "wide_share",
)


def statistics(data: bytes) -> list[float]:
    """The statistics of one text, in the order of :data:`STATISTICS`; an empty text has zeros only."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = word_hashes(data)
    n = len(words)
    if not n:
        return [float(np.log1p(len(data)))] + [0.0] * (len(STATISTICS) - 1)
    solid = max(1, len(data) - int(counts[list(b"\t\n\x0b\x0c\r ")].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    _, sizes = np.unique(words, return_counts=True)
    windows = window_hashes(words, 4)
    shares = [float(counts[list(c)].sum()) / solid for c in _CLASSES.values()]
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), solid / n, n / len(lines), 1 - len(set(lines)) / len(lines),
        len(sizes) / n, float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0, float(sizes.max()) / n,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0, *shares, float(counts[128:].sum()) / solid,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` and with its statistics as double columns; a null text counts as empty."""
    kept = docs.drop("text", *STATISTICS)
    names = kept.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([statistics(t) for t in texts_of(batch)])
        columns = [pa.array(values[:, k]) for k in range(len(STATISTICS))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *STATISTICS])

    schema = schema_with(kept, **{n: T.DoubleType() for n in STATISTICS})
    return map_rows(docs.select(*names, "text"), run, schema)
