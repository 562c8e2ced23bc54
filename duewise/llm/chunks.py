"""Arrow batches cut by bytes, so that working memory does not follow the number of rows in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most ``limit`` bytes of ``column`` each, or of one row."""
    data = batch.column(column)
    sizes = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(sizes, sizes[first] + limit, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end


class Tally:
    """Sums of counts by key that are handed on whenever ``room`` distinct keys are held: a map-side combine."""

    def __init__(self, room: int = 400_000):
        self.room, self.held = room, {}

    def add(self, counts: dict) -> dict | None:
        held = self.held
        if not held:
            self.held = held = dict(counts)
        else:
            for key, n in counts.items():
                held[key] = held.get(key, 0) + n
        return self.take() if len(held) >= self.room else None

    def take(self) -> dict:
        out, self.held = self.held, {}
        return out
