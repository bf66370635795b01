"""Small helpers for operators that run in Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE_CHARS = 1 << 20


def strings(column: pa.Array) -> list[str]:
    """Values of a text column; null counts as the empty text."""
    return ["" if value is None else value for value in column.to_pylist()]


def pieces(batch: pa.RecordBatch, text: str, most_chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about `most_chars` characters each (a longer row is alone in its slice)."""
    sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()]
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most_chars:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
