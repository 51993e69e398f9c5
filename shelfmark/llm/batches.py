"""Arrow batches in small pieces: what a Python worker holds at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 400


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows`` rows, without a copy.

    Spark bounds its batches by bytes; the Python objects made of a piece, and the piece of the
    result, are then bounded by a small part of that. Freed Arrow memory is given back at once, as
    workers are kept for later tasks.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
