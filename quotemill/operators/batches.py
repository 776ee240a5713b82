"""Arrow batches in tasks, cut small so that what a task holds does not grow with the table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes at once, about; a longer row is alone.
MOST_BYTES = 1 << 20


def small(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ``most`` bytes of the text ``columns``."""
    for batch in batches:
        sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns]
        start = held = 0
        for i, size in enumerate(map(sum, zip(*sizes, strict=True))):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
