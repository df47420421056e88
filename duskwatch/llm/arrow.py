"""Batches that stay in Arrow, where a column of whole numbers with nulls keeps every digit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters of the texts that a task works on at a time.
LIMIT = 1 << 20


def parts(batch: pa.RecordBatch, limit: int = LIMIT) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of about ``limit`` characters, at least one row each, with their texts, column ``_text``."""
    lengths = pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate([*lengths.tolist(), limit + 1]):
        if i > begin and size + n > limit:
            part = batch.slice(begin, i - begin)
            yield part, part.column("_text").to_pylist()
            begin, size = i, 0
        size += n


def beside(part: pa.RecordBatch, drop: tuple[str, ...], **columns: pa.Array) -> pa.RecordBatch:
    """The columns of ``part`` but for those in ``drop``, as they are, and further ones."""
    names = [c for c in part.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns.values()], names=[*names, *columns])
