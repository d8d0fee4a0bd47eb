"""Arrow batches to plain lists, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8; null as empty): as many rows at a time as have about `most` bytes, at least one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()), b"")
        sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start), col.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += int(n) or 1
        yield batch.slice(start), col.slice(start).to_pylist()


def with_columns(rows: pa.RecordBatch, drop: list[str], **new: pa.Array) -> pa.RecordBatch:
    """rows without `drop`, with the new columns behind; a new column replaces one of its name."""
    keep = {n: c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n not in drop and n not in new}
    return pa.RecordBatch.from_arrays([*keep.values(), *new.values()], names=[*keep, *new])


def trim() -> None:
    """Give a worker's freed memory back to the system: workers are reused, and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
