"""Questions about values that lie anywhere in the corpus, asked and answered in packed form.

Rows are packed into chunks (their columns, compressed, as one binary). A chunk asks about its distinct values, once each, however
often it has them; values are 64-bit numbers, and each bucket owns a range of them. All that was asked of a bucket meets in one group, which
is as large as its range, not as any value is frequent. The answers go back to the chunks that asked. What moves
is packed: sorted values are kept as differences, byte by byte, which Spark's own compression then shrinks.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import trim
from tallyloom.session import ship
from tallyloom.storage import Workspace

#: Text to a chunk, at least; a corpus of over CHUNKS times that has larger ones, up to MOST_BYTES.
LEAST_BYTES, CHUNKS, MOST_BYTES = 4 << 20, 8000, 64 << 20
#: Text to a bucket, about.
BUCKET_BYTES = 6 << 20
_CODEC = pa.Codec("zstd", 1)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_batch(batch)
    return out.getvalue()


def unpack_batch(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data) if isinstance(data, bytes) else data).read_all()


def put_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as their differences, byte plane by byte plane."""
    if not len(values):
        return b""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, 8 - int((~planes.any(axis=0)[::-1]).argmin())) if planes.any() else 1
    return _press(width, planes[:, :width].T.tobytes())


def _press(width: int, data: bytes) -> bytes:
    """Compressed if that is shorter: the upper planes are, by their frequencies, which Spark's codec doesn't use."""
    small = _CODEC.compress(data, asbytes=True) if len(data) > 64 else data
    return bytes([width]) + data if len(small) >= len(data) else bytes([width | 128]) + len(data).to_bytes(4, "little") + small


def press(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unpress(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(data: bytes) -> tuple[int, np.ndarray]:
    width = data[0] & 127
    raw = _CODEC.decompress(data[5:], int.from_bytes(data[1:5], "little"), asbytes=True) if data[0] & 128 else data[1:]
    return width, np.frombuffer(raw, np.uint8).reshape(width, -1)


def get_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width, planes = _planes(data)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def put_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers, as many bytes each as the largest needs, byte plane by byte plane."""
    v = values.astype("<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return _press(width, v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def get_numbers(data: bytes) -> np.ndarray:
    width, planes = _planes(data)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


class Chunks:
    """docs packed into chunks in shared storage: frame (chunk, blob), with the corpus's bytes and number of buckets."""

    def __init__(self, docs: DataFrame, name: str, text_col: str = "text", marks: Callable[[pa.RecordBatch], dict[bytes, bytes]] | None = None, least_bytes: int | None = None):
        """marks: what is to be kept with a chunk, made from its rows once (see the table's schema.metadata). least_bytes: text to a chunk, at least."""
        self.spark = docs.sparkSession
        ship(self.spark)
        self.ws = Workspace(self.spark, name)
        self.bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.chunk_bytes = min(MOST_BYTES, max(least_bytes or LEAST_BYTES, self.bytes // CHUNKS))
        self.buckets = max(64, self.bytes // BUCKET_BYTES)
        most, at = self.chunk_bytes, docs.columns.index(text_col)

        def pack(batches):
            held, size, n = [], 0, 0

            def out():
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                rows = rows.replace_schema_metadata(marks(rows)) if marks else rows
                return pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{n}"]), pa.array([pack_batch(rows)], pa.binary())], names=["chunk", "blob"])

            for batch in batches:
                for start, stop in _cuts(batch, at, most - size, most):
                    part = batch.slice(start, stop - start)
                    held.append(part)
                    size += pc.sum(pc.binary_length(part.column(at))).as_py() or 0
                    if size >= most:
                        yield out()
                        held, size, n = [], 0, n + 1
            if held:
                yield out()

        self.frame = self.ws.cut(docs.mapInArrow(pack, "chunk string, blob binary"))

    def ask(self, explode: Callable[[pa.Table, dict], Iterator[tuple[int, np.ndarray, np.ndarray]]], answer: Callable, heard: DataFrame | None = None, by_place: bool = False) -> DataFrame:
        """Answers (chunk, kind, bucket, keys, values) to every chunk's questions.

        explode: the rows of a chunk, and the earlier answers `heard` (as for `hear`) -> (kind, ascending distinct keys, values
        >= 0) for each kind of question. answer: (kind, the askers' keys and values as two lists) -> for each asker the positions
        of the keys that get an answer, and the answers (>= 0). by_place: answers name keys by their place among those asked,
        a bit each, for chunks that can make the same keys again (see Places).
        """
        buckets = self.buckets

        def rows_of(chunk: str, table: pa.Table, got: dict) -> list[tuple]:
            out = []
            for kind, keys, values in explode(table, got):
                for b, a, z in stretches(keys, buckets):
                    out.append((b, kind, chunk, put_sorted(keys[a:z]), put_numbers(values[a:z])))
            return out

        names, schema = ["bucket", "kind", "chunk", "keys", "values"], "bucket int, kind int, chunk string, keys binary, values binary"

        def asked(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = rows_of(batch.column(0)[i].as_py(), unpack_batch(batch.column(1)[i].as_buffer()), {})
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=names)
                    del rows
                    trim()

        def asked_after(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            known = heard_of(got)
            rows = [r for chunk, blob in zip(own["chunk"], own["blob"], strict=True) for r in rows_of(chunk, unpack_batch(blob), known)]
            trim()
            return pd.DataFrame(rows, columns=names)

        def answered(pdf: pd.DataFrame) -> pd.DataFrame:
            out, bucket = [], int(pdf["bucket"].iloc[0])
            for kind, part in pdf.groupby("kind"):
                keys, values = [get_sorted(k) for k in part["keys"]], [get_numbers(v) for v in part["values"]]
                for chunk, k, (at, reply) in zip(part["chunk"], keys, answer(kind, keys, values), strict=True):
                    if len(at):
                        told = put_bits(at, len(k)) if by_place else put_sorted(k[at])
                        out.append((chunk, kind, bucket, told, put_numbers(reply)))
                del keys, values
            trim()
            return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "keys", "values"])

        if heard is None:
            rows = self.frame.mapInArrow(asked, schema)
        else:
            rows = self.frame.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInPandas(asked_after, schema)
        return rows.groupBy("bucket").applyInPandas(answered, "chunk string, kind int, bucket int, keys binary, values binary")

    def hear(self, answers: DataFrame, read: Callable[[pa.Table, dict[int, tuple[np.ndarray, np.ndarray]]], pd.DataFrame], schema: str) -> DataFrame:
        """read(rows of a chunk, {kind: (ascending keys, answers)}) for every chunk, those without answers too."""

        def both(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            known = heard_of(got)
            out = pd.concat([read(unpack_batch(blob), known) for blob in own["blob"]]) if len(own) else empty
            trim()
            return out

        names = [x.split()[0] for x in schema.split(",")]
        empty = pd.DataFrame(columns=names)
        return self.frame.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(both, schema)


def stretches(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, behind last) of the ascending keys that each bucket owns, for the buckets that own any: a bucket is an
    equal part of all 64-bit numbers, so that a task needs no list of them."""
    if not len(keys):
        return []
    own = keys // np.uint64(-(-(1 << 64) // buckets))
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def put_bits(at: np.ndarray, n: int) -> bytes:
    bits = np.zeros(n, bool)
    bits[at] = True
    return b"\0" + np.packbits(bits).tobytes()


class Places:
    """Answers of one kind that name keys by place: on(keys) gives the answers to the keys that were asked, 0 where there is none."""

    def __init__(self, part: pd.DataFrame):
        self.rows = list(zip(part["bucket"], part["keys"], part["values"], strict=True))

    def on(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        place = {b: (a, z) for b, a, z in stretches(keys, buckets)}
        out = np.zeros(len(keys), np.int64)
        for b, bits, values in self.rows:
            a, z = place[b]
            out[a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, offset=1), count=z - a))] = get_numbers(values)
        return out


def heard_of(got: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray] | Places]:
    """A chunk's answers by kind: (ascending keys, answers), or Places."""
    out = {}
    for kind, part in got.groupby("kind"):
        if part["keys"].iloc[0][:1] == b"\0":
            out[int(kind)] = Places(part)
            continue
        keys, values = np.concatenate([get_sorted(k) for k in part["keys"]]), np.concatenate([get_numbers(v) for v in part["values"]])
        order = np.argsort(keys)
        out[int(kind)] = (keys[order], values[order])
    return out


def _cuts(batch: pa.RecordBatch, at: int, first: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `first`, then `most` bytes of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, room = 0, first
    for i, n in enumerate(sizes.tolist()):
        room -= n
        if room <= 0:
            yield start, i + 1
            start, room = i + 1, most
    if start < batch.num_rows:
        yield start, batch.num_rows


def look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None, missing: int = 0) -> np.ndarray:
    """The answers to keys, `missing` where there is none."""
    if table is None or not len(table[0]):
        return np.full(len(keys), missing, np.int64)
    known, values = table
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)
