"""Reading Arrow batches inside tasks without making Python strings of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def values(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each value of a string or binary column; null is empty."""
    if not len(column):
        return
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield b"" if nulls and nulls[i] else bytes(view[at[i] : at[i + 1]])


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def packed(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers that end at ``ends`` (0 first) as binary values, which Spark moves without a look at each number."""
    offsets = pa.py_buffer(np.ascontiguousarray(4 * np.asarray(ends), np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(flat, np.int32))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers end to end, how many each value has) of a column made by packed()."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    big = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat).view(np.int32), np.diff(at) // 4


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by keys, cut anew so that no run of equal keys is divided between two of them.

    A run longer than a batch is gathered whole; callers bound their runs.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [numbers(batch.column(k)) for k in keys]
        first = tuple(c[0] for c in columns)
        if held and tuple(numbers(held[-1].column(k))[-1] for k in keys) != first:
            yield join(held)
            held = []
        same = np.ones(batch.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield join([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield join(held)


def join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
