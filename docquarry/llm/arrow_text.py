"""Texts of an Arrow batch as bytes, without a Python string for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, n + 1 offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    big = texts.cast(pa.large_binary())
    n = len(big)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = big.buffers()
    at = np.frombuffer(offsets, np.int64)[big.offset : big.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def each(texts: pa.Array):
    """The bytes of one text after another."""
    data, at = utf8(texts)
    view = memoryview(data)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list for each array."""
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    if at[-1] > 2**31 - 1:
        raise ValueError("a batch of over 2^31 list items; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat).cast(kind))
