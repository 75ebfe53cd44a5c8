"""Media columns: payloads stored as progressive JPEG files, read back and decoded to RGB tensors.

Null and empty texts are stored as 64 zero bytes; equal texts give equal files and equal tensors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.llm import arrow_text, jpeg
from docquarry.llm.common import bounded_batches

IMAGE = "struct<payload: binary, n_bytes: long, height: int, width: int, rgb: binary, mean: array<double>>"


def _chunks(items, most: int = jpeg.CHUNK):
    """Lists of byte strings of about ``most`` bytes; a larger one stands alone."""
    own, size = [], 0
    for x in items:
        if own and size + len(x) > most:
            yield own
            own, size = [], 0
        own.append(x)
        size += max(64, len(x))
    if own:
        yield own


def stored(text: Column) -> Column:
    """A progressive JPEG file that holds the UTF-8 bytes of each text."""
    bounded_batches()

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return _joined((pa.array(jpeg.encode(part), pa.binary()) for part in _chunks(arrow_text.each(texts))), pa.binary())

    return encode(F.coalesce(text, F.lit("")))


_IMAGE = pa.struct([("payload", pa.binary()), ("n_bytes", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("mean", pa.list_(pa.float64()))])


def _joined(parts, kind: pa.DataType) -> pa.Array:
    """One array of the parts; each part's Python objects are gone before the next is made."""
    own = list(parts)
    return pa.concat_arrays(own) if own else pa.array([], kind)


def _images(files: list[bytes]) -> pa.Array:
    frames, planes, coefs = jpeg.coefficients(files)
    held, pixels = jpeg.payloads(frames, planes, coefs), jpeg.rgb(frames, planes, coefs)
    means = [(x.reshape(-1, 3).sum(axis=0, dtype=np.int64) / max(1, x.shape[0] * x.shape[1])).tolist() for x in pixels]
    columns = [held, [f.n_bytes for f in frames], [f.height for f in frames], [f.width for f in frames], [x.tobytes() for x in pixels], means]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _IMAGE, strict=True)], fields=list(_IMAGE))


def image(media: Column) -> Column:
    """What a JPEG file holds: its payload (padded as stored), the bytes before padding, and the tensor
    of 8-bit RGB in rows from the top, with the mean of each channel.  A null file gives nulls."""
    bounded_batches()

    @F.arrow_udf(IMAGE)
    def decode(files: pa.Array) -> pa.Array:
        there = files.is_valid()
        out = _joined((_images(part) for part in _chunks(arrow_text.each(files.filter(there)))), _IMAGE)
        if len(out) == len(files):
            return out
        rows = np.cumsum(np.asarray(there)) - 1
        return out.take(pa.array(rows, pa.int64(), mask=~np.asarray(there)))

    return decode(media)
