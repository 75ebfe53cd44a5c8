"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Null text: no ids.  An empty text: no ids.  Repeated rows: each encoded alike.  Ids are those of
``Encoding.encode_ordinary``: strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.common import bounded_batches, free_name

#: Characters above which a text is split before it is encoded.
LONG = 1 << 16
_ENCODINGS: dict[str, object] = {}


def load_ranks(path: str) -> bytes:
    """The rank file; its size is fixed by the vocabulary, so it is broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    """tiktoken's Encoding, one for each Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODINGS:
        table = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in ranks.splitlines() if x)}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def _kind(c: str) -> str:
    """L, N or S (symbol) as the pattern tells them apart; else a blank."""
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "S" if k in "PSM" else " "


def _safe(before: str, after: str) -> bool:
    """Whether a match always ends between the two: the pattern has runs of letters, of numbers or of symbols, with a
    space before them, so none goes on from one of these into another or into white space.  Only an apostrophe
    may go with the letters after it.  What a match looks ahead at is white space alone."""
    a, b = _kind(before), _kind(after)
    if a == " " or a == b or (before == "'" and b == "L"):
        return False
    return b != " " or after in " \n\r\t"


def safe_pieces(text: str, longest: int = LONG):
    """Pieces of a long text that together match as the whole does: each ends where ``_safe``.

    A run of one kind (letters, say) is one match of the pattern however long it is, so it is never cut, and a piece
    is longer then; tiktoken takes time in proportion to it.
    """
    at, n = 0, len(text)
    while n - at > longest:
        end = at + longest
        while end < n and not _safe(text[end - 1], text[end]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def encode_one(enc, text: str, longest: int = LONG) -> np.ndarray:
    if len(text) <= longest:
        return np.asarray(enc.encode_ordinary(text), np.int32)
    return np.concatenate([np.asarray(enc.encode_ordinary(x), np.int32) for x in safe_pieces(text, longest)])


def encoder(spark: SparkSession, ranks: bytes, pattern: str, longest: int = LONG):
    """A function of a string column that gives its ids, array<int>."""
    bounded_batches()
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(shared.value, pattern)
        return arrow_text.lists([encode_one(enc, t.decode("utf-8", "replace"), longest) for t in arrow_text.each(texts)], pa.int32())

    return ids


def decoder(spark: SparkSession, ranks: bytes, pattern: str):
    """A function of an ids column that gives the raw bytes, which need not be UTF-8 (an id may hold
    part of a character)."""
    bounded_batches()
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        enc = encoding(shared.value, pattern)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        lengths = np.nan_to_num(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(lengths)
        return pa.array((enc.decode_bytes(flat[b - n : b].tolist()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)), pa.binary(), size=len(lengths))

    return raw


def with_ids(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """df with its ids and with the bytes these give back, under the first free names from ``ids`` and ``decoded``
    on."""
    spark, ids = df.sparkSession, free_name(df, "ids")
    out = df.withColumn(ids, encoder(spark, ranks, pattern)(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(free_name(df, "decoded"), decoder(spark, ranks, pattern)(F.col(ids)))


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
