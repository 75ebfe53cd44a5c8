"""SimHash fingerprints, their near pairs by pivot distance tables, and the groups these make.

Fingerprint: A-Z lower-cased, words split at ASCII white space, ``shingle``-word shingles joined by one
space (fewer words: the whole sequence), each hashed by XXH64 with seed 42; a bit is set if it is set
in over half of the hashes.  A null or empty text has fingerprint 0, linked like any other.

Pairs.  Distinct fingerprints only.  Two that differ in at most b bits agree in at least two of b + 2
blocks of bits, so they meet under at least one of (b + 2)(b + 1) / 2 keys made of two blocks (``EQUAL``;
three of b + 3 make longer keys, and more of them, for tens of billions of texts).  Within a key, the pivot table (the distance of each fingerprint to fixed reference fingerprints, computed once)
discards every pair whose distances to some reference differ by more than b: by the triangle
inequality such a pair is farther apart than b.  Survivors are verified bit by bit.  Nothing is lost.

A key with more fingerprints than ``CHUNK`` is dealt out as pairs of chunks, so no task holds more than
two chunks of it.  A task gives the links of a spanning forest of what it verified, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.components import components
from docquarry.llm.common import bounded_batches, free_name, written

SEED, SHINGLE, BITS, EQUAL, PIVOTS, CHUNK = 42, 3, 3, 2, 16, 1024
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
BLOCK = 1 << 16
_PLACES = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """As an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), SEED)
    n, counts = len(words) - shingle + 1, np.zeros((8, 8), np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        hashes = np.array([h(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)), strict=False)], np.uint64)
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048)
        counts += seen.reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Column of fingerprints, as signed longs."""
    bounded_batches()

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        known: dict[bytes, int] = {}
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(arrow_text.each(texts)):
            if t not in known:
                known[t] = fingerprint(t, shingle)
            out[i] = known[t]
        return pa.array(out.view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def references(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints: hashes of their own numbers, as signed longs."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64).view(np.int64).tolist()


def pivot_table(fps: DataFrame, fp: str = "fp", pivots: int = PIVOTS) -> DataFrame:
    """fps with its distances to the references, eight to a long (a byte each)."""
    refs = references(pivots)
    for k in range(0, pivots, 8):
        packed = F.lit(0).cast("long")
        for i, ref in enumerate(refs[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(ref))).cast("long"), 8 * i))
        fps = fps.withColumn(f"pivots{k // 8}", packed)
    return fps


def block_masks(bits: int = BITS, equal: int = EQUAL) -> list[int]:
    """Masks of ``equal`` blocks each, of bits + equal, as signed longs."""
    edges = np.linspace(0, 64, bits + equal + 1).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(blocks, equal))]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def _links(fp: np.ndarray, group: np.ndarray, tables: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, a linked fingerprint) that join what is near within the groups; rows of a group
    stand together."""
    n, left, right = len(fp), [], []
    rows, shift = np.arange(n), 1
    while True:
        rows = rows[rows + shift < n]
        rows = rows[group[rows] == group[rows + shift]]
        if not len(rows):
            break
        a, b = rows, rows + shift
        for k in range(0, tables.shape[1], 4):
            near = (np.abs(tables[a, k : k + 4] - tables[b, k : k + 4]) <= bits).all(axis=1)
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        left.append(a[near])
        right.append(b[near])
        shift += 1
    if not left:
        return fp[:0], fp[:0]
    label = _forest(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _linker(bits: int, tables: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
            fp = t["fp"].to_numpy().astype(np.int64).view(np.uint64)
            packed = np.stack([t[c].to_numpy().astype(np.int64) for c in tables], axis=1)
            a, b = _links(fp, t["bucket"].to_numpy(), packed.view(np.uint8).reshape(len(fp), -1).astype(np.int16), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            bucket = t["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield from give(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from give(rest)

    return run


def near_links(fps: DataFrame, bits: int = BITS, pivots: int = PIVOTS, chunk: int = CHUNK, equal: int = EQUAL) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``fps.fp`` just as all pairs within ``bits``
    differing bits do."""
    bounded_batches()
    table = pivot_table(fps.select("fp"), pivots=pivots)
    tables = [c for c in table.columns if c != "fp"]
    keys = table.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(block_masks(bits, equal))))).alias("key")).select("fp", *tables, "key.combo", "key.part")
    large = written(keys.groupBy("combo", "part").count().where(F.col("count") > chunk).select("combo", "part", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "simhash-large")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    dealt = (
        keys.join(large, ["combo", "part"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    bucket = F.xxhash64("combo", "part", F.least("own", "other"), F.greatest("own", "other"))  # equal hashes of two buckets only add pairs to verify
    return (
        dealt.select(bucket.alias("bucket"), "fp", *tables)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_linker(bits, tables), "a long, b long")
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component): the fingerprint of each row and the least id that it reaches over links of
    at most ``bits`` differing bits.

    Rows without an id take part in links; their component is the least id of those that have one, or
    null.  Repeated ids stay repeated.  An empty table gives an empty result.
    """
    base = written(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text), shingle).alias("fp")), "simhash-base")
    least = written(base.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(written(near_links(least, bits), "simhash-links"))
    node = free_name(base, "node")
    joined = least.join(roots.withColumnRenamed("node", node), F.col("fp") == F.col(node), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "simhash-roots")
    own = joined.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = joined.join(own, "root").select("fp", "component")
    return base.join(of_fp, "fp").select("id", "fp", "component")
