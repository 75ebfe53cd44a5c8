"""Exact nearest neighbours by matrix products of blocks.

Vectors are packed: a row holds the ids of many vectors and their unit vectors one after another.  A stated set of
questions meets all vectors as pairs of packed rows, a matrix product each.  Packed vectors are dealt into a fixed number
of buckets and the packed questions go to each, so no task has all of them; what a task keeps is the k best of a question so far
(``_Best``), no more than ``HELD`` rows of all questions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.shared import bounded_batches

#: Vectors of a packed row.
PACK = 1024
#: Buckets of all vectors; buckets of each list where both sides have lists; rows and bytes that a task holds.
BUCKETS, LIST_BUCKETS, HELD, HELD_BYTES = 32, 4, 4_000_000, 32 << 20


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each length among vectors without nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.nan_to_num(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        whole = ~np.isnan(x).any(axis=1)
        yield rows[whole], x[whole]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def packed(df: DataFrame, id_col: str, vector: str, prefix: str, pack: int = PACK) -> DataFrame:
    """(prefix_ids, prefix_dim, prefix_matrix): rows of at most ``pack`` unit vectors of one length.  Vectors that are
    null or hold a null are in none."""
    bounded_batches()
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch["vector"]):
                for at in range(0, len(rows), pack):
                    ids = batch["id"].take(pa.array(rows[at : at + pack]))
                    one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([one, pa.array([x.shape[1]], pa.int32()), pa.array([unit(x[at : at + pack]).tobytes()], pa.binary())], [f"{prefix}_ids", f"{prefix}_dim", f"{prefix}_matrix"])

    return df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).mapInArrow(run, f"{prefix}_ids array<{kind}>, {prefix}_dim int, {prefix}_matrix binary")


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, and of what equals the last of them."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        return np.nonzero(scores >= least)
    return np.nonzero(np.ones(scores.shape, bool))


def packs(df: DataFrame, id_col: str, prefix: str, group: str | None = None, also: str | None = None) -> DataFrame:
    """(prefix_no, prefix_group, prefix_ids, prefix_also, prefix_dim, prefix_matrix) of df (id_col, vector): as ``packed``, by id, each row
    with vectors of one value of ``group`` (null is one), their values of ``also``, and a number of its own."""
    bounded_batches()
    kinds, pack = dict(df.dtypes), PACK
    own = [df[id_col].alias("id"), df["vector"].alias("vector"), (F.col(group) if group else F.lit(0)).alias("g"), (F.col(also) if also else F.lit(0)).alias("a")]
    names = [f"{prefix}_{n}" for n in ("no", "group", "ids", "also", "dim", "matrix")]
    g_kind, a_kind = kinds.get(group, "int"), kinds.get(also, "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, values = TaskContext.get().partitionId() << 32, {}, {}

        def rows(key: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal number
            dim, ids, also_, x = key[0], *(f([p[i] for p in held[key]]) for i, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate)))
            del held[key]
            order = pc.sort_indices(ids)
            ids, also_, x = ids.take(order), also_.take(order), x[order.to_numpy()]
            for at in range(0, len(ids), pack):
                one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids[at : at + pack], also_[at : at + pack])]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), values[key[1]], *one, pa.array([dim], pa.int32()), pa.array([x[at : at + pack].tobytes()], pa.binary())], names)
                number += 1

        for batch in batches:
            code = pc.dictionary_encode(batch["g"], null_encoding="encode")
            codes = code.indices.to_numpy(zero_copy_only=False)
            for found, x in matrices(batch["vector"]):
                for c in np.unique(codes[found]).tolist():
                    mine = codes[found] == c
                    value = code.dictionary.slice(c, 1)
                    key = (x.shape[1], value[0].as_py())
                    values[key[1]] = value
                    at = pa.array(found[mine])
                    held.setdefault(key, []).append((batch["id"].take(at), batch["a"].take(at), unit(x[mine])))
                    if sum(len(p[0]) for p in held[key]) >= pack:
                        yield from rows(key)
            if sum(p[2].nbytes for parts in held.values() for p in parts) > HELD_BYTES:
                for key in list(held):
                    yield from rows(key)
        for key in list(held):
            yield from rows(key)

    return df.select(*own).mapInArrow(run, f"{names[0]} long, {names[1]} {g_kind}, {names[2]} array<{kinds[id_col]}>, {names[3]} array<{a_kind}>, {names[4]} int, {names[5]} binary")


def met(questions: DataFrame, chunks: DataFrame, lists: bool = False) -> DataFrame:
    """Pairs of packs (of prefixes q and c) whose vectors have one length and, with ``lists``, one group."""
    n = LIST_BUCKETS if lists else BUCKETS
    q = questions.withColumn("q_bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("merge")
    on = (F.col("q_dim") == F.col("c_dim")) & (F.col("q_bucket") == F.pmod(F.xxhash64("c_no"), F.lit(n)).cast("int"))
    return q.join(chunks, on & (F.col("q_group") == F.col("c_group")) if lists else on)


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, cosines to nine decimals) of pairs of packs."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, c = (np.frombuffer(batch[f"{x}_matrix"][i].as_buffer(), np.float64).reshape(-1, batch["q_dim"][i].as_py()) for x in "qc")
            yield batch, i, np.round(q @ c.T, 9)


class _Best:
    """The k best (score, then id) of each question of a pack so far, and what may still be among them."""

    def __init__(self, q_ids: pa.Array, k: int):
        self.q_ids, self.k, self.least, self.parts, self.n = q_ids, k, np.full(len(q_ids), -np.inf), [], 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        bar, k = self.least, self.k
        scores = np.where(np.isnan(scores), -np.inf, scores) if np.isnan(scores).any() else scores
        if scores.shape[1] > k and np.isinf(bar).any():
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
        mask = (scores >= bar[:, None]) & (scores > -np.inf)
        if np.count_nonzero(mask) > 4 * k * len(bar):  # many ties: columns are in order of ids
            tie = mask & (scores == bar[:, None])
            mask &= ~tie | (np.cumsum(tie, axis=1) <= k)
        a, b = np.nonzero(mask)
        if len(a):
            self.parts.append((a, scores[a, b], ids.take(pa.array(b))))
            self.n += len(a)
            if np.isinf(self.least).any() or self.n > 3 * k * len(bar):
                self.compact()

    def compact(self) -> None:
        a, s = (np.concatenate([p[i] for p in self.parts]) for i in range(2))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        order = pc.sort_indices(pa.table({"a": a, "s": -s, "id": ids}), sort_keys=[("a", "ascending"), ("s", "ascending"), ("id", "ascending")]).to_numpy()
        a = a[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        last = place == self.k - 1
        self.least[a[last]] = s[order][last]
        kept = order[place < self.k]
        self.parts, self.n = [(a[place < self.k], s[kept], ids.take(pa.array(kept)))], len(kept)

    def rows(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        self.compact()
        a, s, ids = self.parts[0]
        return self.q_ids.take(pa.array(a)), ids, pa.array(s)


def _but_self(scores: np.ndarray, q_ids: pa.Array, c_ids: pa.Array) -> np.ndarray:
    """scores, those of rows and columns of one id being no scores."""
    own = np.flatnonzero(pc.is_in(c_ids, value_set=q_ids).to_numpy(zero_copy_only=False))
    if len(own):
        rows, columns = (np.array(ids.to_pylist(), object) for ids in (q_ids, c_ids.take(pa.array(own))))
        scores[:, own] = np.where(np.equal.outer(rows, columns), -np.inf, scores[:, own])
    return scores


def nearest(questions: DataFrame, chunks: DataFrame, k: int, by: str | None = None, lists: bool = False, others: bool = False) -> DataFrame:
    """(qid, chunk_id, score) of questions (qid, vector) and chunks (chunk_id, vector): a superset of the k chunks of
    greatest cosine of each question, those of every bucket; ties go by id.  With ``by``, a column of chunks, those of
    each of its values, which is a column of the result too; with ``lists`` only rows of equal ``list`` meet."""
    kinds = dict(questions.dtypes) | dict(chunks.dtypes)
    group = "list" if lists else None
    pairs = met(packs(questions, "qid", "q", group), packs(chunks, "chunk_id", "c", group or by), lists)
    out = ["qid", "chunk_id", "score"] + ([by] if by else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, _Best] = {}
        kind = None

        def rows() -> Iterator[pa.RecordBatch]:
            for key, best_ in found.items():
                if best_.parts:
                    own = best_.rows()
                    more = [pa.repeat(pa.scalar(key[1], kind), len(own[0]))] if by else []
                    yield pa.RecordBatch.from_arrays([*own, *more], out)
            found.clear()

        for batch, i, scores in products(batches):
            kind = batch["c_group"].type
            key = batch["q_no"][i].as_py(), batch["c_group"][i].as_py()
            if key not in found:
                if sum(max(b.n, len(b.q_ids)) for b in found.values()) > HELD:
                    yield from rows()
                found[key] = _Best(batch["q_ids"][i].values, k)
            ids = batch["c_ids"][i].values
            found[key].add(_but_self(scores, found[key].q_ids, ids) if others else scores, ids)
        yield from rows()

    more = f", {by} {kinds[by]}" if by else ""
    return pairs.select("q_no", "q_ids", "q_dim", "q_matrix", "c_group", "c_ids", "c_matrix").mapInArrow(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double{more}")


def _level_masks(batch: pa.RecordBatch, i: int, scores: np.ndarray, levels: Sequence[tuple[float, bool]]) -> Iterator[np.ndarray]:
    """Pairs of packs i that are in each level (least score, whether groups must be equal)."""
    group = batch["c_group"][i]
    wanted = batch["q_also"][i].values
    same = np.zeros(len(wanted), bool) if not group.is_valid else pc.fill_null(pc.equal(wanted, group), False).to_numpy(zero_copy_only=False)
    for least, own in levels:
        yield (scores > least) & same[:, None] if own else scores > least


def first_level(questions: DataFrame, chunks: DataFrame, levels: Sequence[tuple[float, bool]], by: str, wanted: str, enough: int = 6, real: int = 2, real_above: float = 0.25) -> DataFrame:
    """(qid, level, chunk_id): as ``retrieval.first_healthy`` of levels that take scores above a bound, of chunks of any ``by`` or only
    of the question's ``wanted`` one; hits above ``real_above`` are real.  Levels are counted first, a row for each question and level of
    a bucket, and only rows of the level chosen leave the products: no pair is kept that isn't in the result."""
    kinds, levels = dict(questions.dtypes) | dict(chunks.dtypes), list(levels)
    c = packs(chunks, "chunk_id", "c", by)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for ids, n in found.values():
                a, level = np.nonzero(n[:, :, 0])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(level.astype(np.int32)), *(pa.array(n[a, level, j]) for j in range(2))], ["qid", "level", "n", "real"])
            found.clear()

        for batch, i, scores in products(batches):
            ids = batch["q_ids"][i].values
            if len(found) * PACK > HELD:
                yield from rows()
            n = found.setdefault(batch["q_no"][i].as_py(), (ids, np.zeros((len(ids), len(levels), 2), np.int64)))[1]
            for level, mask in enumerate(_level_masks(batch, i, scores, levels)):
                n[:, level, 0] += mask.sum(axis=1)
                n[:, level, 1] += (mask & (scores > real_above)).sum(axis=1)
        yield from rows()

    use = ["q_no", "q_group", "q_ids", "q_also", "q_dim", "q_matrix", "c_group", "c_ids", "c_matrix"]
    sums = met(packs(questions, "qid", "q", also=wanted), c).select(*use).mapInArrow(counts, f"qid {kinds['qid']}, level int, n long, real long").groupBy("qid", "level").agg(F.sum("n").alias("n"), F.sum("real").alias("real"))
    good = F.min(F.when((F.col("n") >= enough) & (F.col("real") >= real), F.col("level")))
    chosen = questions.join(sums.groupBy("qid").agg(F.coalesce(good, F.lit(0)).alias("level")), "qid")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, scores in products(batches):
            level = batch["q_group"][i].as_py()
            a, b = np.nonzero(list(_level_masks(batch, i, scores, levels))[level])
            yield pa.RecordBatch.from_arrays([batch["q_ids"][i].values.take(pa.array(a)), pa.array(np.full(len(a), level, np.int32)), batch["c_ids"][i].values.take(pa.array(b))], ["qid", "level", "chunk_id"])

    return met(packs(chosen, "qid", "q", "level", wanted), c).select(*use).mapInArrow(taken, f"qid {kinds['qid']}, level int, chunk_id {kinds['chunk_id']}")
