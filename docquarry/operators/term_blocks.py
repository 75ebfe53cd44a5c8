"""Sums over shared terms, questions against all documents, in blocks.

Documents are packed: a row holds the ids, lengths and counted terms of many.  Questions are packed too, and each pack of
documents meets each pack of questions, so the pairs of a question and a document are never rows: a task adds up the terms
of a pair of packs and keeps the k best of each question so far (``vector_blocks._Best``).  Sums don't depend on the order
of adding (``added``), so documents with equal parts have equal scores, whatever the partitioning and their terms' order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.vector_blocks import HELD, _Best
from docquarry.sources.shared import bounded_batches, written

#: Documents and questions of a packed row; pairs of a posting and a question that are expanded at once.
DOCUMENTS, QUESTIONS, PAIRS = 512, 256, 2_000_000


_NAMES = ["ids", "lens", "sizes", "vocab", "held", "codes", "tfs"]


def _kinds(kind: str) -> str:
    return f"ids array<{kind}>, lens array<double>, sizes array<int>, vocab array<string>, held array<long>, codes binary, tfs binary"


def _pack(ids: pa.Array, lens: np.ndarray, sizes: np.ndarray, vocab: pa.Array, codes: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
    held = np.bincount(codes, minlength=len(vocab)).astype(np.int64)
    lists = (ids, pa.array(lens.astype(np.float64)), pa.array(sizes.astype(np.int32)), vocab, pa.array(held))
    own = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
    return pa.RecordBatch.from_arrays([*own, *(pa.array([x.tobytes()], pa.binary()) for x in (codes.astype(np.int32), tfs.astype(np.float64)))], _NAMES)


def packs(doc_terms: DataFrame) -> DataFrame:
    """(ids, lens, sizes, vocab, held, codes, tfs): rows of at most ``DOCUMENTS`` documents of (doc_id, term, tf), by id: of each
    its length and how many terms it has, then all terms' places in ``vocab``, in order of the terms, and counts.  ``held``:
    how many of the documents hold each word of ``vocab``.  What is packed already stays."""
    if "vocab" in doc_terms.columns:
        return doc_terms
    bounded_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.take(pc.sort_indices(batch["doc_id"]))
            for at in range(0, whole.num_rows, DOCUMENTS):
                part = whole.slice(at, DOCUMENTS)
                each = part["bag"].flatten()
                words = pc.dictionary_encode(each.field("term"))
                numbers = (x.to_numpy(zero_copy_only=False) for x in (part["len"], part["bag"].value_lengths()))
                yield _pack(part["doc_id"], *numbers, words.dictionary, words.indices.to_numpy(zero_copy_only=False), each.field("tf").to_numpy(zero_copy_only=False))

    bags = doc_terms.where("term IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf")))).alias("bag"), F.sum("tf").cast("double").alias("len"))
    return bags.mapInArrow(run, _kinds(dict(doc_terms.dtypes)["doc_id"]))


def _counted(ids: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Packs of rows in order of their ids; rows of one id are one document, and those without words are none."""
    code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    doc = np.concatenate(([0], np.cumsum(np.diff(code) != 0)))
    starts = np.searchsorted(doc, np.arange(0, doc[-1] + 1, DOCUMENTS))
    for a, b in zip(starts, [*starts[1:], len(doc)], strict=True):
        part, own = words.slice(a, b - a), doc[a:b] - doc[a]
        found = pc.dictionary_encode(part.flatten())
        order = pc.sort_indices(found.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        of = np.repeat(own, np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        key, tfs = np.unique(of * max(1, len(order)) + place[found.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        if len(key):
            lens, sizes = np.bincount(of), np.bincount(key // len(order))
            some = np.flatnonzero(sizes)
            first = a + np.searchsorted(own, some)
            yield _pack(ids.take(pa.array(first)), lens[some], sizes[some], found.dictionary.take(order), key % len(order), tfs)


def word_packs(docs: DataFrame, words: Column) -> DataFrame:
    """As ``packs`` of the words (an array of strings) of docs (doc_id and what ``words`` reads), counted as they are packed: docs
    are dealt out and sorted by id as they stand, so no task holds the words of more than a batch."""
    bounded_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last id, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch["doc_id"][0].as_py() == batch["doc_id"][-1].as_py() == held[0]["doc_id"][0].as_py():
                continue
            ids, rows = (pa.concat_arrays([h[c] for h in held]) for c in ("doc_id", "words"))
            code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(code == code[-1])[0])
            yield from _counted(ids.slice(0, last), rows.slice(0, last))
            held = [pa.RecordBatch.from_arrays([ids.slice(last), rows.slice(last)], ["doc_id", "words"])]
        if held:
            yield from _counted(*(pa.concat_arrays([h[c] for h in held]) for c in ("doc_id", "words")))

    rows = docs.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", words.alias("words"))
    return rows.mapInArrow(run, _kinds(dict(docs.dtypes)["doc_id"]))


def frequency(packed: DataFrame) -> DataFrame:
    """(term, df) of packed documents."""
    each = packed.select(F.explode(F.arrays_zip("vocab", "held")).alias("v"))
    return each.groupBy(F.col("v.vocab").alias("term")).agg(F.sum("v.held").alias("df"))


def stats(packed: DataFrame) -> DataFrame:
    """(n, known, avg), one row: documents, those with an id, and their mean length."""
    total = F.aggregate("lens", F.lit(0.0), lambda a, x: a + x)
    known = F.size(F.filter("ids", lambda i: i.isNotNull()))
    return packed.agg(F.sum(F.size("ids")).alias("n"), F.sum(known).alias("known"), (F.sum(total) / F.sum(F.size("ids"))).alias("avg"))


def _questions(weights: DataFrame) -> DataFrame:
    """(q_no, q_ids, q_vocab, q_starts, q_of, q_w): packs of questions (qid, term, w): for each word of ``q_vocab`` the questions of the
    pack that have it and their weights, from ``q_starts`` on."""
    bounded_batches()
    kind = dict(weights.dtypes)["qid"]
    names = ["q_no", "q_ids", "q_vocab", "q_starts", "q_of", "q_w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, QUESTIONS):
                part = batch.slice(at, QUESTIONS)
                each = part["bag"].flatten()
                words = pc.dictionary_encode(each.field("term"))
                codes = words.indices.to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(part.num_rows), part["bag"].value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(words.dictionary) + 1)).astype(np.int64)
                w = each.field("w").to_numpy(zero_copy_only=False).astype(np.float64)[order]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part["qid"], words.dictionary)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *(pa.array([a.tobytes()], pa.binary()) for a in (starts, of[order].astype(np.int64), w))], names)
                number += 1

    bags = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("bag"))
    return bags.mapInArrow(run, f"q_no long, q_ids array<{kind}>, q_vocab array<string>, q_starts binary, q_of binary, q_w binary")


def added(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each of n cells, rounded to nine decimals as SQL does, halves away from zero.  Multiples of 2^-20 add up
    without error (under 2^33), and what is left of each value is too small for its order to tell."""
    scaled = np.ldexp(value, 20)
    high = np.rint(scaled)
    sums = np.ldexp(np.bincount(cell, weights=high, minlength=n) + np.bincount(cell, weights=scaled - high, minlength=n), -20)
    units = sums * 1e9
    whole = np.trunc(units)
    return (whole + np.where(np.abs(units - whole) >= 0.5, np.sign(units), 0.0)) / 1e9


def _sums(q: tuple, batch: pa.RecordBatch, i: int, part: Callable, avg: float) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(scores, ids): sums of ``part`` (weights, counts, lengths, mean length) of shared terms by question and document of a pair of packs,
    -inf where they share none."""
    ids, vocab, starts, of, w = q
    at = pc.fill_null(pc.index_in(batch["vocab"][i].values, value_set=vocab), -1).to_numpy(zero_copy_only=False)
    t = at[np.frombuffer(batch["codes"][i].as_buffer(), np.int32)]
    d_ids, lens, sizes = (batch[c][i].values for c in ("ids", "lens", "sizes"))
    doc, lens = np.repeat(np.arange(len(d_ids)), sizes.to_numpy()), lens.to_numpy()
    kept = np.flatnonzero(t >= 0)
    t, doc, tf = t[kept], doc[kept], np.frombuffer(batch["tfs"][i].as_buffer(), np.float64)[kept]
    n = starts[t + 1] - starts[t]
    before = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=n, minlength=len(d_ids)))))  # pairs before each document
    first = 0
    while first < len(d_ids):
        last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS, "right")) - 1)
        a, b = np.searchsorted(doc, (first, last))
        rep = np.repeat(np.arange(a, b), n[a:b])
        ends = np.cumsum(n[a:b])
        place = np.repeat(starts[t[a:b]] - ends + n[a:b], n[a:b]) + np.arange(len(rep))
        width = last - first
        cell = of[place] * width + doc[rep] - first
        value = part(w[place], tf[rep], lens[doc[rep]], avg)
        scores = added(cell, value, len(ids) * width)
        scores[np.bincount(cell, minlength=len(scores)) == 0] = -np.inf
        yield scores.reshape(len(ids), width), d_ids.slice(first, width)
        first = last


def best(weights: DataFrame, packed: DataFrame, k: int, part: Callable, mean: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score) of questions (qid, term, w) and packed documents: a superset of the k documents of greatest sum of ``part``
    over shared terms of each question, those of every task; ties go by id.  mean: one row, avg, which ``part`` gets."""
    q_kind, d_kind = dict(weights.dtypes)["qid"], dict(packed.dtypes)["ids"][6:-1]
    asked = written(_questions(weights), "question-packs")
    pairs = packed.crossJoin(asked)
    pairs = pairs.withColumn("avg", F.lit(0.0)) if mean is None else pairs.crossJoin(F.broadcast(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Best] = {}
        questions: dict[int, tuple] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for best_ in found.values():
                if best_.parts:
                    yield pa.RecordBatch.from_arrays([*best_.rows()], ["qid", "chunk_id", "score"])
            found.clear()
            questions.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                no = batch["q_no"][i].as_py()
                if no not in found:
                    if sum(max(b.n, len(b.q_ids)) for b in found.values()) > HELD:
                        yield from rows()
                    ids = batch["q_ids"][i].values
                    arrays = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("q_starts", np.int64), ("q_of", np.int64), ("q_w", np.float64)))
                    found[no], questions[no] = _Best(ids, k), (ids, batch["q_vocab"][i].values, *arrays)
                for scores, ids in _sums(questions[no], batch, i, part, batch["avg"][i].as_py()):
                    found[no].add(scores, ids)
        yield from rows()

    use = ["q_no", "q_ids", "q_vocab", "q_starts", "q_of", "q_w", "avg", "ids", "lens", "sizes", "vocab", "codes", "tfs"]
    return pairs.select(*use).mapInArrow(run, f"qid {q_kind}, chunk_id {d_kind}, score double")
