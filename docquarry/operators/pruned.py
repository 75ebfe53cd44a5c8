"""Top-k of BM25 without reading all postings: bounds by blocks of documents.

What a term adds to a document's score is the same for every question.  Documents stay packed (``term_blocks``) and fall
into blocks of ``BLOCK`` within their pack; of each term and block the greatest such part is a bound.  Packs meet packs of
questions, and only the best of a task leave it, so neither postings nor bounds are rows.

1. A threshold for each question: documents that its few terms of greatest weight bring in are scored in full, and the
   k-th best of these scores is no more than the k-th best of all.  A task that has found better goes by that.
2. Blocks whose bounds together stay under the threshold hold none of the k best.
3. In a block that is left, the terms of least bounds that together stay under the threshold bring no document in by
   themselves.  Only postings of the others are read; those of the common terms are looked up for the documents that with
   the bounds of these can still reach the threshold.

The k best are the same as without bounds, ties included; which postings are read is all that changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators import term_blocks
from docquarry.operators.retrieval import top
from docquarry.operators.vector_blocks import HELD, _Best
from docquarry.sources.shared import bounded_batches, written

BLOCK = 64
#: Terms with so many times k postings bring in documents for a threshold.
FIRST = 32
#: Sums of parts in another order may differ by this.
SLACK = 1e-6


def postings(doc_terms: DataFrame, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> DataFrame:
    """``term_blocks.packs`` of (doc_id, term, tf), or of what is packed already, with how many documents share a bound and the
    parameters of BM25."""
    return term_blocks.packs(doc_terms).withColumns({"block": F.lit(block), "k1": F.lit(k1), "b": F.lit(b)})


def _questions(weights: DataFrame) -> DataFrame:
    """(q_no, q_ids, q_least, q_vocab, q_starts, q_of, q_w, q_first): packs of questions (qid, term, w, first, least) as those of
    ``term_blocks``; a term's weight is the same in all, so there is one for each word of ``q_vocab``."""
    bounded_batches()
    kind = dict(weights.dtypes)["qid"]
    names = ["q_no", "q_ids", "q_least", "q_vocab", "q_starts", "q_of", "q_w", "q_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, term_blocks.QUESTIONS):
                part = batch.slice(at, term_blocks.QUESTIONS)
                each = part["bag"].flatten()
                words = pc.dictionary_encode(each.field("term"))
                codes = words.indices.to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(part.num_rows), part["bag"].value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(words.dictionary) + 1)).astype(np.int64)
                w, first = (each.field(c).to_numpy(zero_copy_only=False)[order] for c in ("w", "first"))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part["qid"], part["least"], words.dictionary)]
                arrays = (starts, of[order].astype(np.int64), w[starts[:-1]].astype(np.float64), first.astype(np.bool_))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names)
                number += 1

    bags = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "w", "first")).alias("bag"), F.first("least").alias("least"))
    return bags.mapInArrow(run, f"q_no long, q_ids array<{kind}>, q_least array<double>, q_vocab array<string>, q_starts binary, q_of binary, q_w binary, q_first binary")


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one after another."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _block(q: dict, t: np.ndarray, doc: np.ndarray, part: np.ndarray, width: int, bar: np.ndarray, firsts: bool) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """(cells, scores, (all, read, looked up)) of a block: question * width + document of those that may be among the best, and their
    sums.  The block's postings are t (place in the questions' words), doc and part.  With firsts the terms so marked are read and
    nothing is left out, otherwise what bar, a threshold of each question, leaves to be read."""
    order = np.argsort(t, kind="stable")  # by term, then document
    t, doc, part = t[order], doc[order], part[order]
    at = np.flatnonzero(np.diff(t, prepend=-1))
    terms, n = t[at], np.diff(at, append=len(t))
    most = np.maximum.reduceat(part, at)
    asking = q["starts"][terms + 1] - q["starts"][terms]
    entry = _runs(q["starts"][terms], asking)  # a question and a term of it that is in the block
    term, of = np.repeat(np.arange(len(terms)), asking), q["of"][entry]
    everything = int(n[term].sum())
    alive = np.bincount(of, weights=most[term], minlength=len(bar)) >= bar - SLACK
    kept = np.flatnonzero(alive[of])
    kept = kept[np.lexsort((most[term[kept]], of[kept]))]
    term, of, bound = term[kept], of[kept], most[term[kept]]
    if firsts:
        read = q["first"][entry[kept]]
    else:
        up_to = np.cumsum(bound)
        before = np.concatenate(([0.0], up_to))[np.searchsorted(of, of)]
        read = up_to - before >= bar[of] - SLACK
    rest = np.bincount(of[~read], weights=bound[~read], minlength=len(bar))
    r = np.flatnonzero(read)
    place = _runs(at[term[r]], n[term[r]])
    cell = np.repeat(of[r], n[term[r]]) * width + doc[place]
    own = np.bincount(cell, weights=part[place], minlength=len(bar) * width)
    hit = np.bincount(cell, minlength=len(own)) > 0
    if not firsts:
        hit &= own + np.repeat(rest, width) >= np.repeat(bar, width) - SLACK
    cells = np.flatnonzero(hit)
    others, question = np.flatnonzero(~read), cells // width  # sorted by question
    first = np.searchsorted(of[others], np.arange(len(bar) + 1))
    many = (first[1:] - first[:-1])[question]
    ask = others[_runs(first[question], many)]
    which = np.repeat(np.arange(len(cells)), many)
    key = term[ask] * width + cells[which] % width
    keys = np.repeat(np.arange(len(terms)), n) * width + doc
    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    there = keys[found] == key
    number = np.full(len(own), -1)
    number[cells] = np.arange(len(cells))
    mine = np.flatnonzero(hit[cell])
    scores = term_blocks.added(np.concatenate((number[cell[mine]], which[there])), np.concatenate((part[place[mine]], part[found[there]])), len(cells))
    return cells, scores, (everything, len(place), int(there.sum()))


def _search(weights: DataFrame, indexed: DataFrame, mean: DataFrame, k: int, firsts: bool) -> DataFrame:
    """(qid, chunk_id, score, all, read, looked_up): the k best of each question and task, and a row of counts for each task."""
    q_kind, d_kind = dict(weights.dtypes)["qid"], dict(indexed.dtypes)["ids"][6:-1]
    asked = written(_questions(weights), "pruned-questions")
    pairs = indexed.crossJoin(asked).crossJoin(F.broadcast(mean))  # one row
    names = ["qid", "chunk_id", "score", "all", "read", "looked_up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Best] = {}
        questions: dict[int, dict] = {}
        counts, kinds = np.zeros(3, np.int64), None

        def rows() -> Iterator[pa.RecordBatch]:
            for best in found.values():
                if best.parts:
                    own = best.rows()
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(np.zeros(len(own[0]), np.int64))] * 3], names)
            found.clear()
            questions.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                no = batch["q_no"][i].as_py()
                if no not in found:
                    if sum(max(b.n, len(b.q_ids)) for b in found.values()) > HELD:
                        yield from rows()
                    arrays = {c: np.frombuffer(batch[f"q_{c}"][i].as_buffer(), d) for c, d in (("starts", np.int64), ("of", np.int64), ("w", np.float64), ("first", np.bool_))}
                    found[no] = _Best(batch["q_ids"][i].values, k)
                    questions[no] = arrays | {"vocab": batch["q_vocab"][i].values, "least": batch["q_least"][i].values.to_numpy(zero_copy_only=False)}
                q, best = questions[no], found[no]
                ids, lens, sizes = (batch[c][i].values for c in ("ids", "lens", "sizes"))
                kinds = best.q_ids.type, ids.type
                t = pc.fill_null(pc.index_in(batch["vocab"][i].values, value_set=q["vocab"]), -1).to_numpy(zero_copy_only=False)[np.frombuffer(batch["codes"][i].as_buffer(), np.int32)]
                of = np.flatnonzero(t >= 0)
                doc, t, tf = np.repeat(np.arange(len(ids)), sizes.to_numpy())[of], t[of], np.frombuffer(batch["tfs"][i].as_buffer(), np.float64)[of]
                k1, b, avg, block = (batch[c][i].as_py() for c in ("k1", "b", "avg", "block"))
                part = q["w"][t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens.to_numpy()[doc] / avg))
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                for first in range(0, len(ids), block):
                    width = min(block, len(ids) - first)
                    x, y = np.searchsorted(doc, (first, first + width))
                    if x == y:
                        continue
                    cells, sums, more = _block(q, t[x:y], doc[x:y] - first, part[x:y], width, np.maximum(q["least"], best.least), firsts)
                    counts += more
                    scores = np.full((len(best.q_ids), width), -np.inf)
                    scores.ravel()[cells] = np.where((sums > 0) & ~absent[first + cells % width], sums, -np.inf)
                    best.add(scores, ids.slice(first, width))
        yield from rows()
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.float64()), *(pa.array([c]) for c in counts)], names)

    use = ["q_no", "q_ids", "q_least", "q_vocab", "q_starts", "q_of", "q_w", "q_first", "avg", "k1", "b", "block", "ids", "lens", "sizes", "vocab", "codes", "tfs"]
    return pairs.select(*use).mapInArrow(run, f"qid {q_kind}, chunk_id {d_kind}, score double, all long, read long, looked_up long")


def bm25(query_terms: DataFrame, indexed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best (qid, chunk_id, score, rank) of (qid, term) over ``postings``, and (questions, all, read, looked_up):
    how many postings the questions' terms have, and how many were read and looked up once there were thresholds."""
    stats = term_blocks.stats(indexed)  # one row
    asked = query_terms.select("qid", "term").distinct()
    known = term_blocks.frequency(indexed).join(asked.select("term").distinct(), "term", "left_semi")
    weight = known.crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    before = F.sum("df").over(Window.partitionBy("qid").orderBy(F.desc("w"), "term").rowsBetween(Window.unboundedPreceding, -1))
    weights = written(asked.join(weight, "term").select("qid", "term", "w", (F.coalesce(before, F.lit(0)) < FIRST * k).alias("first")), "pruned-weights")
    mean = written(stats.select("avg"), "pruned-mean")
    tried = _search(weights.withColumn("least", F.lit(float("-inf"))), indexed, mean, k, True).where("score IS NOT NULL")
    kth = top(tried, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    bounded = weights.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = written(_search(bounded, indexed, mean, k, False), "pruned-found")
    counts = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all", "read", "looked_up")))
    hits = top(found.where("score IS NOT NULL").select("qid", "chunk_id", "score"), k)
    return hits, weights.agg(F.count_distinct("qid").alias("questions")).crossJoin(counts)
