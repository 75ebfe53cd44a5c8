"""Conversations: loops, recent turns, guards, answer cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import vector_blocks
from docquarry.sources.shared import written


def loops(turns: DataFrame, repeats: int = 3) -> DataFrame:
    """User turns (conv_id, turn, text) that ask, up to then, the same for the nth time or more."""
    asked = turns.where("role = 'user'").withColumn("key", T.question_key(F.coalesce("text", F.lit("")))).where("key <> ''")
    w = Window.partitionBy("conv_id", "key").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return asked.withColumn("times", F.count("*").over(w)).where(F.col("times") >= repeats)


def last_turns(turns: DataFrame, window: int) -> DataFrame:
    """The last 2 * window messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * window).drop("_n")


def _answers(batches: Iterator[pa.RecordBatch], similar: float, overlap: float) -> Iterator[pa.RecordBatch]:
    """(_q, entry_id, similarity) of pairs of packs: of each question the nearest entry of the task that is near in meaning and in words.
    Words are compared from the nearest entry on, until one is found, so no pair is kept that isn't an answer."""
    found: dict[int, tuple[pa.Array, dict[int, tuple]]] = {}
    bags: dict[str, frozenset] = {}

    def grams(text: str) -> frozenset:
        if text not in bags:
            if len(bags) >= vector_blocks.PACK:
                bags.clear()
            bags[text] = frozenset(text[i : i + 2] for i in range(len(text) - 1))
        return bags[text]

    def shared(a: str | None, b: str | None) -> float:
        if a is None or b is None:
            return 0.0
        x, y = grams(a), grams(b)
        return 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0

    def rows() -> Iterator[pa.RecordBatch]:
        for ids, own in found.values():
            if own:
                far, entry, cosine = zip(*own.values(), strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(list(own))), pa.concat_arrays(entry), pa.array(cosine)], ["_q", "entry_id", "similarity"])
        found.clear()

    def place(answer: tuple) -> tuple:
        entry = answer[1][0].as_py()
        return (answer[0], *((0,) if entry is None else (1, entry)))

    for batch in batches:
        for i in range(batch.num_rows):
            q, c = (np.frombuffer(batch[f"{x}_matrix"][i].as_buffer(), np.float64).reshape(-1, batch["q_dim"][i].as_py()) for x in "qc")
            scores = q @ c.T
            a, b = np.nonzero(scores >= similar)
            if not len(a):
                continue
            no, ids = batch["q_no"][i].as_py(), batch["c_ids"][i].values
            if no not in found and len(found) * vector_blocks.PACK > vector_blocks.HELD:
                yield from rows()
            own = found.setdefault(no, (batch["q_ids"][i].values, {}))[1]
            q_words, c_words = batch["q_also"][i].values, batch["c_also"][i].values
            far = -np.round(scores[a, b], 9)
            order = np.lexsort((b, far, a))  # entries of a pack are in order of their ids
            done = -1
            for at in order.tolist():
                row = int(a[at])
                if row == done:
                    continue
                old = own.get(row)
                new = (float(far[at]), ids.slice(int(b[at]), 1), float(scores[a[at], b[at]]))
                if old is not None and place(old) <= place(new):
                    done = row
                elif shared(q_words[row].as_py(), c_words[int(b[at])].as_py()) >= overlap:
                    own[row], done = new, row
    yield from rows()


def cached_answers(questions: DataFrame, cache: DataFrame, similar: float = 0.95, overlap: float = 0.5) -> DataFrame:
    """(qid, entry_id, similarity): the nearest cached question of each, if near in meaning and in words; ties go to the
    lower entry.  Questions meet all entries as matrix products of packs (``vector_blocks``); each equal question, and each equal
    entry, goes there once."""
    words = F.regexp_replace(F.lower("q_norm"), f"{T.WS}+", "").alias("words")
    entry = cache.groupBy("q_norm", "q_vec").agg(F.min("entry_id").alias("entry_id"))
    asked = written(questions.groupBy("q_norm", "q_vec").agg(F.count("*").alias("_n")).withColumn("_q", F.monotonically_increasing_id()), "cache-asked")
    q = vector_blocks.packs(asked.select("_q", F.col("q_vec").alias("vector"), words), "_q", "q", also="words")
    c = vector_blocks.packs(entry.select("entry_id", F.col("q_vec").alias("vector"), words), "entry_id", "c", also="words")
    use = ["q_no", "q_ids", "q_also", "q_dim", "q_matrix", "c_ids", "c_also", "c_matrix"]
    near = vector_blocks.met(q, c).select(*use).mapInArrow(lambda batches: _answers(batches, similar, overlap), f"_q long, entry_id {dict(cache.dtypes)['entry_id']}, similarity double")
    best = near.groupBy("_q").agg(F.min_by(F.struct("entry_id", "similarity"), F.struct((-F.round("similarity", 9)).alias("far"), "entry_id")).alias("_best"))
    found = best.join(asked.select("_q", F.col("q_norm").alias("_norm"), F.col("q_vec").alias("_vec")), "_q")
    mine = F.col("q_norm").eqNullSafe(F.col("_norm")) & (F.col("q_vec") == F.col("_vec"))
    return questions.join(found, mine).select("qid", "_best.entry_id", "_best.similarity")
