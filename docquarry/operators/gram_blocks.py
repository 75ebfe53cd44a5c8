"""Shared runs of characters of questions and the texts they are held to, counted in blocks.

Rows of one document are packed, and packs of questions meet packs of sections of the same document.  What moves is texts, not
their grams: a task numbers the grams of a pack of questions, level by level (a gram is the one before it and one more character), and
looks up those of the sections, so a gram that no question has goes no further.
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

#: Questions and sections of a packed row; characters of sections that a task looks up at once.
QUESTIONS, SECTIONS, CHARS = 64, 128, 1 << 20


def packed(df: DataFrame, by: str, columns: Sequence[str], prefix: str, size: int) -> DataFrame:
    """(by, prefix_no, and an array prefix_column of each column): rows of at most ``size`` rows of one value of ``by``."""
    bounded_batches()
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch[by]))
            code = pc.dictionary_encode(batch[by]).indices.to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            for first, last in zip([0, *ends], ends):
                for at in range(first, last, size):
                    part = batch.slice(at, min(size, last - at))
                    own = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c]) for c in columns]
                    yield pa.RecordBatch.from_arrays([part[by].slice(0, 1), pa.array([number], pa.int64()), *own], [by, f"{prefix}_no", *(f"{prefix}_{c}" for c in columns)])
                    number += 1

    return df.select(by, *columns).where(F.col(by).isNotNull()).mapInArrow(run, ", ".join([f"{by} {kinds[by]}", f"{prefix}_no long", *(f"{prefix}_{c} array<{kinds[c]}>" for c in columns)]))


def _levels(texts: pa.Array, tables: list[np.ndarray], low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, text * grams + gram): the distinct grams of n characters of each text, by their number among the questions' own.  An empty
    list of tables is filled from these texts; otherwise grams that aren't in the tables are left out, and CHARS places are
    looked up at once, so a text that lies in several such parts may have a gram of each."""
    texts, build = pc.fill_null(texts, ""), not tables
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    step = max(1, len(code) if build else CHARS)
    for lo in range(0, max(1, len(code)), step):
        part = code[lo : lo + step + high - 1].astype(np.int64)
        of = np.searchsorted(ends, np.arange(lo, lo + len(part)), side="right")
        at, own, letter = np.arange(len(part)), np.zeros(len(part), np.int64), np.full(len(part), -1)
        for n in range(1, high + 1):
            if n > 1:
                whole = at + n - 1 < len(part)
                at, own = at[whole], own[whole]
                whole = (of[at + n - 1] == of[at]) & (letter[at + n - 1] >= 0)
                at, own = at[whole], own[whole]
                key = own * (len(tables[0]) + 1) + letter[at + n - 1]
            else:
                key = part
            if build:
                tables.append(np.unique(key))
            table = tables[n - 1]
            if not len(table) or not len(key):
                if build:
                    continue
                break
            place = np.minimum(np.searchsorted(table, key), len(table) - 1)
            found = table[place] == key
            if n == 1:
                letter = np.where(found, place, -1)
            at, own = at[found], place[found]
            if n >= low:
                yield n, np.unique(of[at] * len(table) + own)


class _Questions:
    def __init__(self, texts: pa.Array, low: int, high: int):
        self.n, self.tables, self.low, self.high, self.grams = len(texts), [], low, high, {}
        for n, pair in _levels(texts, self.tables, low, high):
            text, gram = np.divmod(pair, len(self.tables[n - 1]))
            order = np.argsort(gram, kind="stable")
            self.grams[n] = np.searchsorted(gram[order], np.arange(len(self.tables[n - 1]) + 1)), text[order]

    def weights(self, texts: pa.Array) -> np.ndarray:
        """Of each text (row) and question the sum of the squares of the lengths of the grams that both have."""
        out, found = np.zeros(len(texts) * self.n, np.int64), {}
        for n, pair in _levels(texts, self.tables, self.low, self.high):
            found[n] = np.union1d(found[n], pair) if n in found else pair
        for n, pair in found.items():
            text, gram = np.divmod(pair, len(self.tables[n - 1]))
            starts, of = self.grams[n]
            many = starts[gram + 1] - starts[gram]
            place = np.repeat(starts[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out += n * n * np.bincount(np.repeat(text, many) * self.n + of[place], minlength=len(out))
        return out.reshape(len(texts), self.n)


def scored(questions: DataFrame, sections: DataFrame, by: str, weights: dict[str, int], low: int, high: int) -> DataFrame:
    """(qid, by, section_id, page, score) of questions (by, qid, text) and sections (by, section_id, page and the columns that
    ``weights`` names), every pair of one value of ``by``: squares of the lengths of shared grams, times the column's weight.
    A text that is null has none."""
    kinds = dict(sections.dtypes) | dict(questions.dtypes)
    texts = list(weights)
    q = packed(questions, by, ["qid", "text"], "q", QUESTIONS)
    s = packed(sections, by, ["section_id", "page", *texts], "s", SECTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, _Questions] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                no, ids = batch["q_no"][i].as_py(), batch["q_qid"][i].values
                if no not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[no] = _Questions(batch["q_text"][i].values, low, high)
                score = sum(w * seen[no].weights(batch[f"s_{c}"][i].values) for c, w in weights.items())
                a, b = (x.ravel() for x in np.indices(score.shape))
                key = batch[by].slice(i, 1).take(pa.array(np.zeros(len(a), np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(b)), key, *(batch[f"s_{c}"][i].values.take(pa.array(a)) for c in ("section_id", "page")), pa.array(score.ravel())], ["qid", by, "section_id", "page", "score"])

    pairs = s.join(q, by).select(by, "q_no", "q_qid", "q_text", "s_section_id", "s_page", *(f"s_{c}" for c in texts))
    return pairs.mapInArrow(run, f"qid {kinds['qid']}, {by} {kinds[by]}, section_id {kinds['section_id']}, page {kinds['page']}, score long")
