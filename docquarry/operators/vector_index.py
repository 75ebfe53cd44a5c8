"""An inverted-file index of vectors for approximate nearest neighbours.

The centres are a bounded sample of the vectors (``lists`` rows); every vector is in the list of its nearest
centre.  A question looks into the lists of its ``probes`` nearest centres and scores exactly what is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import vector_blocks
from docquarry.operators.retrieval import top

LISTS, PROBES = 64, 44


def centres(chunks: DataFrame, lists: int = LISTS) -> DataFrame:
    """(list, centre): the vectors whose ids hash least, so many at most, the same on every run."""
    own = chunks.where("vector IS NOT NULL").select(F.col("chunk_id").alias("list"), F.col("vector").alias("centre"), F.md5(F.col("chunk_id").cast("string").cast("binary")).alias("_h"))
    return own.orderBy("_h", "list").limit(lists).drop("_h")


def with_lists(rows: DataFrame, centre_rows: DataFrame, n: int) -> DataFrame:
    """rows (with vector) once for each of the lists of their n nearest centres, by matrix products.  The centres travel with
    the code, a matrix of a size that the number of lists fixes; rows aren't shuffled.  Rows without a vector, or with one that
    holds a null or is of another length than all centres, are in no list."""
    table = centre_rows.select("list", "centre").orderBy("list").toArrow()
    centres_of = {}
    for at, x in vector_blocks.matrices(table["centre"]):
        centres_of[x.shape[1]] = table["list"].combine_chunks().take(pa.array(at)), vector_blocks.unit(x)
    vector_blocks.bounded_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in vector_blocks.matrices(batch["vector"]):
                if x.shape[1] in centres_of:
                    lists, c = centres_of[x.shape[1]]
                    near = np.argsort(-np.round(vector_blocks.unit(x) @ c.T, 9), axis=1, kind="stable")[:, :n]
                    own = batch.take(pa.array(np.repeat(at, near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*own.columns, lists.take(pa.array(near.ravel()))], [*batch.schema.names, "list"])

    kind = dict(centre_rows.dtypes)["list"]
    return rows.where("vector IS NOT NULL").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", list {kind}")


def index(chunks: DataFrame, centre_rows: DataFrame) -> DataFrame:
    """(list, chunk_id, vector) of every chunk (chunk_id, vector)."""
    return with_lists(chunks.select("chunk_id", "vector"), centre_rows, 1)


def search(questions: DataFrame, indexed: DataFrame, centre_rows: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best of the lists each question (qid, vector) looks into.  What meets is
    joined by list, as matrix products of blocks; no chunk is left out of its list, however long that is."""
    q = with_lists(questions.select("qid", "vector"), centre_rows, probes)
    return top(vector_blocks.nearest(q, indexed, k, lists=True), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(questions, recall): the share of exact hits (qid, chunk_id) that were found."""
    hit = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id", F.lit(1).alias("_f")), ["qid", "chunk_id"], "left")
    return hit.agg(F.count_distinct("qid").alias("questions"), F.round(F.count("_f") / F.count("*"), 6).alias("recall"))
