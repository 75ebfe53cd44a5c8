"""Phrases as exact anchors: an index of numbers with units, quoted phrases, places of a phrase on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.positions import containing
from docquarry.sources.shared import written


def number_index(chunks: DataFrame) -> DataFrame:
    """(phrase, doc_id, chunk_id): numbers with units of all chunks but sections, normalised, once each."""
    own = chunks.where("chunk_type <> 'section'") if "chunk_type" in chunks.columns else chunks
    found = own.select("doc_id", "chunk_id", F.explode(T.number_phrases(F.col("content"))).alias("p"))
    return found.select(T.without_separators(F.col("p")).alias("phrase"), "doc_id", "chunk_id").where("phrase <> ''").distinct()


def _best_of_classes(asked: DataFrame, held: DataFrame, weight: Column, most: int) -> DataFrame:
    """(qid, chunk_id, rank): the best chunks of each question (qid, phrase) among those that hold its phrases (phrase, chunk_id,
    once each, of these phrases only), by the sum of ``weight``, then by id.

    Questions with the same phrases have the same answer, and of chunks with the same ones only the ``most`` of least id can
    be in it.  So what meets are sets of phrases, known by their first question or chunk, and copies on either side cost no
    pairs.  Sets repeat so much that files of them are a small part of their size, so no join may be planned by these."""
    sets = lambda df, by: df.groupBy(by).agg(F.array_sort(F.collect_set("phrase")).alias("_set"))
    questions = written(sets(asked, "qid"), "question-sets")
    asks = questions.groupBy("_set").agg(F.min(F.struct("qid")).alias("_q"))
    w = Window.partitionBy("_set").orderBy("chunk_id")
    first = F.first(F.struct("chunk_id")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = sets(held, "chunk_id").withColumns({"_n": F.row_number().over(w), "_c": first}).where(F.col("_n") <= most)
    few = written(few, "chunk-sets")
    single = lambda df, name: df.select(name, F.explode("_set").alias("phrase"))
    met = single(asks, "_q").hint("merge").join(single(few.where("_n = 1"), "_c"), "phrase").groupBy("_q", "_c").agg(F.sum(weight).alias("matched"))
    # of all chunks of a class the first ``most`` are kept, so the best sets are enough: each has a chunk at least
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("matched"), "_c"))).where(F.col("_n") <= most).drop("_n")
    w = Window.partitionBy("_q").orderBy(F.desc("matched"), "chunk_id")
    hits = best.hint("merge").join(few.select("_c", "chunk_id"), "_c").select("_q", "chunk_id", "matched", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)
    return questions.hint("merge").join(asks, "_set").select("qid", "_q").hint("merge").join(hits, "_q").select("qid", "chunk_id", "matched", "rank")


def number_hits(questions: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """(qid, chunk_id, rank): chunks that hold a number of the question, those with more of them first."""
    asked = questions.select("qid", F.explode(T.number_phrases(F.col("question"))).alias("p")).select("qid", T.without_separators(F.col("p")).alias("phrase")).distinct()
    held = index.select("phrase", "chunk_id").join(asked.select("phrase").distinct(), "phrase", "left_semi")
    return _best_of_classes(asked, held, F.lit(1), most)


def quoted_hits(questions: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(qid, chunk_id, rank): chunks that hold a phrase the question quotes, word for word."""
    asked = questions.select("qid", F.explode(T.quoted_phrases(F.col("question"))).alias("_p")).distinct()
    # questions that quote the same share its places; each phrase is looked up once
    held = containing(asked.select(F.col("_p").alias("_quoted")).distinct(), chunks.select("chunk_id", "content"), "_quoted", "content")
    held = written(held.select(F.col("_quoted").alias("phrase"), "chunk_id"), "quoted")
    return _best_of_classes(asked.withColumnRenamed("_p", "phrase"), held, F.length("phrase"), most)


def union_best(routes: list[DataFrame]) -> DataFrame:
    """(qid, chunk_id, score): all hits of the routes, each with its best score."""
    out = routes[0].select("qid", "chunk_id", "score")
    for r in routes[1:]:
        out = out.unionByName(r.select("qid", "chunk_id", "score"))
    return out.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))


def located(words: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc_id, page, found, x0, y0, x1, y1): where a run of words stands on each page that has it; found is
    how often, and the box is null unless it is once.  words: doc_id, page, n, word, x0, y0, x1, y1."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    run = F.lit(True)
    for i, p in enumerate(phrase):
        run = run & F.coalesce(F.lower(F.lead("word", i).over(w)) == p.lower(), F.lit(False))
    frame = w.rowsBetween(0, len(phrase) - 1)
    spans = words.select("doc_id", "page", run.alias("_run"), F.min("x0").over(frame).alias("x0"), F.min("y0").over(frame).alias("y0"), F.max("x1").over(frame).alias("x1"), F.max("y1").over(frame).alias("y1")).where("_run")
    g = spans.groupBy("doc_id", "page").agg(F.count("*").alias("found"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    one = lambda c: F.when(F.col("found") == 1, F.col(c)).alias(c)
    return g.select("doc_id", "page", "found", *(one(c) for c in ("x0", "y0", "x1", "y1")))


def stand_in_vector(text: Column, size: int = 64) -> Column:
    """A vector of unit length made of the text's hashes: equal texts have equal vectors, and nothing more
    is to be read from them.  For runs without an embedding service."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.xxhash64(text, i).cast("double") / F.lit(float(1 << 63)))
    return T.bound(raw, lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))))
