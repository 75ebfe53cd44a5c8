"""Sections as evidence: ranking by shared n-grams, coverage of whole reports, neighbours of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import gram_blocks
from docquarry.sources.shared import written


def scored(questions: DataFrame, sections: DataFrame, content_chars: int | None = 600) -> DataFrame:
    """(qid, doc_id, section_id, page, score) of the sections of the documents a question (qid, doc_id,
    question) is held to: squares of the lengths of shared 2- to 5-grams, those of the path three times.  A text that is
    null shares none.  Of the content the first ``content_chars`` characters count, or, if that is None, all."""
    q = questions.select("doc_id", "qid", T.bare(F.col("question")).alias("text"))
    content = F.col("content") if content_chars is None else F.substring("content", 1, content_chars)
    s = sections.select("doc_id", "section_id", "page", T.bare(F.col("path")).alias("path"), T.bare(content).alias("content"))
    return gram_blocks.scored(q, s, "doc_id", {"path": 3, "content": 1}, 2, 5)


def covered(ranked: DataFrame, limit: int | Column = 90, matched: int = 10, head: float = 0.8) -> DataFrame:
    """(qid, doc_id, section_id, position): the best sections by score, then an equal share of each
    document: the first four fifths of it from the beginning, the rest evenly from what follows.  What a
    short document leaves of its share goes to the next best in page order."""
    w = Window.partitionBy("qid")
    r = ranked.withColumn("_best", F.row_number().over(w.orderBy(F.desc("score"), "page", "section_id")))
    first = (F.col("_best") <= matched) & (F.col("score") > 0)
    r = r.withColumn("_first", first).withColumn("_quota", F.lit(limit) - F.count_if(first).over(w))
    rest = Window.partitionBy("qid", "doc_id", "_first")
    r = r.withColumns({"_i": F.row_number().over(rest.orderBy("page", "section_id")) - 1, "_n": F.count("*").over(rest), "_docs": F.size(F.collect_set("doc_id").over(w))})
    share = F.least("_n", F.greatest(F.lit(1), F.floor(F.col("_quota") / F.col("_docs"))))
    heads = F.least(share, F.round(share * head).cast("int"))
    tail, even = F.col("_n") - heads, share - heads
    at = F.floor((F.col("_i") - heads + 1) * even / F.greatest(tail, F.lit(1))) - F.floor((F.col("_i") - heads) * even / F.greatest(tail, F.lit(1)))
    tier = F.when(F.col("_first"), 0).when((F.col("_i") < heads) | (at >= 1), 1).otherwise(2)
    r = r.withColumn("_tier", tier)
    order = w.orderBy("_tier", F.when(F.col("_tier") == 0, F.col("_best")), F.when(F.col("_tier") > 0, F.col("_i")), "doc_id", "section_id")
    return r.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("qid", "doc_id", "section_id", "position")


def with_neighbours(hits: DataFrame, near: DataFrame, after: int = 20, most: int = 120) -> DataFrame:
    """(qid, chunk_id, position): hits with the chunks near them put in after the first ``after`` hits;
    what is a hit already keeps its place.  near: as page_window gives it."""
    n = near.join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    w = Window.partitionBy("qid").orderBy("page_distance", "seq_distance", "seed_rank", "doc_id", "chunk_id")
    n = n.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= most)
    every = hits.select("qid", "chunk_id", F.when(F.col("rank") <= after, 0).otherwise(2).alias("_t"), F.col("rank").alias("_o")).unionByName(n.select("qid", "chunk_id", F.lit(1).alias("_t"), "_o"))
    return every.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("_t", "_o"))).select("qid", "chunk_id", "position")


def page_candidates(hits: DataFrame) -> DataFrame:
    """Pages of hits (qid, doc_id, page, chunk_id, rank, content): best rank, references, text length and
    how much of it is damaged."""
    from docquarry.operators.clean import page_quality

    q = page_quality(F.col("content"))
    h = hits.withColumns({"_bad": q["bad_ratio"] * F.length("content"), "_len": F.length("content")})
    g = h.groupBy("qid", "doc_id", "page").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("chunk_id")).alias("chunks"), F.sum("_len").alias("chars"), F.sum("_bad").alias("_b"))
    ratio = F.when(F.col("chars") > 0, F.col("_b") / F.col("chars")).otherwise(0.0)
    return g.withColumns({"bad_ratio": ratio, "usable": (ratio <= 0.02) & (F.col("chars") > 0)}).drop("_b")


def page_pool(prior: DataFrame, recalled: DataFrame) -> DataFrame:
    """(qid, doc_id, page, position): prior pages in their order, then recalled ones that are new."""
    new = recalled.join(prior.select("qid", "doc_id", "page"), ["qid", "doc_id", "page"], "left_anti")
    every = prior.select("qid", "doc_id", "page", F.lit(0).alias("_t"), "rank").unionByName(new.select("qid", "doc_id", "page", F.lit(1).alias("_t"), "rank"))
    return every.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("_t", "rank", "doc_id", "page"))).drop("_t", "rank")


def parents_of(relevant: DataFrame, corpus: DataFrame) -> DataFrame:
    """Relevant chunks (qid, chunk_id) and the parents of those, once each."""
    up = relevant.join(corpus.select("chunk_id", "parent_id"), "chunk_id").where("parent_id IS NOT NULL").select("qid", F.col("parent_id").alias("chunk_id"))
    return relevant.select("qid", "chunk_id").unionByName(up).distinct()


def expanded(candidates: DataFrame, semantic: DataFrame, ranked: DataFrame, chunks: DataFrame, limit: int = 90, dense: int = 30, matched: int = 10, head: float = 0.8, most_children: int = 120, preserve: int = 20, cap: int = 160) -> DataFrame:
    """(qid, chunk_id, kind, position): candidates (qid, chunk_id, rank) of summarising questions widened by whole sections.

    Sections are the ``dense`` nearest (semantic: qid, doc_id, section_id, rank) and, for what is left of ``limit``, a
    coverage of the others (ranked: as ``scored`` gives it).  The order is: the first ``preserve`` candidates (head), the
    chunks of the sections (child; chunks: doc_id, chunk_id, parent_id, seq), the sections themselves (coverage), the
    other candidates (tail).  A child that is in the head or is a section stays away, and so does a candidate of the tail
    that came before; a section that is in the head comes again.  The first ``cap`` of a question are kept.  Questions without
    sections keep their candidates."""
    near = semantic.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "section_id"))).where(F.col("_n") <= min(dense, limit))
    near = near.select("qid", "doc_id", "section_id", F.col("_n").alias("rank"))
    taken = near.groupBy("qid").agg(F.count("*").alias("_near"))
    others = ranked.join(near.select("qid", "section_id"), ["qid", "section_id"], "left_anti").join(taken, "qid", "left").withColumn("_limit", F.lit(limit) - F.coalesce("_near", F.lit(0)))
    rest = covered(others.where("_limit > 0"), F.col("_limit"), matched, head)
    selected = written(near.unionByName(rest.select("qid", "doc_id", "section_id", (F.col("position") + limit).alias("rank"))), "sections-selected")
    first = candidates.where(F.col("rank") <= preserve)
    under = chunks.join(selected.select("qid", "doc_id", F.col("section_id").alias("parent_id"), F.col("rank").alias("_rank")), ["doc_id", "parent_id"])
    under = under.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("_rank", "seq", "chunk_id"))).where(F.col("_n") <= most_children)
    sections = selected.select("qid", F.col("section_id").alias("chunk_id"))
    child = under.select("qid", "chunk_id", F.col("_n").alias("_o")).join(first.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").join(sections, ["qid", "chunk_id"], "left_anti")
    tail = candidates.where(F.col("rank") > preserve).join(sections.unionByName(child.select("qid", "chunk_id")), ["qid", "chunk_id"], "left_anti")
    part = lambda df, tier, kind, order: df.select("qid", "chunk_id", F.lit(kind).alias("kind"), F.lit(tier).alias("_t"), F.col(order).cast("long").alias("_o"))
    every = part(first, 0, "head", "rank").unionByName(part(child, 1, "child", "_o")).unionByName(part(selected.withColumnRenamed("section_id", "chunk_id"), 2, "coverage", "rank")).unionByName(part(tail, 3, "tail", "rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("_t", "_o"))
    return every.withColumn("position", place).where(F.col("position") <= cap).select("qid", "chunk_id", "kind", "position")
