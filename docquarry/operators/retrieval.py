"""Retrieval over batches of questions: routes, fusion, selection.

A route is (qid, chunk_id, score).  Scores are rounded to nine decimals and every top-k has a total
order, so results are the same on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import vectors
from docquarry.operators import term_blocks, vector_blocks

RRF_K = 60


def top(df: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each question, with their rank from 1.  Spark keeps k rows a task before it
    shuffles (a window group limit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visible(df: DataFrame, org: str, levels: list[str]) -> DataFrame:
    """Rows that a user of the organisation with these levels may read."""
    return df.where((F.col("org") == org) & F.col("visibility").isin(*levels))


def visible_levels(user: str) -> list[str]:
    """Unknown users read what is public."""
    order = ["public", "internal", "restricted"]
    return order[: order.index(user) + 1] if user in order else ["public"]


def payload_filter(df: DataFrame, years: list[int] | None = None, year: int | None = None, docs: list | None = None, types: list[str] | None = None, without: tuple[str, ...] = ("section", "summary")) -> DataFrame:
    """A list of years goes before one year; excluded types go unless types are asked for."""
    if years:
        df = df.where(F.col("year").isin(*years))
    elif year is not None:
        df = df.where(F.col("year") == year)
    if docs:
        df = df.where(F.col("doc_id").isin(*docs))
    return df.where(F.col("chunk_type").isin(*types)) if types else df.where(~F.col("chunk_type").isin(*without))


# --- routes -------------------------------------------------------------------------------------


def scored(questions: DataFrame, chunks: DataFrame, on: Column | None = None) -> DataFrame:
    """questions x chunks with ``score``, their vectors' cosine (and without the vectors).

    The questions are a stated set.  Spark broadcasts them if they are under its threshold; otherwise it deals both
    sides out in blocks (a task for each pair of partitions), so neither has to fit anywhere whole."""
    q = questions.withColumn("vector", vectors.unit(F.col("vector"))).withColumnRenamed("vector", "_q")  # once a row, not once a pair
    pairs = chunks.withColumn("vector", vectors.unit(F.col("vector"))).withColumnRenamed("vector", "_v").join(q, F.lit(True) if on is None else on)
    return pairs.withColumn("score", F.round(vectors.dot(F.col("_q"), F.col("_v")), 9)).drop("_q", "_v")


def dense_route(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of a stated set of questions (qid, vector) against all chunks (chunk_id, vector), by matrix
    products of blocks.  Vectors that are null or hold a null are not compared, nor are those of unequal length."""
    return top(vector_blocks.nearest(questions.select("qid", "vector"), chunks.select("chunk_id", "vector"), k), k)


def nearest_others(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score), which holds the k best of each question (qid, vector, list) among the chunks (chunk_id, vector, list) of
    its list that have another id, by matrix products of blocks.

    Vectors that are null or hold a null have null scores, others that aren't finite have NaN, whatever they meet: null comes
    last and NaN first, both by id, so of each list and kind the k + 1 least ids are all that can be among the best."""
    q, c = (df.where("list IS NOT NULL") for df in (questions, chunks.where("chunk_id IS NOT NULL")))
    found = vector_blocks.nearest(q.select("qid", "vector", "list"), c, k, lists=True, others=True)
    v = F.col("vector")
    kind = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), 2).when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), 1).otherwise(0)
    least = F.dense_rank().over(Window.partitionBy("list", "_c").orderBy("chunk_id"))
    first = c.select("chunk_id", "list", kind.alias("_c")).withColumn("_n", least).where(F.col("_n") <= k + 1).drop("_n")
    odd = q.select("qid", "list", kind.alias("_q")).join(first, "list").where("chunk_id <> qid AND _q + _c > 0")
    none = F.when(F.greatest("_q", "_c") == 1, F.lit(float("nan")))
    return found.unionByName(odd.select("qid", "chunk_id", none.alias("score")))


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df) of (doc_id, term, tf), or of documents that are packed (``term_blocks.packs``)."""
    return term_blocks.frequency(terms) if "vocab" in terms.columns else terms.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf_table(terms: DataFrame) -> DataFrame:
    n = term_blocks.stats(terms).select(F.col("known").alias("_n")) if "vocab" in terms.columns else terms.agg(F.count_distinct("doc_id").alias("_n"))  # one row
    return document_frequency(terms).crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("_n")).alias("idf"))


def sparse_route(query_terms: DataFrame, doc_terms: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """Dot product of (qid, term, tf) and (doc_id, term, tf), each query weight times the term's idf if
    given.  Terms without a positive weight say nothing.  doc_terms may be packed."""
    q = query_terms.select("qid", "term", F.col("tf").cast("double").alias("w"))
    if weights is not None:
        asked = q.select("term").distinct()
        q = q.join(weights.join(asked, "term", "left_semi").select("term", "idf"), "term").select("qid", "term", (F.col("w") * F.col("idf")).alias("w")).where("w > 0")
    return top(term_blocks.best(q, term_blocks.packs(doc_terms), k, lambda w, tf, length, avg: w * tf), k)


def bm25_route(query_terms: DataFrame, doc_terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of the distinct terms of each question.  Document lengths and frequencies are those of the
    whole corpus.  doc_terms may be packed."""
    packed = term_blocks.packs(doc_terms)
    stats = term_blocks.stats(packed)  # one row
    asked = query_terms.select("qid", "term").distinct()
    known = document_frequency(packed).join(asked.select("term").distinct(), "term", "left_semi")
    weight = known.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    part = lambda w, tf, length, avg: w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))
    found = term_blocks.best(asked.join(weight, "term").select("qid", "term", "w"), packed, k, part, stats.select("avg"))
    return top(found.where("score > 0 AND chunk_id IS NOT NULL"), k)


# --- fusion and order ---------------------------------------------------------------------------


def ranked_union(routes: list[DataFrame]) -> DataFrame:
    """(qid, chunk_id, score, rank, route) of routes that have ranks."""
    parts = [r.select("qid", "chunk_id", "score", "rank", F.lit(i).alias("route")) for i, r in enumerate(routes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fuse(routes: list[DataFrame], k: int = RRF_K, method: str = "rrf") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), or (route_aware) that of the best rank with the
    sum as tie-break."""
    each = 1.0 / (k + F.col("rank"))
    out = ranked_union(routes).groupBy("qid", "chunk_id").agg(F.sum(each).alias("total"), F.max("score").alias("score"), F.count("*").alias("routes"), F.min("rank").alias("best_rank"))
    fused = F.col("total") if method == "rrf" else 1.0 / (k + F.col("best_rank"))
    w = Window.partitionBy("qid").orderBy(F.round(fused, 12).desc(), F.round("total", 12).desc(), "chunk_id")
    return out.withColumn("fused_score", fused).withColumn("rank", F.row_number().over(w)).drop("total")


def injected(tiers: list[DataFrame]) -> DataFrame:
    """Hits of the tiers one after another; a chunk stays in its first tier only."""
    each = ranked_union(tiers).withColumnRenamed("route", "tier")
    first = Window.partitionBy("qid", "chunk_id").orderBy("tier", "rank")
    kept = each.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "rank", "chunk_id")))


def demoted(hits: DataFrame, flag: str = "is_structural") -> DataFrame:
    """Structural hits after the others; otherwise the order stays."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce(F.col(flag), F.lit(False)), "rank", "chunk_id")))


def section_weight(path: Column, rules: list[tuple[str, float]]) -> Column:
    """Weight of the first rule whose pattern a section path has."""
    out = F.lit(None).cast("double")
    for pattern, weight in reversed(rules):
        out = F.when(path.rlike(pattern), weight).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def rerank_order(hits: DataFrame, relay: float = 0.35, parent: float = 0.25, numeric: float = 0.2) -> DataFrame:
    """Model scores with boosts, times the section weight; relayed hits first.  Without model scores
    (null) the fused order stays, but for what numbers in the question add."""
    boost = relay * F.col("is_relay").cast("double") + parent * F.col("is_parent").cast("double") + numeric * F.col("numeric_match")
    score = F.when(F.col("model_score").isNotNull(), (F.col("model_score") + boost) * F.col("section_weight")).otherwise(F.col("fused_score") + numeric * F.col("numeric_match"))
    w = Window.partitionBy("qid").orderBy(F.desc("is_relay"), F.round("final_score", 12).desc(), "rank")
    return hits.withColumn("final_score", score).withColumn("final_rank", F.row_number().over(w))


def merged(hits: DataFrame) -> DataFrame:
    """Of each chunk the best hit over all sub-questions; relayed chunks first, then by score."""
    best = Window.partitionBy("qid", "chunk_id").orderBy(F.desc("score"), "group")
    kept = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("is_relay"), F.desc("score"), "chunk_id")))


def grouped_merge(hits: DataFrame, k: int) -> DataFrame:
    """max(2, k // groups) of each group, then the best of the others, k in all."""
    groups = F.size(F.collect_set("group").over(Window.partitionBy("qid")))
    place = F.row_number().over(Window.partitionBy("qid", "group").orderBy(F.desc("score"), "chunk_id"))
    own = hits.withColumn("_quota", F.greatest(F.lit(2), F.floor(F.lit(k) / groups))).withColumn("_place", place)
    own = own.withColumn("_late", (F.col("_place") > F.col("_quota")).cast("int"))
    one = Window.partitionBy("qid", "chunk_id").orderBy("_late", F.desc("score"), "group")
    own = own.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    w = Window.partitionBy("qid").orderBy("_late", F.when(F.col("_late") == 0, F.col("group")), F.desc("score"), "chunk_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_quota", "_place", "_late", "_n")


def round_robin(hits: DataFrame, k: int, content: str = "content", key_length: int = 240) -> DataFrame:
    """One hit of each group in turn, near-duplicates (equal beginnings) once."""
    start = F.substring(F.regexp_replace(F.lower(F.col(content)), "[^0-9a-z\\x{4E00}-\\x{9FFF}]", ""), 1, key_length)
    first = Window.partitionBy("qid", start).orderBy(F.desc("score"), "chunk_id")
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    turn = kept.withColumn("_turn", F.row_number().over(Window.partitionBy("qid", "group").orderBy(F.desc("score"), "chunk_id")))
    return turn.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_turn", "group", "chunk_id"))).where(F.col("rank") <= k).drop("_turn")


def rebalanced(hits: DataFrame, k: int, entity: str = "entity") -> DataFrame:
    """max(1, k // entities) hits of each entity, then hits without one; what an entity has beyond its
    share isn't used."""
    many = F.size(F.collect_set(entity).over(Window.partitionBy("qid")))
    place = F.row_number().over(Window.partitionBy("qid", entity).orderBy("rank"))
    own = hits.withColumn("_share", F.greatest(F.lit(1), F.floor(F.lit(k) / F.greatest(many, F.lit(1))))).withColumn("_place", place)
    own = own.where(F.col(entity).isNull() | (F.col("_place") <= F.col("_share")))
    w = Window.partitionBy("qid").orderBy(F.col(entity).isNull(), "rank", "chunk_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_share", "_place")


def first_healthy(levels: DataFrame, enough: int = 6, real: int = 2) -> DataFrame:
    """Of (qid, level, chunk_id, is_real, is_relay) the hits of each question's first level that is healthy:
    a relayed hit, or enough hits of which some are real; level 0 where none is."""
    health = levels.groupBy("qid", "level").agg(F.max(F.col("is_relay").cast("int")).alias("relay"), F.count("*").alias("n"), F.count_if("is_real").alias("real"))
    good = health.where((F.col("relay") == 1) | ((F.col("n") >= enough) & (F.col("real") >= real)))
    chosen = levels.select("qid").distinct().join(good.groupBy("qid").agg(F.min("level").alias("level")), "qid", "left").select("qid", F.coalesce("level", F.lit(0)).alias("level"))
    return levels.join(chosen, ["qid", "level"])


def exact_duplicates(hits: DataFrame, content: str = "content") -> DataFrame:
    """Hits without later ones of equal content."""
    first = Window.partitionBy("qid", F.sha2(F.col(content).cast("binary"), 256)).orderBy("rank", "chunk_id")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def containment_dedup(hits: DataFrame, content: str = "content", least: int = 40, most: int = 8192) -> DataFrame:
    """Hits of each question in rank order, without those that hold, or are held by, one kept before.
    Short texts are always kept.  A question's hits are few (a route's k), so they are folded in one array."""
    bare = F.translate(F.col(content), ", \n", "")
    own = exact_duplicates(hits, content).withColumn("_hit", F.struct("rank", "chunk_id", F.col(content).alias("text"), (F.length(bare) < least).alias("short"), (F.length(content) <= most).alias("able")))
    lists = own.groupBy("qid").agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))
    empty = F.slice("_hits", 1, 0)

    def step(kept: Column, h: Column) -> Column:
        clash = F.exists(kept, lambda x: x["able"] & ~x["short"] & (F.contains(x["text"], h["text"]) | F.contains(h["text"], x["text"])))
        return F.when(h["short"] | ~h["able"] | ~clash, F.concat(kept, F.array(h))).otherwise(kept)

    kept = lists.select("qid", F.explode(F.aggregate("_hits", empty, step)).alias("_hit"))
    return kept.select("qid", "_hit.chunk_id").join(hits, ["qid", "chunk_id"])


# --- neighbours of hits -------------------------------------------------------------------------


def parent_context(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits with their parent's text, given to the first hit of each parent only."""
    first = F.row_number().over(Window.partitionBy("qid", "doc_id", "parent_id").orderBy("rank", "chunk_id"))
    joined = hits.join(parents.select("doc_id", "parent_id", F.col("content").alias("parent_content")), ["doc_id", "parent_id"], "left")
    return joined.withColumn("parent_content", F.when(F.col("parent_id").isNotNull() & (first == 1), F.col("parent_content")))


def page_window(seeds: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """(qid, doc_id, chunk_id, page_distance, seq_distance, seed_rank): chunks within so many pages of a
    seed (qid, doc_id, page, seq, rank), by the nearest seed of the document."""
    s = seeds.select("qid", "doc_id", F.col("page").alias("_page"), F.col("seq").alias("_seq"), F.col("rank").alias("_rank"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - radius), F.col("page") + radius)).alias("page"))
    near = F.struct(F.abs(F.col("page") - F.col("_page")).alias("page_distance"), F.when(F.col("page") == F.col("_page"), F.abs(F.col("seq") - F.col("_seq"))).otherwise(10000).alias("seq_distance"), F.col("_rank").alias("seed_rank"))
    return chunks.join(s, ["doc_id", "page"]).groupBy("qid", "doc_id", "chunk_id").agg(F.min(near).alias("_near")).select("qid", "doc_id", "chunk_id", "_near.*")


def asof_section(pages: DataFrame, sections: DataFrame, key: str = "doc_id", at: str = "page", value: str = "path") -> DataFrame:
    """pages with the last section that begins on or before each, else the first: one sort for each key,
    no range join."""
    marks = sections.select(F.col(key), F.col(at), F.lit(0).alias("_kind"), F.col(value).alias("_value"), F.monotonically_increasing_id().alias("_tie"))
    rows = pages.withColumns({"_kind": F.lit(1), "_value": F.lit(None).cast(sections.schema[value].dataType), "_tie": F.lit(0).cast("long")})
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_kind", "_tie")
    found = F.coalesce(F.last("_value", ignorenulls=True).over(w), F.first("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn(value, found).where("_kind = 1").drop("_kind", "_value", "_tie")


def followed(rows: DataFrame, key: str, order: str, value: str, width: int = 4096) -> DataFrame:
    """rows (key, order: a whole number, value) with ``next``: the value of the key's next row.  Numbered in ranges
    of ``width``, so that no task holds a key; the last row of a range gets the first of the key's next range from a
    small table."""
    r = rows.withColumn("_range", F.floor(F.col(order) / width))
    own = r.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "_range").orderBy(order)))
    first = r.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_first"))
    later = first.select("_key", F.lag("_r").over(Window.partitionBy("_key").orderBy("_r")).alias("_r"), "_first").where("_r IS NOT NULL")
    joined = own.join(later, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_range") == F.col("_r")), "left")
    return joined.withColumn("next", F.coalesce("_next", "_first")["v"]).drop("_range", "_next", "_key", "_r", "_first")


def children(parents: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(qid, chunk_id, rank): the chunks of each question's parents (qid, doc_id, parent_id, rank), by the parent's
    rank, then by place."""
    found = chunks.join(parents.select("qid", "doc_id", "parent_id", F.col("rank").alias("_rank")), ["doc_id", "parent_id"])
    w = Window.partitionBy("qid").orderBy("_rank", "seq", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "chunk_id", "rank")


def section_fetch(chunks: DataFrame, docs: DataFrame, most: int = 5000) -> DataFrame:
    """Sections of the documents (qid, doc_id) asked for, in order of document, page, path and id: at most so many for
    each question."""
    found = chunks.where("chunk_type = 'section'").join(docs, "doc_id")
    w = Window.partitionBy("qid").orderBy("doc_id", "page", "path", "chunk_id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def hybrid(routes: list[DataFrame], injections: list[DataFrame], chunks: DataFrame, users: DataFrame, k: int = 8, candidates: int = 8) -> DataFrame:
    """(qid, chunk_id, rank, tier) of a batch of questions as one plan: the routes are fused, the best candidates of
    that are kept, hits of the injections (exact phrases, relayed facts) go before them, and what the asking user
    (users: qid, org, levels) may not read is left out before the first k are taken.  chunks: chunk_id, org, visibility."""
    fused = fuse(routes).where(F.col("rank") <= candidates).select("qid", "chunk_id", F.col("fused_score").alias("score"), "rank")
    every = injected([*injections, fused]).select("qid", "chunk_id", "tier", "position")
    allowed = every.join(chunks.select("chunk_id", "org", "visibility"), "chunk_id").join(users.select("qid", F.col("org").alias("_org"), "levels"), "qid")
    allowed = allowed.where((F.col("org") == F.col("_org")) & F.array_contains("levels", F.col("visibility")))
    return allowed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("position"))).where(F.col("rank") <= k).select("qid", "chunk_id", "tier", "rank")


def reranked_list(scores: Column, documents: Column, most: int | None = None) -> Column:
    """Array of {index, score, document}: by score, then as they came."""
    each = F.transform(scores, lambda s, i: F.struct((-s).alias("order"), i.alias("index"), s.alias("score"), F.get(documents, i).alias("document")))
    out = F.transform(F.array_sort(each), lambda x: F.struct(x["index"].alias("index"), x["score"].alias("score"), x["document"].alias("document")))
    return out if most is None else F.slice(out, 1, most)
