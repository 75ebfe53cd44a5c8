"""Retrieval queries: benchmark items are questions to documents; some vectors are questions to all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import positions, pq_index, pruned, term_blocks, vector_blocks
from docquarry.operators import retrieval as ops
from docquarry.operators import vector_index as ivf
from docquarry.plans.registry import register
from docquarry.plans.tables import TERMS_SQL, table, terms, words
from docquarry.sources.shared import written


def vector_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 20 as a question, and all vectors."""
    v = table(spark, sf_dir, "embeddings")
    questions = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").alias("wanted"))
    return questions, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q, c = vector_questions(spark, sf_dir)
    return ops.dense_route(q, c, k)


def text_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Terms of all benchmark items and, written once as several routes read them, of all documents."""
    return terms(table(spark, sf_dir, "benchmark"), "item_id", name="qid"), written(terms(table(spark, sf_dir, "documents"), "doc_id"), "terms")


def text_packs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Terms of all benchmark items and, packed and written once as several routes read them, of all documents."""
    packed = term_blocks.word_packs(table(spark, sf_dir, "documents").select("doc_id", "text"), words(F.col("text")))
    return terms(table(spark, sf_dir, "benchmark"), "item_id", name="qid"), written(packed, "term-packs")


_V = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
scored AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, q.label AS wanted, c.label AS label,
  round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 9) AS score FROM v q CROSS JOIN v c WHERE q.vec_id % 20 = 0)"""


def _top_sql(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


@register("dense_topk", f"WITH {_V} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({_top_sql('scored', 10)})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


_COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 9)"
_ANN = f"""{_V}, centre AS (SELECT vec_id AS list, e FROM v ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT {ivf.LISTS}),
near AS (SELECT v.vec_id, v.e, c.list, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_COS.format(a="v.e", b="c.e")} DESC, c.list) AS n FROM v CROSS JOIN centre c),
met AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, {_COS.format(a="q.e", b="c.e")} AS score FROM near q JOIN near c ON q.list = c.list AND q.n <= {ivf.PROBES} AND c.n = 1 AND q.vec_id % 20 = 0),
ann AS ({_top_sql("met", 10)})"""


def _indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = vector_questions(spark, sf_dir)
    middle = written(ivf.centres(c), "centres")
    return ivf.search(q, written(ivf.index(c, middle), "vector-index"), middle, 10)


@register("ann_topk", f"WITH {_ANN} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ann")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each question by the index of all vectors."""
    return _indexed_topk(spark, sf_dir).withColumn("score", F.round("score", 6))


@register("ann_recall", f"WITH {_ANN}, exact AS ({_top_sql('scored', 10)}) SELECT count(DISTINCT x.qid) AS questions, round(count(a.qid) / count(*), 6) AS recall FROM exact x LEFT JOIN ann a ON a.qid = x.qid AND a.chunk_id = x.chunk_id")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force."""
    return ivf.recall(_indexed_topk(spark, sf_dir), dense(spark, sf_dir, 10))


def _pq(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, pq_index.Model]:
    q, c = vector_questions(spark, sf_dir)
    model = pq_index.train(c)
    return q, c, written(pq_index.index(c, model), "pq-index"), model


@register("ann_pq_topk")
def ann_pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each question by trained lists and codes, scored exactly.  Trained centres have no SQL form:
    ann_pq_recall and tests hold it against brute force."""
    q, c, indexed, model = _pq(spark, sf_dir)
    return pq_index.search(q, indexed, c, model, 10).withColumn("score", F.round("score", 6))


@register("ann_pq_recall", "SELECT count(*) AS questions, CAST(10 * count(*) AS BIGINT) AS exact_hits, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least 0.9 of the exact ten nearest are found by the index."""
    q, c, indexed, model = _pq(spark, sf_dir)
    exact = written(dense(spark, sf_dir, 10), "exact-hits")
    got = ivf.recall(pq_index.search(q, indexed, c, model, 10), exact)
    return got.crossJoin(exact.agg(F.count("*").alias("exact_hits"))).select("questions", "exact_hits", (F.col("recall") >= 0.9).alias("enough"))


@register("dense_topk_filtered", f"WITH {_V}, f AS (SELECT * FROM scored WHERE label = wanted AND chunk_id <> qid) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({_top_sql('f', 5)})")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of each question among those of its label."""
    q, c = vector_questions(spark, sf_dir)
    hits = ops.top(ops.nearest_others(q.withColumnRenamed("wanted", "list"), c.withColumnRenamed("label", "list"), 5), 5)
    return hits.select("qid", "chunk_id", (F.round(F.col("score") * 1e6) / 1e6).alias("score"), "rank")  # halves as SQL rounds them


@register("topk_per_label", f"WITH {_V} SELECT qid, label, chunk_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored) WHERE rank <= 2")
def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = vector_questions(spark, sf_dir)
    w = Window.partitionBy("qid", "label").orderBy(F.desc("score"), "chunk_id")
    found = vector_blocks.nearest(q.select("qid", "vector"), c, 2, by="label")
    return found.select("qid", "label", "chunk_id", "score").withColumn("rank", F.row_number().over(w)).where("rank <= 2").drop("score")


@register("document_frequency", f"WITH {TERMS_SQL} SELECT term, count(*) AS df FROM doc_terms GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_frequency(text_terms(spark, sf_dir)[1])


@register("idf_table", f"WITH {TERMS_SQL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_terms) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM doc_terms, n GROUP BY term")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.idf_table(text_terms(spark, sf_dir)[1]).withColumn("idf", F.round("idf", 6))


_SPARSE = f"""{TERMS_SQL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_terms),
idf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM doc_terms, n GROUP BY term),
sparse AS (SELECT qid, doc_id AS chunk_id, round(sum(q.tf * idf * d.tf), 9) AS score FROM query_terms q JOIN idf USING (term) JOIN doc_terms d USING (term) WHERE q.tf * idf > 0 GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS len FROM doc_terms GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avg FROM len),
asked AS (SELECT DISTINCT qid, term FROM query_terms),
bdf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM doc_terms, st WHERE term IN (SELECT term FROM asked) GROUP BY 1),
bm AS (SELECT qid, d.doc_id AS chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg))), 9) AS score
  FROM asked JOIN doc_terms d USING (term) JOIN bdf USING (term) JOIN len USING (doc_id) CROSS JOIN st GROUP BY 1, 2 HAVING score > 0),
s10 AS ({_top_sql('sparse', 20)}), b10 AS ({_top_sql('bm', 20)})"""


@register("sparse_topk", f"WITH {_SPARSE} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM s10")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = text_packs(spark, sf_dir)
    return ops.sparse_route(q, d, 20, ops.idf_table(d)).withColumn("score", F.round("score", 6))


@register("bm25_topk", f"WITH {_SPARSE} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM b10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bm25_route(*text_packs(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@register("bm25_pruned_topk", f"WITH {_SPARSE} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM b10")
def bm25_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, by postings with bounds: those that can't bring a document into the best 20 aren't read."""
    q, d = text_packs(spark, sf_dir)
    return pruned.bm25(q, pruned.postings(d), 20)[0].withColumn("score", F.round("score", 6))


def two_routes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    q, d = text_packs(spark, sf_dir)
    return [ops.sparse_route(q, d, 20, ops.idf_table(d)), ops.bm25_route(q, d, 20)]


_FUSED = f"""{_SPARSE}, u AS (SELECT *, 0 AS route FROM s10 UNION ALL SELECT *, 1 FROM b10),
g AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS total, count(*) AS routes, min(rank) AS best_rank FROM u GROUP BY 1, 2)"""


@register("rrf_fuse", f"WITH {_FUSED} SELECT qid, chunk_id, routes, round(total, 9) AS fused_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(total, 12) DESC, chunk_id) AS INT) AS rank FROM g")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fuse(two_routes(spark, sf_dir)).select("qid", "chunk_id", "routes", F.round("fused_score", 9).alias("fused_score"), "rank")


@register(
    "rrf_route_aware",
    f"WITH {_FUSED} SELECT qid, chunk_id, best_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(1.0 / (60 + best_rank), 12) DESC, round(total, 12) DESC, chunk_id) AS INT) AS rank FROM g",
)
def rrf_route_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fuse(two_routes(spark, sf_dir), method="route_aware").select("qid", "chunk_id", "best_rank", "rank")


@register(
    "priority_injection",
    f"""WITH {_SPARSE}, u AS (SELECT *, 0 AS tier FROM s10 WHERE rank <= 3 UNION ALL SELECT *, 1 FROM b10),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY tier, rank) AS n FROM u) WHERE n = 1)
    SELECT qid, chunk_id, tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY tier, rank, chunk_id) AS INT) AS position FROM f""",
)
def priority_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse, bm = two_routes(spark, sf_dir)
    return ops.injected([sparse.where("rank <= 3"), bm]).select("qid", "chunk_id", "tier", "position")


def grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits by question, grouped by the label of what was found."""
    _, c = vector_questions(spark, sf_dir)
    return dense(spark, sf_dir, 30).join(c.select("chunk_id", "label"), "chunk_id").withColumnRenamed("label", "group")


_HITS = f"{_V}, hits AS (SELECT qid, chunk_id, score, rank, label AS grp FROM ({_top_sql('scored', 30)}))"


@register(
    "coverage_round_robin",
    f"""WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, chunk_id) AS turn FROM hits),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY turn, grp, chunk_id) AS INT) AS rank2 FROM t)
    SELECT qid, chunk_id, grp AS "group", rank2 AS rank FROM r WHERE rank2 <= 8""",
)
def coverage_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = grouped_hits(spark, sf_dir).withColumn("content", F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    return ops.round_robin(hits, 8).select("qid", "chunk_id", "group", "rank")


@register(
    "grouped_merge",
    f"""WITH {_HITS}, q AS (SELECT *, greatest(2, 8 // count(DISTINCT grp) OVER (PARTITION BY qid)) AS quota, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, chunk_id) AS place FROM hits),
    r AS (SELECT *, CAST(place > quota AS INT) AS late FROM q),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY late, CASE WHEN late = 0 THEN grp END NULLS FIRST, score DESC, chunk_id) AS INT) AS rank2 FROM r)
    SELECT qid, chunk_id, grp AS "group", rank2 AS rank FROM o WHERE rank2 <= 8""",
)
def grouped_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grouped_merge(grouped_hits(spark, sf_dir), 8).select("qid", "chunk_id", "group", "rank")


@register(
    "rebalance_groups",
    f"""WITH {_HITS}, e AS (SELECT *, CASE WHEN grp < 4 THEN grp END AS entity FROM hits),
    q AS (SELECT *, greatest(1, 8 // greatest(count(DISTINCT entity) OVER (PARTITION BY qid), 1)) AS share, row_number() OVER (PARTITION BY qid, entity ORDER BY rank) AS place FROM e),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY entity IS NULL, rank, chunk_id) AS INT) AS rank2 FROM q WHERE entity IS NULL OR place <= share)
    SELECT qid, chunk_id, entity, rank2 AS rank FROM o WHERE rank2 <= 8""",
)
def rebalance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = grouped_hits(spark, sf_dir).withColumn("entity", F.when(F.col("group") < 4, F.col("group")))
    return ops.rebalanced(hits, 8).select("qid", "chunk_id", "entity", "rank")


@register(
    "fallback_ladder",
    f"""WITH {_V}, l AS (SELECT qid, 0 AS level, chunk_id, score FROM scored WHERE label = wanted AND score > 0.3 UNION ALL SELECT qid, 1, chunk_id, score FROM scored WHERE label = wanted AND score > 0.1
      UNION ALL SELECT qid, 2, chunk_id, score FROM scored WHERE score > 0.2),
    h AS (SELECT qid, level FROM l GROUP BY 1, 2 HAVING count(*) >= 6 AND count(*) FILTER (score > 0.25) >= 2),
    c AS (SELECT q.qid, coalesce(min(h.level), 0) AS level FROM (SELECT DISTINCT qid FROM l) q LEFT JOIN h ON q.qid = h.qid GROUP BY 1)
    SELECT l.qid, l.level, l.chunk_id FROM l JOIN c ON l.qid = c.qid AND l.level = c.level""",
)
def fallback_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = vector_questions(spark, sf_dir)
    return vector_blocks.first_level(q, c, [(0.3, True), (0.1, True), (0.2, False)], "label", "wanted")


@register(
    "char_ngram_overlap",
    """WITH a AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM benchmark),
    g AS (SELECT item_id, list_distinct([substr(s, CAST(i AS BIGINT), 2) for i in range(1, length(s))]) AS g FROM a),
    p AS (SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN len(x.g) + len(y.g) > 0 THEN 2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) ELSE 0.0 END, 6) AS overlap
      FROM g x JOIN g y ON x.item_id % 20 = 0 AND x.item_id <> y.item_id)
    SELECT a, b, overlap FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) AS n FROM p) WHERE n <= 10""",
)
def char_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items nearest by Dice overlap to each item whose id is divisible by 20, over whole texts: a
    stated question set against all rows, in blocks."""
    g = table(spark, sf_dir, "benchmark").select("item_id", T.char_ngrams(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 2, 2).alias("g"))
    asked, all_items = g.where("item_id % 20 = 0").select(F.col("item_id").alias("a"), F.col("g").alias("x")), g.select(F.col("item_id").alias("b"), F.col("g").alias("y"))
    pairs = all_items.join(asked, F.col("a") != F.col("b")).select("a", "b", F.round(T.dice(F.col("x"), F.col("y")), 6).alias("overlap"))
    return ops.top(pairs, 10, "a", "overlap", "b").drop("rank")


@register(
    "question_in_document",
    "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def question_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item word for word."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked"))
    return positions.containing(asked, table(spark, sf_dir, "documents").select("doc_id", "text"), "asked", "text").select("item_id", "doc_id")


@register(
    "hybrid_text_search",
    f"""WITH {_FUSED}, f AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(total, 12) DESC, chunk_id) AS INT) AS rank FROM g),
    held AS (SELECT b.item_id AS qid, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    x AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS rank FROM held),
    t AS (SELECT qid, chunk_id, 0 AS tier, rank FROM x UNION ALL SELECT qid, chunk_id, 1, rank FROM f WHERE rank <= 16),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY tier, rank) AS n FROM t) WHERE n = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, rank, chunk_id) AS position FROM o),
    a AS (SELECT p.qid, p.chunk_id, p.tier, d.source, CAST(row_number() OVER (PARTITION BY p.qid ORDER BY position) AS INT) AS rank FROM p JOIN documents d ON d.doc_id = p.chunk_id
      WHERE d.doc_id % 5 <> p.qid % 5 AND (d.doc_id % 3 <> 0 OR p.qid % 2 = 1))
    SELECT qid, chunk_id, tier, rank, row_number() OVER (PARTITION BY qid, source ORDER BY rank) = 1 AND source IS NOT NULL AS opens_parent FROM a WHERE rank <= 8""",
)
def hybrid_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items asked of all documents as one plan: two routes over terms are fused; documents that hold an item word for
    word go first; organisation and level of the asking user decide what may be read; the first hit of a source opens it."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    exact = positions.containing(benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("asked")), documents.select(F.col("doc_id").alias("chunk_id"), "text"), "asked", "text")
    w = Window.partitionBy("qid").orderBy("chunk_id")
    exact = exact.select("qid", "chunk_id", F.lit(1.0).alias("score"), F.row_number().over(w).alias("rank"))
    k = F.col("chunk_id")
    user = benchmark.select(F.col("item_id").alias("qid"))
    chunks = documents.select(F.col("doc_id").alias("chunk_id"), "source").select("chunk_id", "source", (k % 5).cast("string").alias("org"), F.when(k % 3 == 0, "internal").otherwise("public").alias("visibility"))
    # a user belongs to all organisations but one, and reads internal papers if the number is odd
    orgs = F.filter(F.array(*map(F.lit, "01234")), lambda o: o != (F.col("qid") % 5).cast("string"))
    levels = F.when(F.col("qid") % 2 == 1, F.array(F.lit("public"), F.lit("internal"))).otherwise(F.array(F.lit("public")))
    users = user.select("qid", F.explode(orgs).alias("org"), levels.alias("levels"))
    found = ops.hybrid(two_routes(spark, sf_dir), [exact], chunks, users, 8, 16)
    hits = found.join(chunks.select("chunk_id", F.col("source").alias("parent_id"), F.lit(0).alias("doc_id")), "chunk_id")
    parents = chunks.where("source IS NOT NULL").select(F.lit(0).alias("doc_id"), F.col("source").alias("parent_id")).distinct().withColumn("content", F.col("parent_id"))
    return ops.parent_context(hits, parents).select("qid", "chunk_id", "tier", "rank", F.col("parent_content").isNotNull().alias("opens_parent"))
