"""Evidence graph, section, registry and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import questions as Q
from docquarry.operators import chunking, context, evaluation, graph, registry, sections
from docquarry.operators import retrieval as R
from docquarry.plans.corpus import LEAVES_SQL
from docquarry.plans.registry import register
from docquarry.plans.retrieval import _SPARSE, text_packs
from docquarry.plans.tables import FACTS_SQL, facts, table


@register(
    "graph_evidence",
    f"WITH {FACTS_SQL} SELECT company AS query, 'chunk:' || company || ':' || chunk_id AS node FROM facts WHERE metric = 'eps' AND year = 1995",
)
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks within two edges of both a metric and a year, for each company's own graph."""
    f = facts(spark, sf_dir).withColumn("doc_id", F.col("company"))
    node = lambda kind, value: F.concat_ws(":", F.lit(kind), "company", F.lit(value))
    sets = F.explode(F.array(F.struct(F.lit("metric").alias("set"), node("metric", "eps").alias("node")), F.struct(F.lit("year").alias("set"), node("year", "1995").alias("node")))).alias("s")
    anchors = f.select("company").distinct().select(F.col("company").alias("query"), sets).select("query", "s.*")
    return graph.evidence(graph.edges_of_facts(f), anchors)


@register(
    "graph_edge_counts",
    f"""WITH {FACTS_SQL}, e AS (SELECT company, 'HAS_FACT' AS kind, metric, CAST(year AS VARCHAR) AS x FROM facts UNION SELECT company, 'OF_METRIC', metric, CAST(year AS VARCHAR) FROM facts
      UNION SELECT company, 'IN_YEAR', metric, CAST(year AS VARCHAR) FROM facts UNION SELECT company, 'EVIDENCED_BY', metric, chunk_id FROM facts
      UNION SELECT company, 'PREVIOUS_PERIOD', metric, CAST(y AS VARCHAR) FROM (SELECT company, metric, year AS y, row_number() OVER (PARTITION BY company, metric ORDER BY year) AS n FROM (SELECT DISTINCT company, metric, year FROM facts)) WHERE n > 1)
    SELECT kind, count(*) AS edges FROM e GROUP BY kind""",
)
def graph_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("doc_id", F.col("company"))
    return graph.edges_of_facts(f).groupBy("kind").agg(F.count("*").alias("edges"))


_SECTIONS = """q AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM benchmark),
    d AS (SELECT source AS doc_id, doc_id AS section_id, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(text[:600]), '[^a-z0-9]', '', 'g') AS c FROM documents),
    qg AS (SELECT qid, doc_id, list_distinct([substr(s, i, 2) for i in range(1, length(s))] || [substr(s, i, 3) for i in range(1, length(s) - 1)] || [substr(s, i, 4) for i in range(1, length(s) - 2)] || [substr(s, i, 5) for i in range(1, length(s) - 3)]) AS g FROM q),
    dg AS (SELECT doc_id, section_id, list_distinct([substr(p, i, 2) for i in range(1, length(p))] || [substr(p, i, 3) for i in range(1, length(p) - 1)] || [substr(p, i, 4) for i in range(1, length(p) - 2)] || [substr(p, i, 5) for i in range(1, length(p) - 3)]) AS pg,
      list_distinct([substr(c, i, 2) for i in range(1, length(c))] || [substr(c, i, 3) for i in range(1, length(c) - 1)] || [substr(c, i, 4) for i in range(1, length(c) - 2)] || [substr(c, i, 5) for i in range(1, length(c) - 3)]) AS cg FROM d),
    scored AS (SELECT qid, doc_id, section_id, CAST(3 * coalesce(list_sum([length(x) * length(x) for x in list_intersect(g, pg)]), 0) + coalesce(list_sum([length(x) * length(x) for x in list_intersect(g, cg)]), 0) AS INT) AS score FROM qg JOIN dg USING (doc_id))"""


@register(
    "section_scores",
    f"""WITH {_SECTIONS}
    SELECT qid, section_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id) AS n FROM scored) WHERE n <= 30""",
)
def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions to the documents of one source each, these as its sections (whole first
    lines as paths; of the content the first 600 characters, which is the score's definition): the best 30."""
    return R.top(_section_scores(spark, sf_dir), 30, tie="section_id").select("qid", "section_id", F.col("score").cast("int").alias("score"))


def _section_scores(spark: SparkSession, sf_dir: str, content_chars: int | None = 600) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc_id"), F.col("text").alias("question"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_id"), F.lit(1).alias("page"), F.get(F.split("text", "\n"), F.lit(0)).alias("path"), F.col("text").alias("content"))
    return sections.scored(q, s, content_chars)


#: The same with the whole content.
_WHOLE_SECTIONS = _SECTIONS.replace("text[:600]", "text")


@register(
    "section_coverage",
    f"""WITH {_WHOLE_SECTIONS},
    b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id) AS best FROM scored),
    f AS (SELECT *, best <= 10 AND score > 0 AS first FROM b),
    c AS (SELECT *, 30 - count(*) FILTER (first) OVER (PARTITION BY qid) AS quota, row_number() OVER (PARTITION BY qid, doc_id, first ORDER BY section_id) - 1 AS i, count(*) OVER (PARTITION BY qid, doc_id, first) AS n FROM f),
    s AS (SELECT *, least(n, greatest(1, quota // (SELECT count(DISTINCT doc_id) FROM c o WHERE o.qid = c.qid))) AS share FROM c),
    e AS (SELECT *, least(share, round(share * 0.8)) AS heads FROM s),
    t AS (SELECT *, CASE WHEN first THEN 0 WHEN i < heads OR floor((i - heads + 1) * (share - heads) / greatest(n - heads, 1)) - floor((i - heads) * (share - heads) / greatest(n - heads, 1)) >= 1 THEN 1 ELSE 2 END AS tier FROM e),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier = 0 THEN best ELSE i END, doc_id, section_id) AS INT) AS position FROM t)
    SELECT qid, doc_id, section_id, position FROM o WHERE position <= 30""",
)
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sections of each question by their whole texts, then an even share of the others."""
    return sections.covered(_section_scores(spark, sf_dir, None).withColumn("page", F.col("section_id")), limit=30)


@register(
    "question_classes",
    """SELECT conv_id, turn, contains(lower(text), 'summar') OR contains(lower(text), 'overview') OR contains(lower(text), 'trend') AS summary,
    contains(lower(text), 'verify') OR contains(lower(text), 'claim') OR contains(lower(text), 'rumor') AS verification,
    CASE WHEN contains(lower(text), 'roa') OR contains(lower(text), 'roe') OR contains(lower(text), 'eps') THEN 'metric' ELSE 'general' END AS query_type FROM conversations""",
)
def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.is_summary(t).alias("summary"), Q.is_verification(t).alias("verification"), Q.query_type(t).alias("query_type"))


@register(
    "page_pool",
    f"""WITH {_SPARSE}, pr AS (SELECT qid, chunk_id, rank FROM s10 WHERE rank <= 5), new AS (SELECT qid, chunk_id, rank FROM b10 WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.qid = b10.qid AND pr.chunk_id = b10.chunk_id)),
    u AS (SELECT *, 0 AS t FROM pr UNION ALL SELECT *, 1 FROM new) SELECT qid, chunk_id AS page, CAST(row_number() OVER (PARTITION BY qid ORDER BY t, rank, chunk_id) AS INT) AS position FROM u""",
)
def page_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the sparse route first, then what BM25 adds."""
    q, d = text_packs(spark, sf_dir)
    as_page = lambda df: df.select("qid", F.lit(0).alias("doc_id"), F.col("chunk_id").alias("page"), "rank")
    prior, more = as_page(R.sparse_route(q, d, 20, R.idf_table(d)).where("rank <= 5")), as_page(R.bm25_route(q, d, 20))
    return sections.page_pool(prior, more).select("qid", "page", "position")


@register("latest_order", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@register("labelled_documents", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register(
    "set_operations",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(c.intersect(s), "both").unionByName(count(c.exceptAll(s).join(s, "k", "left_anti").distinct(), "customers only")).unionByName(count(c.union(s).distinct(), "either"))


@register(
    "upserted_orders",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1",
)
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest even order of each customer, with the newest odd one in its place where there is one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    newest = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return registry.upserted(newest(o.where("o_orderkey % 2 = 0")), newest(o.where("o_orderkey % 2 = 1")), ["o_custkey"])


@register(
    "index_counts",
    "SELECT source, count(*) AS documents, count(*) FILTER (n_chars < 500) AS short, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source",
)
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


@register(
    "adjacent_similarity",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT vec_id, label, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM v)
    SELECT vec_id, label, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS similarity FROM p WHERE f IS NOT NULL""",
)
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.functions import vectors

    v = R.followed(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").where("next IS NOT NULL")
    return v.select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@register(
    "packed_context",
    f"""WITH RECURSIVE {LEAVES_SQL}, pack AS (SELECT doc_id, seq, length(content) + 40 <= {context.TOTAL} AS kept, CASE WHEN length(content) + 40 <= {context.TOTAL} THEN length(content) + 40 ELSE 0 END AS used FROM leaf WHERE seq = 0
      UNION ALL SELECT l.doc_id, l.seq, used + length(l.content) + 40 <= {context.TOTAL}, used + CASE WHEN used + length(l.content) + 40 <= {context.TOTAL} THEN length(l.content) + 40 ELSE 0 END FROM pack p JOIN leaf l ON l.doc_id = p.doc_id AND l.seq = p.seq + 1)
    SELECT doc_id AS qid, seq AS chunk_id, CAST(length(content) AS INT) AS chars FROM pack JOIN leaf USING (doc_id, seq) WHERE kept""",
)
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of each document as blocks in rank order, whole ones under the budget."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    leaf = chunking.leaves(d).select(F.col("doc_id").alias("qid"), F.col("seq").alias("chunk_id"), F.col("seq").alias("rank"), "content")
    return context.packed(leaf).select("qid", "chunk_id", F.length("content").alias("chars"))


@register("extraction_report", "SELECT CAST(quality AS VARCHAR) AS part, count(*) AS questions, round(avg(toxic), 6) AS toxic FROM labels GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(toxic), 6) FROM labels")
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(table(spark, sf_dir, "labels"), ["quality"], ["toxic"])
