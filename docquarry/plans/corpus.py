"""Cleaning, structure, chunking and registry queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import chunking, clean, graph, registry
from docquarry.operators import retrieval as R
from docquarry.plans.registry import register
from docquarry.plans.tables import table

_WS = "[\\t\\n\\x0B\\f\\r ]"
_STRIP = f"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')"
_LINES = f"""l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
s AS (SELECT *, {_STRIP} AS s FROM l)"""
_LINES_F = _LINES.replace("FROM documents", "FROM f")
_NOISE = """s = '' OR lower(s) IN ('contents', 'table of contents', 'toc', 'page', '(this page intentionally left blank)')
      OR regexp_full_match(s, '[0-9.,\\-—–/\\\\%:：()（）\\t\\n\\x0B\\f\\r ]+') OR regexp_full_match(lower(s), 'page[ \\t]*[0-9]+[ \\t]*(of[ \\t]*[0-9]+)?') OR regexp_full_match(s, '[-—–_=*·~.\\t ]{2,}')"""
_HEADS = """h AS (SELECT doc_id, n, s, CASE WHEN length(s) <= 40 AND upper(s) = s AND lower(s) <> s THEN 1
      WHEN regexp_full_match(s, '[0-9]{1,2}([.][0-9]{1,2}){0,3}[\\t ]+.{1,60}') THEN length(regexp_extract(s, '^([0-9]{1,2}([.][0-9]{1,2}){0,3})', 1)) - length(replace(regexp_extract(s, '^([0-9]{1,2}([.][0-9]{1,2}){0,3})', 1), '.', '')) + 1
      WHEN regexp_full_match(s, '[(][0-9]+[)][\\t ]*.{1,60}') THEN 2 END AS level FROM s WHERE s <> '' AND length(s) <= 80)"""
#: Leaves of each document (the driver's have no Han characters): a step for each piece, with what has been gathered.
LEAVES_SQL = f"""{_LINES}, own AS (SELECT doc_id, flatten(list(CASE WHEN length(s) // 4 > {chunking.MOST} THEN
      [x for x in [regexp_replace(y, '^{_WS}+|{_WS}+$', '', 'g') for y in regexp_extract_all(s, '[^。；;!?！？]*[。；;!?！？]|[^。；;!?！？]+$')] if x <> ''] ELSE [s] END ORDER BY n)) AS a FROM s WHERE NOT ({_NOISE}) GROUP BY 1),
cut AS (SELECT doc_id, flatten([CASE WHEN length(x) // 4 > {chunking.MOST} THEN [substr(x, CAST(i * {chunking.MOST * 4} + 1 AS BIGINT), {chunking.MOST * 4}) for i in range((length(x) - 1) // {chunking.MOST * 4} + 1)] ELSE [x] END for x in a]) AS a FROM own),
piece AS MATERIALIZED (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS m FROM cut),
fold AS (SELECT doc_id, m, 0 AS seq, line AS content FROM piece WHERE m = 0
  UNION ALL SELECT p.doc_id, p.m, f.seq + CAST((length(content) + 1 + length(line)) // 4 > {chunking.TARGET} AS INT),
    CASE WHEN (length(content) + 1 + length(line)) // 4 > {chunking.TARGET} THEN right(content, {chunking.OVERLAP_CHARS}) ELSE content END || chr(10) || line FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.m = f.m + 1),
leaf AS MATERIALIZED (SELECT doc_id, seq, arg_max(content, m) AS content, CAST(greatest(1, length(arg_max(content, m)) // 4) AS INT) AS tokens FROM fold GROUP BY 1, 2)"""


#: What stands at the end of a report's page, put after each document.
_FOOT = "chr(10) || '— ' || CAST(doc_id % 90 AS VARCHAR) || ' —' || chr(10) || 'Page ' || CAST(doc_id % 9 AS VARCHAR) || ' of 9' || chr(10) || '投资' || CAST(doc_id % 30 AS VARCHAR) || '.5 亿元'"
_FOOTED = f"f AS (SELECT * REPLACE (text || {_FOOT} AS text) FROM documents)"


def footed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page number, a noise line and a number with its unit at the end."""
    n = lambda m: (F.col("doc_id") % m).cast("string")
    foot = F.concat(F.lit("\n— "), n(90), F.lit(" —\nPage "), n(9), F.lit(" of 9\n投资"), n(30), F.lit(".5 亿元"))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", foot))


def footed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footed(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@register(
    "content_fingerprint",
    f"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g')))) AS fingerprint FROM documents",
)
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@register(
    "exact_duplicates",
    f"""WITH f AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g')))) AS fp FROM documents)
    SELECT fp AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM f GROUP BY 1 HAVING count(*) > 1""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return f.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@register(
    "noise_lines",
    f"""WITH {_FOOTED}, {_LINES_F} SELECT doc_id, CAST(n AS INT) AS n FROM s WHERE {_NOISE}""",
)
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footed_lines(spark, sf_dir).where(T.is_noise_line(F.col("line"))).select("doc_id", "n")


@register(
    "repeated_lines",
    f"""WITH {_LINES}, t AS (SELECT DISTINCT source, doc_id, s FROM s WHERE s <> '' AND greatest(1, length(s) // 4) <= 24),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY 1)
    SELECT source AS doc_id, s AS key, count(*) AS "on", any_value(pages) AS pages FROM t JOIN p USING (source) GROUP BY 1, 2 HAVING any_value(pages) >= 3 AND count(*) >= greatest(2, floor(any_value(pages) * 0.02))""",
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a fiftieth of a source's documents, each document taken as a page of its source."""
    own = document_lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "line")
    return clean.repeated_lines(own, share=0.02)


@register("page_number_lines", f"WITH {_FOOTED}, {_LINES_F} SELECT doc_id, CAST(n AS INT) AS n FROM s WHERE regexp_full_match(lower(s), '[-—–]?[ \\t]*([0-9]{{1,4}}|(page|p\\.?)[ \\t]*[0-9]{{1,4}})[ \\t]*[-—–]?')")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footed_lines(spark, sf_dir).where(T.is_page_number(F.col("line"))).select("doc_id", "n")


@register(
    "heading_lines",
    f"WITH {_LINES}, {_HEADS} SELECT doc_id, CAST(n AS INT) AS n, CAST(level AS INT) AS level FROM h WHERE level IS NOT NULL",
)
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).withColumn("level", T.heading_level(F.col("line"))).where("level IS NOT NULL").select("doc_id", "n", "level")


@register("token_counts", "SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents have no Han characters, so the estimate is a fourth of the characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), T.token_count(F.col("text")).alias("tokens"))


@register(
    "page_quality",
    "SELECT doc_id, round(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]')) / length(text), 6) AS bad_ratio, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]')) / length(text) <= 0.02 AS good FROM documents",
)
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean.page_quality(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(q["bad_ratio"], 6).alias("bad_ratio"), q["good"].alias("good"))


@register(
    "html_to_lines",
    """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(h, '(?i)</?(p|div|tr|br|li|ul|ol|table|h[1-6]|nav|article|section|header|footer|title|body|head)([ /][^>]*)?>', chr(10), 'g') AS h FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</t[dh]>', chr(9), 'g'), '<[^>]*>', '', 'g') AS h FROM b),
    d AS (SELECT page_id, [trim(regexp_replace(x, '[\\t\\x0B\\f\\r ]+', ' ', 'g')) for x in string_split(h, chr(10))] AS l FROM c),
    e AS (SELECT page_id, [x for x in l if x <> ''] AS l FROM d)
    SELECT page_id, unnest(l) AS line, CAST(unnest(range(len(l))) AS INT) AS n FROM e""",
)
def html_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(clean.html_lines(F.col("html"))).alias("n", "line"))


@register(
    "number_phrases",
    f"""WITH {_FOOTED}, p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(' ' || text, '[^0-9,.]([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:[.][0-9]+)?|[0-9]{{1,3}}(?:[.][0-9]+)?)[\\t\\n ]*(?:个百分点|百万元|千万元|亿元|千元|万元|万亿|百万|倍|%|万户|万人|家|台|个|户|笔|人|名|次|条|项|处|件)', 0))) AS p FROM f)
    SELECT DISTINCT doc_id, replace(replace(replace(p[2:], ',', ''), ' ', ''), chr(10), '') AS phrase FROM p""",
)
def number_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = footed(spark, sf_dir).select("doc_id", F.explode(T.number_phrases(F.col("text"))).alias("p"))
    return found.select("doc_id", T.without_separators(F.col("p")).alias("phrase")).distinct()


@register("leaf_chunks", f"WITH RECURSIVE {LEAVES_SQL} SELECT doc_id, seq, 1 AS page, content, tokens FROM leaf")
def leaf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.leaves(table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text"))


@register(
    "parent_chunks",
    f"""WITH RECURSIVE {LEAVES_SQL}, up AS (SELECT doc_id, seq, 0 AS parent, tokens AS used FROM leaf WHERE seq = 0
      UNION ALL SELECT l.doc_id, l.seq, parent + CAST(used + l.tokens > {chunking.PARENT} AS INT), CASE WHEN used + l.tokens > {chunking.PARENT} THEN 0 ELSE used END + l.tokens FROM up u JOIN leaf l ON l.doc_id = u.doc_id AND l.seq = u.seq + 1)
    SELECT doc_id, parent, CAST(count(*) AS INT) AS leaves, CAST(sum(length(content)) + 2 * (count(*) - 1) AS INT) AS chars FROM up JOIN leaf USING (doc_id, seq) GROUP BY 1, 2""",
)
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = leaf_chunks(spark, sf_dir).withColumn("path", F.lit("文档正文"))
    return chunking.parents(leaf).select("doc_id", "parent", F.size("seqs").alias("leaves"), F.length("content").alias("chars"))


@register(
    "section_tree",
    f"""WITH {_LINES}, {_HEADS}, t AS (SELECT * FROM h WHERE level IS NOT NULL),
    p AS (SELECT x.doc_id, x.n, x.level, string_agg(a.s, ' > ' ORDER BY a.n) AS path FROM t x JOIN t a ON a.doc_id = x.doc_id AND (a.n = x.n OR a.n < x.n AND a.level < x.level
      AND NOT EXISTS (SELECT 1 FROM t k WHERE k.doc_id = x.doc_id AND k.n > a.n AND k.n < x.n AND k.level <= a.level)) GROUP BY 1, 2, 3)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS seq, CAST(level AS INT) AS level, path FROM p
    UNION ALL SELECT DISTINCT doc_id, 0, 1, '文档正文' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM t)""",
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_tree(document_lines(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "n", "line")).select("doc_id", "seq", "level", "path")


@register(
    "hard_pieces",
    "SELECT doc_id, CAST(i AS INT) AS n, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS piece FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0)",
)
def hard_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_pieces(F.col("text"), 1000)).alias("n", "piece"))


@register(
    "sentence_counts",
    "SELECT doc_id, CAST(len([s for s in regexp_extract_all(text, '[^;!?]*[;!?]|[^;!?]+$') if trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '']) AS INT) AS sentences FROM documents",
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@register(
    "section_asof",
    """WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    e AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> (SELECT min(event_type) FROM events)),
    f AS (SELECT user_id, arg_min(event_id, ts) AS first_id FROM m GROUP BY 1)
    SELECT e.event_id, coalesce(a.event_id, f.first_id) AS section FROM e LEFT JOIN f ON e.user_id = f.user_id ASOF LEFT JOIN m a ON e.user_id = a.user_id AND e.ts >= a.ts""",
)
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type are sections; each other event has the last one on or before it, else the first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    least = e.agg(F.min("event_type").alias("t"))  # one row
    marked = e.join(F.broadcast(least)).withColumn("mark", F.col("event_type") == F.col("t"))
    pages = marked.where("NOT mark").select("user_id", "ts", "event_id")
    return R.asof_section(pages, marked.where("mark").select("user_id", "ts", F.col("event_id").alias("section")), "user_id", "ts", "section").select("event_id", "section")


@register(
    "page_window",
    """WITH p AS (SELECT doc_id, doc_id // 10 AS d, doc_id % 10 + 1 AS page, n_chars AS seq FROM documents), s AS (SELECT *, doc_id % 10 + 1 AS rank FROM p WHERE page IN (3, 7)),
    j AS (SELECT s.doc_id AS qid, p.d AS doc_id, p.doc_id AS chunk_id, row(abs(p.page - s.page), CASE WHEN p.page = s.page THEN abs(p.seq - s.seq) ELSE 10000 END) AS near FROM s JOIN p ON p.d = s.d AND abs(p.page - s.page) <= 1)
    SELECT qid, doc_id, chunk_id, CAST(near[1] AS INT) AS page_distance, near[2] AS seq_distance FROM (SELECT qid, doc_id, chunk_id, min(near) AS near FROM j GROUP BY 1, 2, 3)""",
)
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents in a row are the pages of one; its third and seventh pages are seeds."""
    p = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("doc_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("page"), F.col("n_chars").alias("seq"))
    seeds = p.where("page IN (3, 7)").select(F.col("chunk_id").alias("qid"), "doc_id", "page", "seq", F.col("page").alias("rank"))
    return R.page_window(seeds, p, 1).select("qid", "doc_id", "chunk_id", "page_distance", "seq_distance")


@register(
    "parent_runs",
    """WITH c AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS events FROM r GROUP BY 1, 2""",
)
def parent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    r = chunking.runs(e, "user_id", ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.first("event_type").alias("event_type"), F.count("*").alias("events"))


@register(
    "visibility_filter",
    "SELECT doc_id, source AS org, ['public', 'internal', 'restricted'][doc_id % 3 + 1] AS visibility FROM documents WHERE source = 'src1' AND doc_id % 3 IN (0, 1)",
)
def visibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one organisation that a user of the middle level may read."""
    level = F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("restricted")), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("org"), level.alias("visibility"))
    return R.visible(d, "src1", R.visible_levels("internal"))


@register(
    "reconcile_index",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN d.lang <> 'en' AND l.doc_id IS NOT NULL THEN 'residual' WHEN d.lang <> 'en' THEN 'ok' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS state
    FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""",
)
def reconcile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the index of documents, of which those in English should be there."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("indexed"), F.lit(1).alias("total"), F.lit(0).alias("summaries"))
    index = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("count"))
    return registry.reconcile(d, index).select("doc_id", "state")


@register(
    "duplicate_uploads",
    """WITH k AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1),
    s AS (SELECT source, h, max(doc_id) AS same FROM k GROUP BY 1, 2)
    SELECT n.doc_id, CASE WHEN same % 5 = 0 THEN 'replace' WHEN same IS NOT NULL THEN 'duplicate' ELSE 'new' END AS decision, same AS "of" FROM n LEFT JOIN s ON n.source = s.source AND n.h = s.h""",
)
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents arrive where even ones are known (each fifth id failed)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("org"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    known = d.where("doc_id % 2 = 0").select("*", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("filename"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("indexed").alias("status"))
    new = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("new_id"), "org", "sha256", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("filename"))
    return registry.arrivals(new, known).select(F.col("new_id").alias("doc_id"), "decision", "of")


@register(
    "graph_reachability",
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
    b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), f AS (SELECT 'r' || r_regionkey AS anchor, 'r' || r_regionkey AS node, 0 AS distance FROM region
      UNION SELECT f.anchor, b.dst, f.distance + 1 FROM f JOIN b ON f.node = b.src WHERE f.distance < 2)
    SELECT anchor, node, min(distance) AS distance FROM f GROUP BY 1, 2""",
)
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations within two edges of each region."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))
    customer = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"))
    anchors = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"))
    return graph.reachable(nation.unionByName(customer), anchors, 2)


_EDGES = """g AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
      UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation),
    b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), deg AS (SELECT src, count(*) AS n FROM b GROUP BY 1)"""


@register(
    "graph_paths",
    f"""WITH RECURSIVE {_EDGES},
    q AS (SELECT c_custkey AS query, 'c' || CAST(c_custkey AS VARCHAR) AS a, 's' || CAST(s_suppkey AS VARCHAR) AS b FROM customer JOIN supplier ON s_suppkey = c_custkey % 97 WHERE c_custkey % 20 = 0),
    p AS (SELECT query, b AS goal, a AS node, [a] AS path FROM q UNION ALL
      SELECT p.query, p.goal, e.dst, list_append(p.path, e.dst) FROM p JOIN b e ON e.src = p.node JOIN deg ON deg.src = p.node
      WHERE p.node <> p.goal AND len(p.path) <= 4 AND NOT list_contains(p.path, e.dst) AND (len(p.path) = 1 OR deg.n <= 100) AND (e.dst = p.goal OR e.dst NOT LIKE 'c%')),
    f AS (SELECT query, path, len(path) AS l, min(len(path)) OVER (PARTITION BY query) AS least FROM p WHERE node = goal)
    SELECT query, array_to_string(path, '>') AS path FROM f WHERE l = least""",
)
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ways from customers to suppliers through nations and regions that aren't too large."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    edges = customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    edges = edges.unionByName(supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).unionByName(nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    pairs = customer.where("c_custkey % 20 = 0").join(supplier, F.col("s_suppkey") == F.col("c_custkey") % 97).select(F.col("c_custkey").alias("query"), name("c", "c_custkey").alias("a"), name("s", "s_suppkey").alias("b"))
    return graph.paths_between(edges, pairs).select("query", F.array_join("path", ">").alias("path"))
