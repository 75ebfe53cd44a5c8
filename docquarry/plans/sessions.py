"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import sessions
from docquarry.plans.registry import register
from docquarry.plans.tables import table

_WS = "[\\t\\n\\x0B\\f\\r ]"


@register(
    "loop_detection",
    f"""WITH k AS (SELECT conv_id, turn, regexp_replace(lower(regexp_replace(string_split(text, ' ')[1], '{_WS}+', '', 'g')), '^[？?。.]+|[？?。.]+$', '', 'g') AS key FROM conversations WHERE role = 'user')
    SELECT * FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, key ORDER BY turn ROWS UNBOUNDED PRECEDING) AS times FROM k WHERE key <> '') WHERE times >= 2""",
)
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked for the second time or more; a turn's first word stands for what it asks."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.get(F.split("text", " "), F.lit(0)))
    return sessions.loops(turns, 2).select("conv_id", "turn", "times")


@register("last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@register(
    "injection_guard",
    """SELECT conv_id, turn, regexp_matches(lower(text), 'ignore[\\t\\n ]+(all[\\t\\n ]+)?(previous|prior|above)[\\t\\n ]+instructions|system[\\t\\n ]+prompt|developer[\\t\\n ]+prompt|system[\\t\\n ]+instructions|act[\\t\\n ]+as[\\t\\n ]+a[\\t\\n ]+|disregard[\\t\\n ]+(all[\\t\\n ]+)?previous|ignore[\\t\\n ]+your[\\t\\n ]+(system[\\t\\n ]+)?prompt|reveal[\\t\\n ]+your[\\t\\n ]+prompt|show[\\t\\n ]+your[\\t\\n ]+system|you[\\t\\n ]+are[\\t\\n ]+now[\\t\\n ]+(a[\\t\\n ]+)?(do[\\t\\n ]+)?anything')
      OR contains(lower(text), 'password') AS flagged FROM conversations""",
)
def injection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_injection(F.col("text"), ("password",)).alias("flagged"))


@register(
    "session_summary",
    "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@register(
    "answers_from_cache",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    q AS (SELECT a.vec_id AS qid, 'question ' || CAST(a.vec_id AS VARCHAR) || ' about topic ' || CAST(a.label AS VARCHAR) AS n, [(1 - (a.vec_id % 7 + 1) / 20) * a.e[i] + (a.vec_id % 7 + 1) / 20 * b.e[i] FOR i IN range(1, len(a.e) + 1)] AS e FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
    c AS (SELECT vec_id AS entry_id, CASE WHEN vec_id % 3 = 0 THEN 'something else, ' || CAST(vec_id AS VARCHAR) ELSE 'question ' || CAST(vec_id AS VARCHAR) || ' on topic ' || CAST(label AS VARCHAR) END AS n, e FROM v),
    g AS (SELECT qid, entry_id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS s, replace(lower(q.n), ' ', '') AS a, replace(lower(c.n), ' ', '') AS b FROM q CROSS JOIN c),
    d AS (SELECT *, list_distinct([a[i:i + 1] FOR i IN range(1, length(a))]) AS x, list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]) AS y FROM g WHERE s >= 0.95)
    SELECT qid, entry_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, entry_id) AS n FROM d WHERE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.5) WHERE n = 1""",
)
def answers_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of a vector and a share of the next one, against a cache of all vectors, a third of them under other words."""
    v = table(spark, sf_dir, "embeddings")
    words = F.concat(F.lit("question "), F.col("vec_id").cast("string"), F.lit(" {} topic "), F.col("label").cast("string"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    share = (F.col("vec_id") % 7 + 1) / 20
    blend = F.zip_with("embedding", "next", lambda x, y: (1 - share) * x.cast("double") + share * y.cast("double"))
    q = v.where("vec_id % 20 = 0").join(other, "vec_id").select(F.col("vec_id").alias("qid"), F.replace(words, F.lit("{}"), F.lit("about")).alias("q_norm"), blend.alias("q_vec"))
    norm = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("something else, "), F.col("vec_id").cast("string"))).otherwise(F.replace(words, F.lit("{}"), F.lit("on")))
    c = v.select(F.col("vec_id").alias("entry_id"), norm.alias("q_norm"), F.col("embedding").cast("array<double>").alias("q_vec"))
    return sessions.cached_answers(q, c).select("qid", "entry_id", F.round("similarity", 6).alias("similarity"))
