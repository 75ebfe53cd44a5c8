"""Facts as answers: which questions a fact answers directly, its evidence, and what a user may read of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import questions as Q

# What asks for a value, and what asks for more than one.
ASKS = "(?i)多少|几元|\\bwhat\\s+(?:is|was|were|are)\\b|\\bhow\\s+much\\b"
ASKS_MORE = (
    "(?i)趋势|变化|增长|下降|增加|减少|原因|影响|风险|战略|治理|比较|对比|分析|为什么|如何|"
    "是否|不是|不含|不包括|除外|计算|占比|差额|差值|分别|各自|哪些|"
    "\\b(?:trend|change|growth|increase|decrease|why|risk|compare|comparison|"
    "difference|calculate|not|excluding|except|versus|ratio|percentage|each)\\b"
)


def asked_years(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit("(?:19|20)[0-9]{2}"), F.lit(0)).cast("array<int>"))


def direct_fields(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, metric, company, year, value, unit, chunk_id) of the questions (qid, question, company, n_companies) that one
    fact answers: they ask for a value and nothing else, of one metric, one year and one company, and there is
    exactly one such fact, with a source."""
    q = questions.where(F.col("question").rlike(ASKS) & ~F.col("question").rlike(ASKS_MORE))
    q = q.withColumns({"_m": Q.metric_keys(F.col("question")), "_y": asked_years(F.col("question"))}).where("size(_m) = 1 AND size(_y) = 1 AND company IS NOT NULL AND n_companies <= 1")
    q = q.select("qid", "company", F.get("_m", F.lit(0)).alias("metric"), F.get("_y", F.lit(0)).alias("year"))
    found = q.join(facts.select("metric", "company", "year", "value", "unit", "chunk_id"), ["metric", "company", "year"])
    one = found.groupBy("qid").agg(F.count("*").alias("_n"), F.first(F.struct("metric", "company", "year", "value", "unit", "chunk_id")).alias("_f"))
    return one.where("_n = 1 AND coalesce(_f.chunk_id, '') <> ''").select("qid", "_f.*")


def field_evidence(asked: DataFrame, facts: DataFrame, documents: DataFrame, most: int = 20) -> DataFrame:
    """(qid, rank, metric, company, year, value, unit, doc_id, doc_name): facts of what is asked for (qid, metric, company,
    year); where there is none of the year, those of all years, newest first.  doc_name: the document's file name, else its id."""
    j = asked.select("qid", "metric", "company", F.col("year").alias("_year")).join(facts, ["metric", "company"])
    w = Window.partitionBy("qid")
    exact = F.coalesce(F.col("year") == F.col("_year"), F.col("_year").isNull())
    kept = j.withColumn("_exact", exact).withColumn("_some", F.max("_exact").over(w)).where("_exact OR NOT _some")
    kept = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("year"), "doc_id", "chunk_id"))).where(F.col("rank") <= most)
    names = documents.select("doc_id", F.col("filename").alias("_name"))
    return kept.join(names, "doc_id", "left").select("qid", "rank", "metric", "company", "year", "value", "unit", "doc_id", F.coalesce("_name", F.col("doc_id").cast("string")).alias("doc_name"))


def authorised_sources(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (doc_id, org, level) with ``state``: denied (another organisation's, or above the user's level, or an
    unknown level), absent (no such document), unusable (not indexed, no PDF, no SHA-256), else usable."""
    rank = lambda c: F.try_element_at(F.create_map(F.lit("public"), F.lit(0), F.lit("internal"), F.lit(1), F.lit("restricted"), F.lit(2)), c)
    d = documents.select("doc_id", F.col("org").alias("_org"), F.col("visibility").alias("_v"), "status", "file_type", "sha256")
    j = requests.join(d, "doc_id", "left")
    ok = (F.col("status") == "indexed") & (F.lower(F.regexp_replace("file_type", "^[.]", "")) == "pdf") & F.coalesce("sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$")
    state = (
        F.when(rank(F.col("level")).isNull(), "denied")
        .when(F.col("_org").isNull(), "absent")
        .when((F.col("_org") != F.col("org")) | (F.coalesce(rank(F.col("_v")), F.lit(99)) > rank(F.col("level"))), "denied")
        .when(F.coalesce(ok, F.lit(False)), "usable")
        .otherwise("unusable")
    )
    return j.withColumn("state", state).select(*requests.columns, "state")


def valid_selection(selection: Column, pool: Column, most: Column) -> Column:
    """A selection of pages as it is, or none at all: if it is longer than allowed, has a page twice, or one that isn't in
    the pool."""
    s = F.coalesce(selection, F.array().cast("array<int>"))
    good = (most >= 0) & (F.size(s) <= most) & (F.size(F.array_distinct(s)) == F.size(s)) & (F.size(F.array_except(s, pool)) == 0)
    return F.when(F.coalesce(good, F.lit(False)), s).otherwise(F.array().cast("array<int>"))
