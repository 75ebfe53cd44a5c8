"""Retrieval quality: ranked hits against relevant chunks, all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.functions import questions as Q


def ir_metrics(hits: DataFrame, relevant: DataFrame, k: int, idcg: str = "k") -> DataFrame:
    """A row for each question of relevant (qid, chunk_id): precision, recall, mrr, ndcg, all_hit and
    context precision at k of hits (qid, chunk_id, rank).

    idcg: the ideal has min(relevant, k) hits, or (returned) as many as were returned at most.
    Context precision is the mean precision at the ranks of relevant hits.
    """
    want = relevant.select("qid", "chunk_id").distinct()
    size = want.groupBy("qid").agg(F.count("*").alias("relevant"))
    judged = hits.join(want.withColumn("is_relevant", F.lit(True)), ["qid", "chunk_id"], "left").withColumn("is_relevant", F.coalesce("is_relevant", F.lit(False)))
    return judged_metrics(judged, size, k, idcg)


def judged_metrics(judged: DataFrame, size: DataFrame, k: int, idcg: str = "k") -> DataFrame:
    """``ir_metrics`` of hits that say whether they are relevant (qid, chunk_id, rank, is_relevant) and the number of relevant
    chunks of each question (qid, relevant): for relevance that follows from a class, whose pairs need not be written out."""
    top = judged.where(F.col("rank") <= k).withColumn("_r", F.col("is_relevant").cast("int"))
    so_far = F.sum("_r").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("_p", F.col("_r") * so_far / F.col("rank"))
    gain = F.sum(F.col("_r") / F.log2(F.col("rank") + 1.0))
    by_q = top.groupBy("qid").agg(F.sum("_r").alias("found"), F.count("*").alias("returned"), gain.alias("dcg"), F.min(F.when(F.col("_r") == 1, F.col("rank"))).alias("first"), F.sum("_p").alias("_ps"))
    out = size.join(by_q, "qid", "left").na.fill(0, ["found", "returned", "dcg", "_ps"])
    ideal_n = F.least("relevant", F.lit(k) if idcg == "k" else F.greatest("returned", F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1), ideal_n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return out.select(
        "qid",
        (F.col("found") / k).alias("precision"),
        (F.col("found") / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("found") == F.col("relevant")).alias("all_hit"),
        F.when(F.col("found") > 0, F.col("_ps") / F.col("found")).otherwise(0.0).alias("context_precision"),
    )


def report(per_question: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Means over all questions and over each group (nulls skipped), in one pass (grouping sets)."""
    sets = ", ".join(f"({g})" for g in groups) + ", ()"
    name = "coalesce(" + ", ".join(f"CAST({g} AS string)" for g in groups) + ", 'all')"
    per_question.createOrReplaceTempView("_docquarry_questions")
    cols = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics)
    return per_question.sparkSession.sql(f"SELECT {name} AS part, count(*) AS questions, {cols} FROM _docquarry_questions GROUP BY GROUPING SETS ({sets})")


def percentiles(times: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95 and the largest, from exact order statistics."""
    return times.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("largest"))


def resolved(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question, chunk_id): relevant chunks by fingerprint (the first chunk that has it), else by id."""
    first = corpus.groupBy("fingerprint").agg(F.min("chunk_id").alias("_id"))
    g = golden.select("question", "relevant_chunk_ids", F.explode_outer("relevant_fingerprints").alias("fingerprint")).join(first, "fingerprint", "left")
    per = g.groupBy("question", "relevant_chunk_ids").agg(F.collect_set("_id").alias("_found"))
    return per.select("question", F.explode(F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.col("relevant_chunk_ids"))).alias("chunk_id"))


def stratified(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """About this share of each stratum (one row at least), in order of a hash of key and seed."""
    w = Window.partitionBy(stratum)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    n = F.greatest(F.lit(1), F.round(F.count("*").over(w) * share))
    return rows.withColumn("_n", n).withColumn("_i", F.row_number().over(w.orderBy(order, key))).where("_i <= _n").drop("_i", "_n")


def extraction_accuracy(golden: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, subject_ok, year_ok, value_ok) of golden (qid, metric, year, value) against what was read from the questions
    and looked up (qid, metric, year, value).  A question without a year has it right."""
    f = found.select("qid", F.col("metric").alias("_m"), F.col("year").alias("_y"), F.col("value").alias("_v"))
    subject = F.coalesce(F.col("_m") == F.col("metric"), F.lit(False))
    value = F.col("_m").isNotNull() & finance.equal_value(F.col("_v"), F.col("value"))
    return golden.join(f, "qid", "left").select("qid", subject.alias("subject_ok"), (F.col("year").isNull() | F.coalesce(F.col("_y") == F.col("year"), F.lit(False))).alias("year_ok"), value.alias("value_ok"))


def ablation(runs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """A row for each config of runs (config, qid, chunk_id, rank): questions and mean metrics, in one pass over all
    configurations.  A question for which a configuration found nothing counts 0."""
    pair = F.struct("config", "qid")
    want = relevant.select("qid", "chunk_id").distinct().crossJoin(runs.select("config").distinct()).select(pair.alias("qid"), "chunk_id")  # a few configurations
    each = ir_metrics(runs.select(pair.alias("qid"), "chunk_id", "rank"), want, k)
    names = ("precision", "recall", "mrr", "ndcg", "context_precision")
    return each.groupBy(F.col("qid.config").alias("config")).agg(F.count("*").alias("questions"), *(F.round(F.avg(n), 6).alias(n) for n in names), F.round(F.avg(F.col("all_hit").cast("double")), 6).alias("all_hit"))


def holdout(facts: DataFrame, used: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n facts (company, metric, year, value, unit, chunk_id) with a source that no question (company, metric, year) has used,
    in order of a hash of the fact and the seed, with a question and the value as a question set states it."""
    left = facts.where("coalesce(chunk_id, '') <> ''").join(used.select("company", "metric", "year").distinct(), ["company", "metric", "year"], "left_anti")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "company", "metric", F.col("year").cast("string"), "chunk_id").cast("binary"))
    chosen = left.withColumn("_o", order).orderBy("_o").limit(n)
    return chosen.select("company", "metric", "year", "unit", "chunk_id", Q.templated(F.col("company"), F.col("year"), F.col("metric")).alias("question"), finance.thousands(F.col("value")).alias("snippet"))


def judged_ratios(statements: DataFrame) -> DataFrame:
    """(qid, kind, n, ratio): share of statements (qid, kind, ok) that a judge found supported or found."""
    return statements.groupBy("qid", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("ok", F.lit(False)).cast("int")), 4).alias("ratio"))


def overview(runs: DataFrame, org: str, columns: list[str], limit: int = 12) -> DataFrame:
    """The newest runs of an organisation, with the columns that may be shown."""
    return runs.where(F.col("org") == org).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit).select(*columns)


def hit_rates(events: DataFrame, by: list[str]) -> DataFrame:
    """Hits, misses, other outcomes and the rate of hits among lookups (0 without any) of events (outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    lookups = n("hit") + n("miss")
    return events.groupBy(*by).agg(n("hit").alias("hits"), n("miss").alias("misses"), F.count_if(~F.col("outcome").isin("hit", "miss")).alias("others"), F.when(lookups > 0, F.round(n("hit") / lookups, 4)).otherwise(0.0).alias("hit_rate"))
