"""Benchmark queries over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.operators import benchmark as ops
from docquarry.plans.registry import register
from docquarry.plans.tables import FACTS_SQL, facts


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalised fact for each cell that has any, with its conflict flag."""
    every = facts(spark, sf_dir)
    best = ops.best_candidates(every)
    return ops.with_normalised(best).join(ops.conflicts(every, best), list(ops.CELL))


@register(
    "benchmark_cells",
    f"WITH {FACTS_SQL} SELECT metric, company, year, round(normalised, 6) AS normalised, unit, source, chunk_id, comparable, warning, conflict, candidates FROM cells",
)
def benchmark_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("metric", "company", "year", F.round("normalised", 6).alias("normalised"), "unit", "source", "chunk_id", "comparable", "warning", "conflict", "candidates")


@register("best_candidate_per_cell", f"WITH {FACTS_SQL} SELECT metric, company, year, value, source, chunk_id FROM best")
def best_candidate_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_candidates(facts(spark, sf_dir)).select("metric", "company", "year", "value", "source", "chunk_id")


@register("conflict_cells", f"WITH {FACTS_SQL} SELECT metric, company, year, candidates FROM clash WHERE conflict")
def conflict_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = facts(spark, sf_dir)
    return ops.conflicts(every, ops.best_candidates(every)).where("conflict").select("metric", "company", "year", "candidates")


@register(
    "benchmark_changes",
    f"""WITH {FACTS_SQL}, w AS (SELECT *, lag(year) OVER (PARTITION BY metric, company ORDER BY year) AS prev_year, lag(normalised) OVER (PARTITION BY metric, company ORDER BY year) AS prev_value FROM cells WHERE comparable)
    SELECT metric, company, year, round(normalised, 6) AS normalised, prev_year,
    round(CASE WHEN metric IN ('gross_margin', 'debt_ratio') THEN normalised - prev_value WHEN prev_value <> 0 THEN (normalised - prev_value) / abs(prev_value) * 100 END, 4) AS change FROM w""",
)
def benchmark_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.changes(cells(spark, sf_dir)).select("metric", "company", "year", F.round("normalised", 6).alias("normalised"), "prev_year", "change")


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics, all companies, and the years 1990 to 2005, whether there are facts or not."""
    own = cells(spark, sf_dir)
    metrics = spark.createDataFrame([("revenue",), ("gross_margin",), ("debt_ratio",), ("eps",)], "metric string")
    years = spark.range(1990, 2006).select(F.col("id").cast("int").alias("year"))
    return ops.grid(metrics, own.select("company"), years, own)


GRID_SQL = f"""{FACTS_SQL}, grid AS (
  SELECT m.metric, c.company, y.year, value, normalised, comparable, conflict, chunk_id
  FROM (VALUES ('revenue'), ('gross_margin'), ('debt_ratio'), ('eps')) m(metric)
  CROSS JOIN (SELECT DISTINCT company FROM cells) c CROSS JOIN (SELECT CAST(range AS INT) AS year FROM range(1990, 2006)) y
  LEFT JOIN cells f ON f.metric = m.metric AND f.company = c.company AND f.year = y.year)"""


@register(
    "benchmark_coverage",
    f"""WITH {GRID_SQL}, n AS (SELECT metric, count(*) AS requested, count(*) FILTER (value IS NOT NULL) AS available,
      count(*) FILTER (value IS NOT NULL AND comparable AND NOT conflict) AS comparable, count(*) FILTER (value IS NOT NULL AND chunk_id <> '') AS evidenced,
      count(*) FILTER (conflict) AS conflicts FROM grid GROUP BY metric), s AS (SELECT *, available / requested AS a, CASE WHEN available > 0 THEN evidenced / available ELSE 0.0 END AS e FROM n)
    SELECT metric, requested, available, comparable, evidenced, conflicts, round(a, 6) AS coverage, round(e, 6) AS evidence,
      CASE WHEN a >= 0.9 AND e >= 0.95 AND conflicts = 0 AND metric <> 'revenue' THEN 'high' WHEN a >= 0.6 AND e >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
)
def benchmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage(dense_grid(spark, sf_dir), ("metric",))


@register("benchmark_matrix", f"WITH {GRID_SQL} SELECT metric, company, year, round(normalised, 6) AS normalised, comparable, conflict FROM grid")
def benchmark_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_grid(spark, sf_dir).select("metric", "company", "year", F.round("normalised", 6).alias("normalised"), "comparable", "conflict")


@register(
    "benchmark_leaders",
    f"""WITH {FACTS_SQL}, a AS (SELECT *, max(year) OVER (PARTITION BY metric) AS latest FROM cells WHERE comparable AND metric <> 'revenue'),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'debt_ratio' THEN -normalised ELSE normalised END DESC, company) AS n, count(*) OVER (PARTITION BY metric) AS compared FROM a WHERE year = latest)
    SELECT metric, year, company AS leader, round(normalised, 6) AS leading_value, compared FROM r WHERE n = 1 AND compared >= 2""",
)
def benchmark_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.leaders(cells(spark, sf_dir)).withColumn("leading_value", F.round("leading_value", 6))


@register(
    "benchmark_catalog",
    f"""WITH {FACTS_SQL} SELECT metric, count(*) AS available_records, CASE metric WHEN 'revenue' THEN 'amount' WHEN 'eps' THEN 'per_share' ELSE 'percent' END AS kind,
    CASE metric WHEN 'debt_ratio' THEN 'lower' ELSE 'higher' END AS direction FROM facts GROUP BY metric""",
)
def benchmark_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.catalog(facts(spark, sf_dir))


@register(
    "plausible_facts",
    f"""WITH {FACTS_SQL} SELECT metric, company, CAST(count(*) AS BIGINT) AS plausible FROM facts WHERE CASE WHEN metric IN ('gross_margin', 'debt_ratio') THEN abs(value) <= 1000 WHEN metric = 'revenue' THEN abs(value) >= 100 ELSE TRUE END GROUP BY 1, 2""",
)
def plausible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where(finance.plausible(F.col("metric"), F.col("value"))).groupBy("metric", "company").agg(F.count("*").alias("plausible"))


@register(
    "decimal_change",
    f"""WITH {FACTS_SQL}, y AS (SELECT company, year, CAST(value AS DECIMAL(28,8)) AS value FROM best WHERE metric = 'eps')
    SELECT a.company, a.year, CAST(b.value - a.value AS DOUBLE) AS difference, round(CAST(b.value AS DOUBLE) / CAST(a.value AS DOUBLE) * 100 - 100, 6) AS percent FROM y a JOIN y b ON a.company = b.company AND b.year = a.year + 1""",
)
def decimal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = ops.best_candidates(facts(spark, sf_dir)).where("metric = 'eps'").select("company", "year", "value")
    both = y.alias("a").join(y.alias("b"), F.expr("a.company = b.company AND b.year = a.year + 1"))
    a, b = F.col("a.value"), F.col("b.value")
    return both.select("a.company", "a.year", ops.amounts_compared(b, a, "subtract").cast("double").alias("difference"), F.round(ops.amounts_compared(a, b, "percent_change").cast("double"), 6).alias("percent"))
