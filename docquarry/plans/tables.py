"""Tables of the driver as the concepts of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by nation (company), ship year and order priority (candidate).

    revenue in 元 or, for the last priority, without a unit; gross_margin and debt_ratio in percent; eps.
    Sums are of decimals, so they don't depend on the order of rows.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.year("l_shipdate").alias("year"),
        "l_shipdate",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("net"),
        F.col("l_discount").cast("decimal(10,4)").alias("discount"),
        F.col("l_tax").cast("decimal(10,4)").alias("tax"),
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("company"))  # 25 rows
    by_order = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    sums = by_order.groupBy("c_nationkey", "year", "o_orderpriority").agg(F.sum("net").cast("double").alias("net"), F.sum("discount").cast("double").alias("discount"), F.sum("tax").cast("double").alias("tax"), F.sum("quantity").cast("double").alias("quantity"), F.count("*").alias("n"), F.max("l_shipdate").alias("created_at"))
    named = sums.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    metric = lambda name, value, unit: F.struct(F.lit(name).alias("metric"), F.round(value, 6).alias("value"), unit.alias("unit"))
    n, none = F.col("n"), F.lit(None).cast("string")
    each = F.explode(
        F.array(
            metric("revenue", F.col("net"), F.when(F.col("o_orderpriority").startswith("5"), none).otherwise(F.lit("元"))),
            metric("gross_margin", 100 - 100 * F.col("discount") / n, F.lit("%")),
            metric("debt_ratio", 100 * F.col("tax") / n, F.lit("%")),
            metric("eps", F.col("quantity") / n, F.when(F.col("o_orderpriority").startswith("1"), F.lit("元")).otherwise(none)),
        )
    ).alias("m")
    return named.select("company", "year", "o_orderpriority", "created_at", each).select(
        "m.metric",
        "company",
        "year",
        "m.value",
        "m.unit",
        F.when(F.col("o_orderpriority").rlike("^[12]"), "table").otherwise("text").alias("source"),
        F.concat_ws("/", "company", F.col("year").cast("string"), "o_orderpriority").alias("chunk_id"),
        "created_at",
    )


FACTS_SQL = """
sums AS (
  SELECT n_name AS company, CAST(year(l_shipdate) AS INT) AS year, o_orderpriority AS p, max(l_shipdate) AS created_at, count(*) AS n,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS net,
         CAST(sum(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) AS discount,
         CAST(sum(CAST(l_tax AS DECIMAL(10,4))) AS DOUBLE) AS tax,
         CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
facts AS (
  SELECT metric, company, year, round(value, 6) AS value, unit, CASE WHEN p LIKE '1%' OR p LIKE '2%' THEN 'table' ELSE 'text' END AS source,
         company || '/' || CAST(year AS VARCHAR) || '/' || p AS chunk_id, created_at
  FROM (SELECT 'revenue' AS metric, net AS value, CASE WHEN p LIKE '5%' THEN NULL ELSE '元' END AS unit, * FROM sums
        UNION ALL SELECT 'gross_margin', 100 - 100 * discount / n, '%', * FROM sums
        UNION ALL SELECT 'debt_ratio', 100 * tax / n, '%', * FROM sums
        UNION ALL SELECT 'eps', quantity / n, CASE WHEN p LIKE '1%' THEN '元' ELSE NULL END, * FROM sums)),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, company, year ORDER BY (source = 'table') DESC, (coalesce(unit, '') <> '') DESC, (chunk_id <> '') DESC, created_at DESC, chunk_id) AS rn FROM facts)
  WHERE rn = 1),
clash AS (
  SELECT f.metric, f.company, f.year, max(abs(f.value - b.value) > greatest(1e-6 * greatest(abs(f.value), abs(b.value)), 1e-9)) AS conflict, count(*) AS candidates
  FROM facts f JOIN best b ON f.metric = b.metric AND f.company = b.company AND f.year = b.year GROUP BY 1, 2, 3),
cells AS (
  SELECT b.*, CASE WHEN b.metric = 'revenue' THEN CASE WHEN unit = '元' THEN value / 1e8 END ELSE value END AS normalised,
         CASE WHEN b.metric = 'revenue' THEN unit IS NOT NULL WHEN b.metric = 'eps' THEN coalesce(unit, '') <> '' ELSE TRUE END AS comparable,
         CASE WHEN b.metric = 'revenue' AND unit IS NULL THEN 'unknown unit' WHEN b.metric = 'eps' AND coalesce(unit, '') = '' THEN 'no unit a share' END AS warning,
         conflict, candidates
  FROM best b JOIN clash c ON b.metric = c.metric AND b.company = c.company AND b.year = c.year)
"""


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(df: DataFrame, key: str, text: str = "text", name: str = "doc_id") -> DataFrame:
    """(name, term, tf): the words of the text, counted."""
    return df.select(F.col(key).alias(name), F.explode(words(F.col(text))).alias("term")).groupBy(name, "term").agg(F.count("*").alias("tf"))


TERMS_SQL = """
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
query_terms AS (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2)
"""
