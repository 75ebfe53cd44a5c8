"""Competitor benchmark: company x metric x year matrices from extracted facts, with evidence.

Facts: org, visibility, company, metric, year, value, unit, source, chunk_id, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import finance

CELL = ("metric", "company", "year")


def best_candidates(facts: DataFrame, key: tuple[str, ...] = CELL, tie: str = "chunk_id") -> DataFrame:
    """One fact a cell: from a table, then with a unit, then with a source chunk, then the newest."""
    rank = [F.col("source").eqNullSafe("table"), F.coalesce(F.col("unit"), F.lit("")) != "", F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "", F.col("created_at")]
    w = Window.partitionBy(*key).orderBy(*(c.desc_nulls_last() for c in rank), F.col(tie).asc_nulls_last())
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normalised(value: Column, unit: Column, kind: Column) -> Column:
    """Struct: value on the kind's common scale (amounts in 亿元), comparable, warning."""
    factor = finance.unit_factor(unit)
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    share_unit = F.coalesce(unit, F.lit("")) != ""
    scaled = F.when(kind == "amount", value * factor / 1e8).otherwise(value)
    comparable = finite & F.when(kind == "amount", factor.isNotNull()).when(kind == "per_share", share_unit).otherwise(True)
    warning = F.when(~finite, "not a finite number").when((kind == "amount") & factor.isNull(), "unknown unit").when((kind == "per_share") & ~share_unit, "no unit a share")
    return F.struct(F.when(finite, scaled).alias("value"), F.coalesce(comparable, F.lit(False)).alias("comparable"), warning.alias("warning"))


def with_normalised(facts: DataFrame) -> DataFrame:
    n = normalised(F.col("value"), F.col("unit"), finance.kind(F.col("metric")))
    return facts.withColumn("_n", n).select("*", F.col("_n.value").alias("normalised"), F.col("_n.comparable").alias("comparable"), F.col("_n.warning").alias("warning")).drop("_n")


def conflicts(facts: DataFrame, chosen: DataFrame, value: str = "value", key: tuple[str, ...] = CELL, relative: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """(key, conflict): whether some candidate differs from the chosen one.  Only sums leave a cell, so a
    cell with very many candidates needs no more memory than another."""
    own = chosen.select(*key, F.col(value).alias("_chosen"))
    apart = F.abs(F.col(value) - F.col("_chosen")) > F.greatest(relative * F.greatest(F.abs(value), F.abs("_chosen")), F.lit(absolute))
    return facts.join(own, list(key)).groupBy(*key).agg(F.max(apart).alias("conflict"), F.count("*").alias("candidates"))


def changes(cells: DataFrame, value: str = "normalised") -> DataFrame:
    """cells with the previous comparable year's value and the change from it: points for percentages,
    percent of the previous absolute value for others (null where that is 0)."""
    w = Window.partitionBy("metric", "company").orderBy("year")
    able = cells.where("comparable").withColumn("prev_year", F.lag("year").over(w)).withColumn("prev_value", F.lag(value).over(w))
    ratio = F.when(F.col("prev_value") != 0, (F.col(value) - F.col("prev_value")) / F.abs("prev_value") * 100)
    change = F.when(finance.kind(F.col("metric")) == "percent", F.col(value) - F.col("prev_value")).otherwise(ratio)
    return able.withColumn("change", F.round(change, 4))


def grid(metrics: DataFrame, companies: DataFrame, years: DataFrame, cells: DataFrame) -> DataFrame:
    """All combinations asked for, with their cell or nulls.  What is asked for is small by nature."""
    asked = metrics.select("metric").distinct().crossJoin(companies.select("company").distinct()).crossJoin(years.select("year").distinct())
    return asked.join(cells, list(CELL), "left")


def coverage(dense: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares of the cells asked for, and the confidence class they give."""
    there = F.col("value").isNotNull()
    evidenced = there & (F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "")
    clash = F.coalesce(F.col("conflict"), F.lit(False))
    out = dense.groupBy(*by).agg(
        F.count("*").alias("requested"),
        F.count_if(there).alias("available"),
        F.count_if(there & F.coalesce("comparable", F.lit(False)) & ~clash).alias("comparable"),
        F.count_if(evidenced).alias("evidenced"),
        F.count_if(clash).alias("conflicts"),
        F.coalesce(F.max(finance.kind(F.col("metric")) == "amount"), F.lit(False)).alias("_amount"),
    )
    share = F.when(F.col("requested") > 0, F.col("available") / F.col("requested")).otherwise(0.0)
    proof = F.when(F.col("available") > 0, F.col("evidenced") / F.col("available")).otherwise(0.0)
    confidence = F.when((share >= 0.9) & (proof >= 0.95) & (F.col("conflicts") == 0) & ~F.col("_amount"), "high").when((share >= 0.6) & (proof >= 0.7), "medium").otherwise("low")
    return out.withColumns({"coverage": F.round(share, 6), "evidence": F.round(proof, 6), "confidence": confidence}).drop("_amount")


def leaders(cells: DataFrame, value: str = "normalised") -> DataFrame:
    """Best company of each metric in its latest comparable year, where two or more can be compared.
    Amounts and neutral metrics have no leader."""
    kind, way = finance.kind(F.col("metric")), finance.direction(F.col("metric"))
    able = cells.where(F.col("comparable") & (kind != "amount") & (way != "neutral"))
    latest = able.withColumn("_latest", F.max("year").over(Window.partitionBy("metric"))).where("year = _latest")
    signed = F.when(way == "lower", -F.col(value)).otherwise(F.col(value))
    w = Window.partitionBy("metric")
    ranked = latest.withColumn("_n", F.row_number().over(w.orderBy(signed.desc(), "company"))).withColumn("compared", F.count("*").over(w))
    return ranked.where("_n = 1 AND compared >= 2").select("metric", "year", F.col("company").alias("leader"), F.col(value).alias("leading_value"), "compared")


def catalog(facts: DataFrame) -> DataFrame:
    """Metrics that have facts, most first."""
    return facts.groupBy("metric").agg(F.count("*").alias("available_records")).withColumn("kind", finance.kind(F.col("metric"))).withColumn("direction", finance.direction(F.col("metric"))).orderBy(F.desc("available_records"), "metric")


def amounts_compared(a: Column, b: Column, op: str) -> Column:
    """Exact decimal arithmetic on two numbers; dividing by zero is an error."""
    x, y = a.cast("decimal(20,6)"), b.cast("decimal(20,6)")
    stop = F.raise_error(F.lit("division by zero"))
    if op == "percent_change":
        return F.when(x == 0, stop.cast("decimal(38,14)")).otherwise((y - x) / F.abs(x) * 100)
    if op == "divide":
        return F.when(y == 0, stop.cast("decimal(38,14)")).otherwise(x / y)
    return {"add": x + y, "subtract": x - y, "multiply": x * y}[op]
