"""Facts from tables and text lines: company x metric x year values with where they come from.

Tables: doc_id, page, table_no, headers array<string>, rows array<array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.functions import text as T

# Heads of columns that hold changes, not values.
GROWTH = "增减|变动|增长|同比|change|increase|decrease|growth"
COMPANY_PATTERNS = (
    "([\\x{4E00}-\\x{9FFF}A-Za-z()（）]{2,40}股份有限公司)",
    "([\\x{4E00}-\\x{9FFF}A-Za-z()（）]{2,40}有限责任公司)",
    "([\\x{4E00}-\\x{9FFF}A-Za-z()（）]{2,40}集团)",
    "([A-Z][A-Za-z.,& ]{1,60} (?:Inc|Corporation|Company|Corp|Ltd)\\.?)",
)
LOOK_RIGHT = 6


def company(pages: DataFrame, first_pages: int = 6) -> DataFrame:
    """(doc_id, company): the first match of the first pattern on the first page that has one."""
    tries = F.filter(F.array(*(F.struct(F.lit(i).alias("pattern"), F.regexp_extract("text", p, 1).alias("name")) for i, p in enumerate(COMPANY_PATTERNS))), lambda x: x["name"] != "")
    best = F.min(F.struct("page", F.get(tries, F.lit(0))["pattern"].alias("pattern"), F.trim(F.get(tries, F.lit(0))["name"]).alias("name")))
    return pages.where((F.col("page") <= first_pages) & (F.size(tries) > 0)).groupBy("doc_id").agg(best.alias("_b")).select("doc_id", F.col("_b.name").alias("company"))


def year_columns(headers: Column) -> Column:
    """Array of {col, year} of the heads that name a year, col from 0."""
    return F.filter(F.transform(headers, lambda h, i: F.struct(i.alias("col"), finance.year_of_cell(h).alias("year"))), lambda x: x["year"].isNotNull())


def row_values(cells: Column, numbers: Column, growth: Column, years: Column, metric: Column) -> Column:
    """Array of {year, value, unit, raw}: for each year column, in order, the first number from the column
    itself (if the row has as many cells as there are heads) or from the six to its right, that isn't the
    label, used already, under a head of growth, a percentage of an amount, or implausible.

    numbers: the cells as numbers; growth: of each head, whether it is one of growth.  Both are columns, so that they
    are computed once a row."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.expr("CAST(array() AS array<struct<year:int,value:double,unit:string,raw:string>>)").alias("out"))

    def able(i: Column, used: Column) -> Column:
        n = F.get(numbers, i)
        percent = (n["unit"] == "%") & metric.isin(*finance.MONETARY)
        return (i > 0) & ~F.array_contains(used, i) & ~F.coalesce(F.get(growth, i), F.lit(False)) & n["value"].isNotNull() & ~F.coalesce(percent, F.lit(False)) & F.coalesce(finance.plausible(metric, n["value"]), F.lit(False))

    def step(a: Column, y: Column) -> Column:
        first = F.when(F.size(cells) == F.size(growth), y["col"]).otherwise(y["col"] + 1)
        tries = F.filter(F.sequence(first, y["col"] + LOOK_RIGHT), lambda i: (i < F.size(cells)) & able(i, a["used"]))

        def take(at: Column) -> Column:
            n = F.get(numbers, at)
            found = F.struct(y["year"].alias("year"), n["value"].alias("value"), n["unit"].alias("unit"), F.get(cells, at).alias("raw"))
            return F.when(at.isNull(), a).otherwise(F.struct(F.concat(a["used"], F.array(at)).alias("used"), F.concat(a["out"], F.array(found)).alias("out")))

        return T.bound(F.get(tries, F.lit(0)), take)

    return F.aggregate(years, start, step, lambda a: a["out"])


def from_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, page, metric, year, value, unit, raw, source, seq): metrics in rows with years in the head,
    or years in rows with metrics in the head."""
    tables = tables.repartition("doc_id")  # reading tables costs far more than moving them, and files of tables are few
    growth = F.transform("headers", lambda h: F.coalesce(F.lower(h).rlike(GROWTH), F.lit(False)))
    t = tables.withColumns({"_years": year_columns(F.col("headers")), "_unit": finance.table_unit(F.col("headers")), "_growth": growth})
    by_row = t.select("doc_id", "page", "table_no", "headers", "_growth", "_years", "_unit", F.posexplode("rows").alias("row_no", "cells")).withColumn("metric", finance.matched_metric(F.get("cells", F.lit(0))))
    known = by_row.where("metric IS NOT NULL AND size(_years) > 0").withColumn("_numbers", F.transform("cells", finance.number))
    a = known.select("doc_id", "page", "table_no", "row_no", "metric", "_unit", F.explode(row_values(F.col("cells"), F.col("_numbers"), F.col("_growth"), F.col("_years"), F.col("metric"))).alias("v"))
    flipped = by_row.where("size(_years) = 0").withColumn("_year", finance.year_of_cell(F.get("cells", F.lit(0)))).where("_year IS NOT NULL")
    cell = flipped.select("doc_id", "page", "table_no", "row_no", "headers", "_unit", "_year", F.posexplode("cells").alias("col", "raw")).where("col > 0").withColumn("metric", finance.matched_metric(F.get("headers", F.col("col")))).where("metric IS NOT NULL")
    n = finance.number(F.col("raw"))
    b = cell.select("doc_id", "page", "table_no", "row_no", "metric", "_unit", F.struct(F.col("_year").alias("year"), n["value"].alias("value"), n["unit"].alias("unit"), "raw").alias("v")).where(F.col("v.value").isNotNull() & finance.plausible(F.col("metric"), F.col("v.value")))
    unit = F.coalesce("v.unit", F.when(F.col("metric").isin(*finance.MONETARY), F.col("_unit")))
    return a.unionByName(b).select("doc_id", "page", "metric", "v.year", "v.value", unit.alias("unit"), "v.raw", F.lit("table").alias("source"), F.format_string("%06d/%06d", "table_no", "row_no").alias("seq"))


def year_sequence(pages: DataFrame) -> DataFrame:
    """(doc_id, years): the fiscal year that a document's first such phrase names, and the two before."""
    year = F.regexp_extract("text", "(?i)fiscal year ended [A-Za-z]+ [0-9]{1,2}, ?((?:19|20)[0-9]{2})|((?:19|20)[0-9]{2})年年度报告", 0)
    y = F.regexp_extract(year, "(19|20)[0-9]{2}", 0)
    first = pages.where(y != "").groupBy("doc_id").agg(F.min(F.struct("page", y.cast("int").alias("y")))["y"].alias("_y"))
    return first.select("doc_id", F.array(F.col("_y"), F.col("_y") - 1, F.col("_y") - 2).alias("years"))


def from_text(pages: DataFrame, years: DataFrame) -> DataFrame:
    """Facts of lines that name a metric and list numbers, by their position in the document's years.
    Percentages and numbers in brackets that follow others aren't values of amounts."""
    line = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")).withColumn("metric", finance.matched_metric(F.col("line"))).where("metric IS NOT NULL")
    numbers = F.regexp_extract_all("line", F.lit("(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?(?! ?%)|(?<![0-9.,])[0-9]+\\.[0-9]+(?![0-9]* ?%)"), F.lit(0))
    listed = line.join(years, "doc_id").withColumn("_v", numbers).where(F.size("_v") >= 2)
    each = listed.select("doc_id", "page", "n", "metric", "years", F.posexplode("_v").alias("i", "raw")).where(F.col("i") < F.size("years"))
    n = finance.number(F.col("raw"))["value"]
    return each.select("doc_id", "page", "metric", F.get("years", F.col("i")).alias("year"), n.alias("value"), F.lit(None).cast("string").alias("unit"), "raw", F.lit("text").alias("source"), F.format_string("%06d/%06d", "n", "i").alias("seq")).where(finance.plausible(F.col("metric"), F.col("value")))


def one_each(facts: DataFrame) -> DataFrame:
    """One fact for each (doc_id, metric, year): tables before text, else the first."""
    w = Window.partitionBy("doc_id", "metric", "year").orderBy((F.col("source") == "table").desc(), "page", "seq")
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extracted(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Facts of whole documents, with their company."""
    found = one_each(from_tables(tables).unionByName(from_text(pages, year_sequence(pages))))
    return found.join(company(pages), "doc_id", "left")


def with_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts with the chunk that holds their raw text: one that holds the metric's name too goes first,
    then the first in the document.  Separators don't count."""
    c = chunks.select("doc_id", "chunk_id", F.col("seq").alias("_seq"), T.without_separators(F.lower("content")).alias("_content"), finance.matched_metric(F.col("content")).alias("_metric"))
    raw = T.without_separators(F.lower("raw"))
    best = F.min(F.struct((F.coalesce(F.col("_metric") != F.col("metric"), F.lit(True))).alias("other"), F.col("_seq"), F.col("chunk_id")))
    key = ["doc_id", "metric", "year", "raw"]
    found = facts.select(*key).distinct().join(c, "doc_id").where((raw != "") & F.contains("_content", raw)).groupBy(*key).agg(best.alias("_b"))
    return facts.join(found.select(*key, F.col("_b.chunk_id").alias("_chunk")), key, "left").withColumn("chunk_id", F.coalesce(F.col("chunk_id"), F.col("_chunk")) if "chunk_id" in facts.columns else F.col("_chunk")).drop("_chunk")


def relayed(questions: DataFrame, facts: DataFrame, exact: bool = False) -> DataFrame:
    """(qid, chunk_id, metric, company, year): source chunks of the facts that questions (qid, company,
    metric, year) ask for; without the year asked for, the newest, unless it must be exact."""
    j = questions.alias("q").join(facts.where("chunk_id IS NOT NULL").alias("f"), F.expr("q.metric = f.metric AND q.company = f.company"))
    hit = F.col("q.year").isNull() | (F.col("q.year") == F.col("f.year"))
    out = j.select("q.qid", "f.chunk_id", "f.metric", "f.company", "f.year", hit.alias("_hit"))
    w = Window.partitionBy("qid")
    kept = out.withColumn("_some", F.max("_hit").over(w)).where("_hit OR NOT _some")
    newest = kept.withColumn("_newest", F.max("year").over(w)).where("_some OR year = _newest")
    return (newest.where("_hit") if exact else newest).drop("_hit", "_some", "_newest")
