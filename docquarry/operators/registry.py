"""Registry of documents: versions, duplicates, reconciliation with an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.shared import written


def latest(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reconcile(registry: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, state) of registry (doc_id, indexed, total, summaries) against index (doc_id, count):
    missing or extra points, residual points of documents that aren't indexed, orphans."""
    both = registry.join(index, "doc_id", "full_outer").withColumn("count", F.coalesce("count", F.lit(0)))
    expected = (F.col("count") == F.col("total")) | (F.col("count") == F.col("total") - F.coalesce("summaries", F.lit(0)))
    state = F.when(F.col("indexed").isNull(), "orphan").when(~F.col("indexed") & (F.col("count") > 0), "residual").when(~F.col("indexed"), "ok").when(expected, "ok").when(F.col("count") < F.col("total"), "missing").otherwise("extra")
    return both.select("doc_id", "count", state.alias("state"))


def arrivals(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (org, sha256, filename) with a decision: an equal file is a duplicate (or replaces a failed
    one), an equal name is replaced, else the file is new.  Archived documents don't count."""
    there = known.where("status <> 'archived'")
    same = latest(there, ["org", "sha256"], "created_at", "doc_id").select("org", "sha256", F.col("status").alias("_status"), F.col("doc_id").alias("_same"))
    named = latest(there, ["org", "filename"], "created_at", "doc_id").select("org", "filename", F.col("doc_id").alias("_named"))
    out = new.join(same, ["org", "sha256"], "left").join(named, ["org", "filename"], "left")
    decision = F.when(F.col("_status") == "failed", "replace").when(F.col("_same").isNotNull(), "duplicate").when(F.col("_named").isNotNull(), "replace").otherwise("new")
    return out.withColumn("decision", decision).withColumn("of", F.coalesce("_same", "_named")).drop("_status", "_same", "_named")


def listing(rows: DataFrame, pattern: str, offset: int, limit: int) -> DataFrame:
    """A page of the documents whose name holds a pattern, newest first, with the number of all."""
    found = rows.where((F.col("status") != "archived") & F.lower("filename").contains(pattern.lower()))
    total = found.agg(F.count("*").alias("total"))  # one row
    page = found.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def page_after(rows: DataFrame, bookmark: tuple | None, size: int, by: str = "created_at", key: str = "doc_id") -> DataFrame:
    """The ``size`` rows after a bookmark (values of ``by`` and ``key`` of the last row that was seen; None for the first
    page), newest first, then by key; rows without a time come last.  The bookmark is a filter that reaches the scan, and
    each task keeps so many rows: no page costs more than the first, and rows that come or go elsewhere shift nothing."""
    if bookmark is not None:
        at, last = F.lit(bookmark[0]), F.lit(bookmark[1])
        older = F.col(by).isNull() if bookmark[0] is None else (F.col(by) < at) | F.col(by).isNull() | (F.col(by) == at) & (F.col(key) > last)
        rows = rows.where(older & (F.col(key) > last) if bookmark[0] is None else older)
    return rows.orderBy(F.desc_nulls_last(by), key).limit(size)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``position`` from 0 in an order, which should have no ties.  Rows are dealt out by ranges of the order;
    each range is numbered by itself, and a small table has where it begins, so no task holds all rows."""
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.withColumn("_part", part).join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn("position", F.col("_start") + within).drop("_part", "_at", "_start")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of documents that aren't to go."""
    return rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal key; of equal new rows one."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.dropDuplicates(key))
