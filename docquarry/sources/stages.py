"""Stage tables: what each step of ingestion has made, resumable by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed order of the stages of ingestion.
STAGES = ("10_layout", "20_clean", "30_chunks", "40_vectors", "50_fields")


def put(df: DataFrame, root: str, stage: str) -> None:
    """Writes a stage's rows, replacing those of the documents that df has and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{root}/{stage}")


def get(spark: SparkSession, root: str, stage: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/{stage}")


def pending(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that a stage has no rows of."""
    return documents.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def differences(df: DataFrame, expected: StructType) -> list[str]:
    """How a table's columns differ from what is expected; an empty list if they don't."""
    there = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    return [f"{n}: {there.get(n)} instead of {t}" for n, t in want.items() if there.get(n) != t]


def row_hash(*columns: str) -> F.Column:
    """SHA-256 of the columns as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def checked_counts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose number of rows isn't what their manifest (doc_id, count) says."""
    n = rows.groupBy("doc_id").agg(F.count("*").alias("there"))
    both = manifest.join(n, "doc_id", "full_outer").na.fill(0, ["count", "there"])
    return both.where("count <> there")
