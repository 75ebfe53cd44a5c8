"""What the operators of this subpackage share: tables, written intermediates, expressions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and 9 to 13, in a Java character class.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine
    stands in for a local session (a test), and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "docquarry-shared")).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read back.  It cuts the lineage, survives lost executors,
    is read by column, and its size is known to the optimizer (so that Spark broadcasts it only if it
    is under spark.sql.autoBroadcastJoinThreshold)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the operators are whole texts, pages or files, so Arrow batches of Spark's usual 10,000 rows would
#: take a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches() -> None:
    """Lowers the session's limits on an Arrow batch to BATCH_ROWS and BATCH_BYTES; lower limits stay."""
    conf = SparkSession.active().conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = conf.get(key, None)
        found = int(found) if str(found or "").isdigit() else 0
        if not 0 < found <= most:
            conf.set(key, str(most))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the matches of [^\\x20\\x09-\\x0D]+; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    """How many words, without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
