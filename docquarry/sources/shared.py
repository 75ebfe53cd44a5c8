"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine stands in
    for a local session (a test), and on a cluster it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or tempfile.gettempdir()).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: computed once, whatever reads it, and safe from lost
    executors; its size is known to the optimizer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docquarry/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows up to which Spark may broadcast what was written.
FEW_BYTES = 8 << 20


def sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, of a few columns that were written, kept from being broadcast if its rows take more than FEW_BYTES.  Spark plans by
    the size of files, and where values repeat those are a small part of what the rows take in the driver's memory."""
    return df.hint("merge") if (df.agg(F.sum(row_bytes)).first()[0] or 0) > FEW_BYTES else df


#: Most rows and bytes of an Arrow batch where rows are whole texts or packed blocks of vectors.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches() -> None:
    """Lowers the session's limits on an Arrow batch to BATCH_ROWS and BATCH_BYTES; lower limits stay."""
    conf = SparkSession.active().conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = str(conf.get(key, None) or "")
        if not found.isdigit() or not 0 < int(found) <= most:
            conf.set(key, str(most))
