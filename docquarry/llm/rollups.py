"""Token counts as delta-maintained rollups.

A store is a folder with a folder for each committed batch.  A batch is a table of changes:

    change        insert, delete or revise
    source, lang, tokenizer    what totals are kept by (null is a value of its own)
    n_tokens      the count inserted, deleted, or after revision
    old_tokens    for revise: the count before; otherwise not read

Every change adds signed numbers to one total: insert (+1 document, +n), delete (-1, -n), revise
(0, n - old).  Sums don't depend on order, so batches may come in any order.  A batch is added up and
written under a name of the attempt's own, and committed by renaming that folder to its id, which fails if the id is
there: of two writers of one id, one commits.  So a batch applied twice, or retried after a failure, counts
once.  An id names its batch: what comes later under it, whatever it holds, is not read.  Ids may hold any
characters.  Null counts count as 0.  An empty batch is committed and adds nothing.

``compact`` adds up what is committed into one snapshot that names the batches in it; totals are then the newest
snapshot and the batches it doesn't name, so no more rows are read as batches add up.  The folder of every batch is
still listed.  Commits need a store whose rename fails where the target is there (HDFS, local files); on an object
store put a committer or a table format in its place.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_SNAPSHOT = f"{_SCHEMA}, batch string"


def signed(changes: DataFrame) -> DataFrame:
    """What each change adds: n_docs and n_tokens, by KEYS.  An unknown kind of change is an error."""
    n, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_tokens"))
    kind = F.col("change")
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    return changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))


def added(parts: DataFrame) -> DataFrame:
    """Totals by KEYS; those with neither documents nor tokens left are gone."""
    return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


class Store:
    """Rollups in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={quote(batch, safe='')}"

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._fs(path)
        return fs.exists(hadoop)

    def _names(self, prefix: str) -> list[str]:
        """What follows the prefix in names of complete folders."""
        fs, path = self._fs(self.path)
        names = (s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else ()
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix) and self._exists(f"{self.path}/{n}/_SUCCESS"))

    def _commit(self, df: DataFrame, folder: str) -> bool:
        """Writes df and makes it the folder; False if another has done so."""
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        df.write.parquet(attempt)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, source = self._fs(attempt)
        _, target = self._fs(folder)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), plain)
        except Py4JJavaError:
            fs.delete(source, True)
            if not self._exists(f"{folder}/_SUCCESS"):
                raise
            return False
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest snapshot and the batches in it."""
        found = self._names("snapshot=")
        if not found:
            return None, set()
        folder = f"{self.path}/snapshot={found[-1]}"
        return folder, {r[0] for r in self.spark.read.schema(_SNAPSHOT).parquet(folder).where("batch IS NOT NULL").select("batch").collect()}

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self._folder(batch)}/_SUCCESS")

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(map(unquote, self._names("batch=")))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already."""
        return not self.committed(batch) and self._commit(added(signed(changes)), self._folder(batch))

    def _added(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        """Totals of a snapshot and of batches that it doesn't name."""
        parts = self.spark.read.schema(_SCHEMA).parquet(*map(self._folder, batches)) if batches else self.spark.createDataFrame([], _SCHEMA)
        columns = _SCHEMA.replace(" string", "").replace(" long", "").split(", ")
        parts = parts.select(*columns)
        if snapshot:
            parts = parts.unionByName(self.spark.read.schema(_SNAPSHOT).parquet(snapshot).where("batch IS NULL").select(*columns))
        return added(parts)

    def _listing(self) -> tuple[str | None, set[str], list[str]]:
        """The newest snapshot, the batches in it, and all committed batches, listed after the snapshot."""
        return (*self._snapshot(), self.batches())

    def compact(self) -> None:
        """Adds up all committed batches into a new snapshot.  Batches keep their folders, by which they are known.
        The snapshot's names and its totals come from one listing, so a batch committed meanwhile is in neither."""
        snapshot, within, own = self._listing()
        rows = self._added(snapshot, [b for b in own if b not in within]).withColumn("batch", F.lit(None).cast("string"))
        names = self.spark.createDataFrame([(None, None, None, None, None, b) for b in own], _SNAPSHOT)
        self._commit(rows.unionByName(names).select(*names.columns), f"{self.path}/snapshot={len(own):012d}")  # or there is one of as many batches

    def totals(self) -> DataFrame:
        """Totals over the committed batches."""
        snapshot, within, own = self._listing()
        return self._added(snapshot, [b for b in own if b not in within])
