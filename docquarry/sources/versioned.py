"""A table of versions: data files that never change, and a log of which of them each version holds.

A writer puts new files under a folder of its own and then commits a manifest, named by the next version's number, that
may not be there yet: of two writers of one version one commits, and the other does its work again on what that made.
Readers take the newest manifest, so a version appears at once and whole; files of a writer that failed before its
commit are in no manifest and are never read.  Older versions stay readable until ``vacuum``.

Replacing and deleting rows is copy on write: only files that hold a row of the keys are written anew, without these.
``rebuild`` switches to new files at once.  A commit may carry a writer's name and number (of a stream's batch); a number
that isn't above the writer's last one changes nothing, so a batch that is run again counts once.

The log needs a file system that creates a file only if it isn't there (local files, HDFS; object stores with conditional
writes).  A manifest lists all files of its version, so its size is that of the file list, not of the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIES = 20


class VersionedTable:
    """A table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def _fs(self, path: str) -> tuple[Any, Any]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        """Numbers of the versions that are still there."""
        fs, log = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, the newest by default, holds; that of a table without versions holds nothing."""
        there = self.versions()
        if version is None:
            version = there[-1] if there else 0
        elif version not in there:
            raise ValueError(f"no version {version}; there are {there}")
        if not there:
            return {"version": 0, "files": [], "schema": None, "writers": {}, "what": None}
        fs, path = self._fs(f"{self.path}/log/{version:020d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> bool:
        """Puts the manifest under its number; False if another is there.  The file is complete before it has its name."""
        own = f"{self.path}/log/attempt-{uuid.uuid4().hex}"
        fs, source = self._fs(own)
        _, target = self._fs(f"{self.path}/log/{manifest['version']:020d}.json")
        stream = fs.create(source, False)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), plain)
        except Py4JJavaError:
            fs.delete(source, False)
            if not fs.exists(target):
                raise
            return False
        return True

    def _write(self, df: DataFrame) -> list[str]:
        """New files with the rows of df."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        fs, path = self._fs(folder)
        return sorted(f"data/{path.getName()}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))

    def _change(self, what: str, schema: StructType | None, files: Callable[[dict], list[str]], writer: tuple[str, int] | None = None) -> int:
        """Commits what ``files`` makes of the newest manifest; of another one, if a writer was faster."""
        for _ in range(TRIES):
            old = self.manifest()
            if writer and old["writers"].get(writer[0], -1) >= writer[1]:
                return old["version"]
            if old["schema"] and schema and [(f.name, f.dataType) for f in StructType.fromJson(old["schema"])] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"columns {schema.simpleString()} instead of {StructType.fromJson(old['schema']).simpleString()}")
            writers = old["writers"] | ({writer[0]: writer[1]} if writer else {})
            new = {"version": old["version"] + 1, "files": files(old), "schema": old["schema"] or (schema.jsonValue() if schema else None), "writers": writers, "what": what}
            if self._commit(new):
                return new["version"]
        raise RuntimeError(f"{TRIES} times another writer was faster")

    # --- reading ---

    def _rows(self, manifest: dict, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("the table has no version yet")
        return self._rows(found, found["files"])

    def history(self) -> list[tuple[int, str, int]]:
        """(version, what made it, files) of each version."""
        return [(m["version"], m["what"], len(m["files"])) for m in map(self.manifest, self.versions())]

    # --- writing ---

    def append(self, df: DataFrame, writer: tuple[str, int] | None = None) -> int:
        new = None

        def files(old: dict) -> list[str]:
            nonlocal new
            new = self._write(df) if new is None else new  # once, however often the commit is tried
            return old["files"] + new

        return self._change("append", df.schema, files, writer)

    def _kept(self, old: dict, keys: DataFrame, key: list[str]) -> list[str]:
        """The files of a version with those that hold a row of the keys written anew, without these.  A null matches a null."""
        if not old["files"]:
            return []
        gone = keys.select(*(F.col(k).alias(f"_gone_{k}") for k in key)).distinct()
        rows = self._rows(old, old["files"])
        same = lambda df: [df[k].eqNullSafe(gone[f"_gone_{k}"]) for k in key]
        hit = rows.select(*key, F.col("_metadata.file_path").alias("_file"))
        names = {r[0] for r in hit.join(gone, same(hit), "left_semi").select("_file").distinct().collect()}  # at most all files
        touched = [f for f in old["files"] if any(n.endswith(f"/{f}") for n in names)]
        if not touched:
            return old["files"]
        own = self._rows(old, touched)
        left = self._write(own.join(gone, same(own), "left_anti"))
        return [f for f in old["files"] if f not in touched] + left

    def replace(self, df: DataFrame, key: list[str], writer: tuple[str, int] | None = None) -> int:
        """The rows of df in place of all rows that share a key with them."""
        new = None

        def files(old: dict) -> list[str]:
            nonlocal new
            new = self._write(df) if new is None else new
            written = self._rows({"schema": df.schema.jsonValue()}, new)  # keys of what was written, not of df computed anew
            return self._kept(old, written, key) + new

        return self._change("replace", df.schema, files, writer)

    def delete(self, keys: DataFrame, key: list[str], writer: tuple[str, int] | None = None) -> int:
        """Without the rows of these keys."""
        return self._change("delete", None, lambda old: self._kept(old, keys, key), writer)

    def rebuild(self, df: DataFrame, writer: tuple[str, int] | None = None) -> int:
        """The rows of df in place of all."""
        new = None

        def files(_: dict) -> list[str]:
            nonlocal new
            new = self._write(df) if new is None else new
            return new

        return self._change("rebuild", df.schema, files, writer)

    def compact(self, files: int) -> int:
        """The same rows in at most so many files."""

        def packed(old: dict) -> list[str]:
            return self._write(self._rows(old, old["files"]).repartition(files)) if len(old["files"]) > files else old["files"]

        return self._change("compact", None, packed)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the newest ``keep`` versions, and files that none of those holds; gives the number of folders
        that went.  Not to be run beside writers: files that aren't committed yet go too."""
        there = self.versions()
        held = {f.split("/")[1] for v in there[-keep:] for f in self.manifest(v)["files"]}
        for v in there[:-keep]:
            fs, path = self._fs(f"{self.path}/log/{v:020d}.json")
            fs.delete(path, False)
        fs, data = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held] if fs.exists(data) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
