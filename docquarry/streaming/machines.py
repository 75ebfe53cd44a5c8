"""State that outlives a batch: a document's way to being indexed, and a cache whose entries expire.

Both are processors of Spark's transformWithState: state lies in the state store by key, in event time, and is let go
by timers, so it doesn't grow with what has passed.  Rows of a key within one batch are taken in order of time, then
of ``seq``.  Rows older than the watermark don't come in.  ``lifecycles_of`` and ``lookups_of`` say the same about a whole
table, with windows.

The state store must be RocksDB; ``prepare`` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PENDING, INDEXED, FAILED = "pending", "indexed", "failed"
#: Errors after which a document has failed; seconds without news after which it has.
TRIES, SILENCE = 3, 3 * 86_400
#: Seconds that a cache's entry lives, and entries of a bucket.
TTL, MOST = 3600, 50

LIFECYCLE = "doc_id long, ts timestamp, seq long, event string, state string, errors int"
LOOKUP = "bucket long, ts timestamp, seq long, key string, hit boolean, value double"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")


# --- lifecycles -----------------------------------------------------------------------------------


class _Lifecycle(StatefulProcessor):
    def __init__(self, tries: int, silence: int):
        self.tries, self.silence = tries, silence

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lifecycle", "state string, errors int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, errors, due = self.state.get() if self.state.exists() else (None, 0, -1)
        out = []
        for r in _in_order(rows).itertuples():
            if r.event == "submit":
                state, errors = PENDING, 0
            elif state == PENDING and r.event == "error":
                errors += 1
                state = FAILED if errors >= self.tries else PENDING
            elif state == PENDING and r.event == "done":
                state = INDEXED
            if state is not None:
                out.append((key[0], r.ts, r.seq, r.event, state, errors))
            if due >= 0:
                self.handle.deleteTimer(due)
            due = r.ms + 1000 * self.silence if state == PENDING else -1
            if due >= 0:
                self.handle.registerTimer(due)
        if state is not None:
            self.state.update((state, errors, due))
        yield pd.DataFrame(out, columns=["doc_id", "ts", "seq", "event", "state", "errors"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, errors, due = self.state.get()
        if state == PENDING and due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((FAILED, errors, -1))
            at = pd.Timestamp(due, unit="ms")
            yield pd.DataFrame([(key[0], at, -1, "silence", FAILED, errors)], columns=["doc_id", "ts", "seq", "event", "state", "errors"])

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, late: str, tries: int = TRIES, silence: int = SILENCE) -> DataFrame:
    """LIFECYCLE of a stream of events (doc_id, ts, seq, event: submit, error or done): the state after each event of a
    document that was submitted.  It is pending until it is done or has had ``tries`` errors, or until there was no
    news for ``silence`` seconds; what comes after that changes nothing until it is submitted again."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late).select("doc_id", "ts", "seq", "event", "ms")
    return rows.groupBy("doc_id").transformWithStateInPandas(_Lifecycle(tries, silence), LIFECYCLE, "Append", "EventTime")


def lifecycles_of(events: DataFrame, tries: int = TRIES) -> DataFrame:
    """(doc_id, ts, seq, event, state, errors) of a whole table; silence is only known to a stream."""
    order = Window.partitionBy("doc_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("doc_id", "_epoch").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.select("doc_id", "ts", "seq", "event").withColumn("_epoch", F.count_if(F.col("event") == "submit").over(order)).where("_epoch > 0")
    e = e.withColumn("_errors", F.count_if(F.col("event") == "error").over(own))
    ends = F.when((F.col("event") == "done"), F.lit(INDEXED)).when((F.col("event") == "error") & (F.col("_errors") == tries), F.lit(FAILED))
    end = F.first(F.when(ends.isNotNull(), F.struct(ends.alias("state"), F.col("_errors").alias("errors"))), ignorenulls=True).over(own)
    e = e.withColumn("_end", end)
    return e.select("doc_id", "ts", "seq", "event", F.coalesce("_end.state", F.lit(PENDING)).alias("state"), F.coalesce("_end.errors", "_errors").cast("int").alias("errors"))


# --- the cache ------------------------------------------------------------------------------------


class _Cache(StatefulProcessor):
    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value double, ms long, seq long")

    def _drop(self, until: int) -> None:
        for k, v in list(self.entries.iterator()):
            if v[1] + 1000 * self.ttl <= until:
                self.entries.removeKey(k)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _in_order(rows).itertuples():
            if r.event == "put":
                self.entries.updateValue((r.key,), (r.value, r.ms, r.seq))
                self.handle.registerTimer(r.ms + 1000 * self.ttl)
                there = sorted((v[1], v[2], k[0]) for k, v in self.entries.iterator())
                for _, _, old in there[: max(0, len(there) - self.most)]:
                    self.entries.removeKey((old,))
            elif r.event == "get":
                found = self.entries.getValue((r.key,)) if self.entries.containsKey((r.key,)) else None
                hit = found is not None and r.ms < found[1] + 1000 * self.ttl
                out.append((key[0], r.ts, r.seq, r.key, hit, found[0] if hit else None))
        yield pd.DataFrame(out, columns=["bucket", "ts", "seq", "key", "hit", "value"]).astype({"hit": bool, "value": float})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._drop(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame({"bucket": [], "ts": pd.to_datetime([]), "seq": [], "key": [], "hit": [], "value": []}).astype({"bucket": int, "seq": int, "key": str, "hit": bool, "value": float})

    def close(self) -> None:
        pass


def lookups(events: DataFrame, late: str, ttl: int = TTL, most: int = MOST) -> DataFrame:
    """LOOKUP of each get in a stream of (bucket, ts, seq, event: put or get, key, value): whether the bucket held the key.
    An entry lives ``ttl`` seconds from its put; a put takes the place of one of the same key; of more than ``most``
    entries the oldest go.  Expired entries are let go by timers."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late).select("bucket", "ts", "seq", "event", "key", "value", "ms")
    return rows.groupBy("bucket").transformWithStateInPandas(_Cache(ttl, most), LOOKUP, "Append", "EventTime")


def lookups_of(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """LOOKUP of a whole table, without a bound on a bucket's entries.  A key's time is cut into spans of ``ttl``, and
    a put also stands at the beginning of the next span, so no task holds all of a key."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    span = F.floor(ms / (1000 * ttl))
    put = F.col("event") == "put"
    rows = events.select("bucket", "ts", "seq", "event", "key", "value", ms.alias("_ms"), F.explode(F.when(put, F.array(span, span + 1)).otherwise(F.array(span))).alias("_span"))
    w = Window.partitionBy("bucket", "key", "_span").orderBy("_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(put, F.struct("value", "_ms")), ignorenulls=True).over(w)
    found = rows.withColumn("_put", last).where("event = 'get'")
    hit: Column = F.coalesce(F.col("_ms") < F.col("_put._ms") + 1000 * ttl, F.lit(False))
    return found.select("bucket", "ts", "seq", "key", hit.alias("hit"), F.when(hit, F.col("_put.value")).alias("value"))
