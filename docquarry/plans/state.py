"""Queries on versions and on state: tables with history, lifecycles, expiring caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import register
from docquarry.plans.tables import table
from docquarry.sources.shared import shared_folder
from docquarry.sources.versioned import VersionedTable
from docquarry.streaming import machines

_EVENTS = "e AS (SELECT user_id AS doc_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'other' END AS event FROM events)"


@register(
    "lifecycle_states",
    f"""WITH {_EVENTS}, p AS (SELECT *, count(*) FILTER (event = 'submit') OVER (PARTITION BY doc_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM e),
    n AS (SELECT *, count(*) FILTER (event = 'error') OVER w AS n, min(seq) FILTER (event = 'done') OVER w AS any_done FROM p WHERE epoch > 0 WINDOW w AS (PARTITION BY doc_id, epoch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, epoch ORDER BY ts, seq) AS place FROM n),
    f AS (SELECT doc_id, epoch, min(place) FILTER (event = 'done') AS done_at, min(place) FILTER (event = 'error' AND n = 3) AS failed_at FROM k GROUP BY 1, 2),
    s AS (SELECT k.*, done_at, failed_at, CASE WHEN least(coalesce(done_at, 1000000000000), coalesce(failed_at, 1000000000000)) > place THEN 'pending' WHEN coalesce(done_at, 1000000000000) < coalesce(failed_at, 1000000000000) THEN 'indexed' ELSE 'failed' END AS state FROM k JOIN f USING (doc_id, epoch)),
    d AS (SELECT doc_id, epoch, n AS errors_then FROM k JOIN f USING (doc_id, epoch) WHERE place = done_at)
    SELECT s.doc_id, s.seq, s.event, s.state, CAST(CASE state WHEN 'pending' THEN n WHEN 'failed' THEN 3 ELSE errors_then END AS INT) AS errors FROM s LEFT JOIN d ON s.doc_id = d.doc_id AND s.epoch = d.epoch""",
)
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's document after each event: signups submit it, purchases index it, errors are errors."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "submit").when(kind == "purchase", "done").when(kind == "error", "error").otherwise("other")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), event.alias("event"))
    return machines.lifecycles_of(e).select("doc_id", "seq", "event", "state", "errors")


@register(
    "cache_lookups",
    """WITH e AS (SELECT user_id % 7 AS bucket, ts, event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_type, value FROM events WHERE event_type IN ('purchase', 'view')),
    g AS (SELECT g.bucket, g.seq, g.key, p.value, g.ts, p.ts AS pts, row_number() OVER (PARTITION BY g.seq ORDER BY p.ts DESC, p.seq DESC) AS n
      FROM e g LEFT JOIN e p ON p.event_type = 'purchase' AND p.bucket = g.bucket AND p.key = g.key AND (p.ts < g.ts OR (p.ts = g.ts AND p.seq < g.seq)) WHERE g.event_type = 'view')
    SELECT bucket, seq, key, coalesce(epoch_ms(ts) < epoch_ms(pts) + 43200000, FALSE) AS hit, CASE WHEN epoch_ms(ts) < epoch_ms(pts) + 43200000 THEN value END AS value FROM g WHERE n = 1""",
)
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views look up what their user's last purchase left, for twelve hours."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").where(kind.isin("purchase", "view"))
    e = e.select((F.col("user_id") % 7).alias("bucket"), "ts", F.col("event_id").alias("seq"), F.when(kind == "purchase", "put").otherwise("get").alias("event"), F.col("user_id").cast("string").alias("key"), "value")
    return machines.lookups_of(e, 12 * 3600).select("bucket", "seq", "key", "hit", "value")


def _versioned_customers(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Customers as they came; with balances of every third one doubled; without those of nation 3; rebuilt from
    the machinery segment."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    t = VersionedTable(spark, f"{shared_folder(spark)}/docquarry/versioned-{uuid.uuid4().hex}")
    t.append(rows)
    t.replace(rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", 2 * F.col("c_acctbal")), ["c_custkey"])
    t.delete(rows.where("c_nationkey = 3"), ["c_custkey"])
    t.rebuild(rows.where("c_mktsegment = 'MACHINERY'"))
    return t


@register(
    "versions_of_a_table",
    """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer), r AS (SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 2 * c_acctbal ELSE c_acctbal END AS c_acctbal) FROM c),
    v AS (SELECT 1 AS version, * FROM c UNION ALL SELECT 2, * FROM r UNION ALL SELECT 3, * FROM r WHERE c_nationkey <> 3 UNION ALL SELECT 4, * FROM c WHERE c_mktsegment = 'MACHINERY')
    SELECT CAST(version AS INT) AS version, c_custkey, round(c_acctbal, 6) AS c_acctbal FROM v""",
)
def versions_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of a table that was appended to, replaced in part, deleted from and rebuilt."""
    t = _versioned_customers(spark, sf_dir)
    parts = [t.read(v).select(F.lit(v).alias("version"), "c_custkey", F.round("c_acctbal", 6).alias("c_acctbal")) for v in t.versions()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
