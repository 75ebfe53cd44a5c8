"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group, and a group stays together: it is placed in the shard where the dot
product of its share of the totals with the shard's residual capacity is highest.  Capacity for bytes is nearly
tight, so sizes end near equal; tokens and rows have some play, and are balanced as far as that allows.

Placing is in order of size, so it is done in steps of bounded length.  Groups of over 1 / ``PARTS`` of any total
(at most 3 * PARTS of them, whatever the size of the corpus) go first, on the driver.  All others are dealt out by
a hash into lots of about ``LOT`` groups (one lot, if there are no more), and each lot is packed in a task of its
own, every group by its dot product, into its part of what the large ones left of each shard's capacity.
A group that no shard could hold (over 1 / shards of any total) is split by a hash of the row's id into
pieces of at most 1 / PIECES of the total.

Null texts count as empty ones.  Equal rows get one shard and slots next to one another or not.  An empty
table gives an empty result.  Slots count the rows of a shard from 0 without a gap: they are numbered in
``SLOT_RANGES`` ranges of a hash for each shard, so no task holds a shard.  Columns of rows keep their names and
values, whatever these are; ``shard`` and ``slot`` take the first free names from these on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import free_name, written

SHARDS, PARTS, PIECES, LOT, SLOT_RANGES = 8, 4096, 64, 1 << 14, 1024
#: What a shard may hold over its equal share: of bytes, tokens and rows.
SLACK = (0.001, 0.25, 0.25)


def place(items: np.ndarray, shards: int, slack: tuple[float, ...] = SLACK, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each item, and what is left of each shard's capacity.  items: a row for each, its size in each
    dimension; they are in units of an equal share of a shard.

    A shard's capacity is its equal share of the totals and a slack, in each dimension, or ``left``.  Items go in
    descending order of their largest dimension, each to the shard with the highest dot product of the
    item with the residual capacities, among the shards it fits into; where it fits into none, among those
    whose first dimension holds it; else to the shard with the most room in the first dimension.  Ties go
    to the lower shard.
    """
    if left is None:
        left = np.ones((shards, items.shape[1])) + np.array(slack)
    left, out = left.copy(), np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        room = np.round(left - items[i], 12) >= 0
        able = room.all(axis=1)
        able = able if able.any() else room[:, 0]
        want = np.where(able, np.round(left @ items[i], 12), -np.inf) if able.any() else np.round(left[:, 0], 12)
        out[i] = s = int(np.argmax(want))
        left[s] -= items[i]
    return out, left


def _packed(left: np.ndarray, totals: list[int], shards: int):
    """Packs a lot: (_group, dimensions) of it to (_group, _to)."""
    dims = len(totals)

    def of(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by([("_group", "ascending")])
        items = np.column_stack([lot[f"_d{k}"].to_numpy() for k in range(dims)]).astype(np.float64) / np.maximum(totals, 1) * shards
        room = np.maximum(left - np.array(SLACK)[:dims], 0)  # without slack: shares of the lot
        share = np.divide(room, room.sum(axis=0), out=np.full_like(room, 1 / shards), where=room.sum(axis=0) > 0)
        own = items.sum(axis=0)
        to, _ = place(items, shards, left=share * own + np.array(SLACK)[:dims] * own / shards)
        return pa.table({"_group": lot["_group"], "_to": pa.array(to, pa.int32())})

    return of


def sharded(rows: DataFrame, group: str = "group", id_col: str = "doc_id", sizes: tuple[str, ...] = ("bytes", "tokens"), shards: int = SHARDS) -> DataFrame:
    """rows with ``shard`` and ``slot``.  group: a key, string or binary, that rows of equal text share; null
    counts as empty."""
    dims = [f"_d{k}" for k in range(len(sizes) + 1)]
    own = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in sizes] + [F.lit(1).cast("long")]
    key = F.coalesce(F.col(group).cast("binary"), F.lit(b""))
    base = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col(id_col).alias("_id"), key.alias("_group"), *(c.alias(d) for c, d in zip(own, dims, strict=True)))
    groups = written(base.groupBy("_group").agg(*(F.sum(d).alias(d) for d in dims)), "sharding-groups")
    first = groups.agg(F.count("*"), *(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in dims)).first()
    n, totals = first[0], list(first[1:])
    share = F.greatest(*(F.col(d) / max(1, t) for d, t in zip(dims, totals, strict=True)))

    # at most len(dims) * PARTS groups, and PIECES for each of at most len(dims) * shards of them
    pieces = F.when(share > 1 / shards, F.ceil(share * PIECES)).otherwise(1).cast("int")
    large = written(groups.where(share > 1 / PARTS).select(F.col("_group").alias("_large"), pieces.alias("_pieces")), "sharding-large")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "_id"), F.col("_pieces")).cast("int")
    one_by_one = base.join(F.broadcast(large), F.col("_group") == F.col("_large")).withColumn("_piece", piece)
    items = one_by_one.groupBy("_group", "_piece").agg(*(F.sum(d).alias(d) for d in dims)).orderBy("_group", "_piece").collect()
    given = np.array([[r[d] for d in dims] for r in items], np.float64).reshape(-1, len(dims)) / np.maximum(totals, 1) * shards
    placed, left = place(given, shards, SLACK[: len(dims)])
    where = rows.sparkSession.createDataFrame([(r["_group"], r["_piece"], int(s)) for r, s in zip(items, placed, strict=True)], "_g binary, _k int, _to int")
    one_by_one = one_by_one.join(F.broadcast(where), (F.col("_group") == F.col("_g")) & (F.col("_piece") == F.col("_k"))).select("_row", "_id", "_to")

    lots = max(1, -(-n // LOT))
    small = groups.where(share <= 1 / PARTS).withColumn("_lot", F.pmod(F.xxhash64(F.lit("lot"), "_group"), F.lit(lots)))
    to = small.groupBy("_lot").applyInArrow(_packed(left, totals, shards), "_group binary, _to int")
    # a group here has under 1 / PARTS of the rows, so this join has no hot key
    rest = base.join(written(to, "sharding-lots"), "_group").select("_row", "_id", "_to")
    shard = free_name(rows, "shard")
    done = with_slots(one_by_one.unionByName(rest))
    return done.select("_row.*", F.col("_to").alias(shard), F.col("_slot").alias(free_name(rows, "slot")))


def with_slots(df: DataFrame, id_col: str = "_id", shard: str = "_to", slot: str = "_slot") -> DataFrame:
    """df with ``slot``: numbers from 0 within each shard."""
    ranged = df.withColumn("_range", F.pmod(F.xxhash64(F.lit("slot"), id_col), F.lit(SLOT_RANGES)).cast("int"))
    counts = ranged.groupBy(F.col(shard).alias("_s"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(shard, "_range").orderBy(id_col)) - 1
    numbered = ranged.withColumn("_own", own).join(before, (F.col(shard) == F.col("_s")) & (F.col("_range") == F.col("_r")))
    return numbered.withColumn(slot, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_s", "_r", "_own", "_before")


def group_key(text: Column) -> Column:
    """Rows of equal text share it; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
