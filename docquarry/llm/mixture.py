"""Mixing sources to target weights along a curriculum that changes with training time.

Targets.  The sources share ``SHARE`` times the corpus's size by weight; a source's target stops at
``MOST`` times its own size, and what that leaves over is shared by weight among the others until none is
above (water filling: target = min(MOST * size, level * weight)).

Positions.  A source's weight changes linearly over training time 0 to 1, from its start to 2 - start
times its mean.  Its integral gives the share of the source's demand used up by each time; inverting it
gives each document the time at which the mix has asked for as many of the source's tokens as stand
before it.  Documents stand in order of a hash of their id; the mix runs through them again and again
until the target is met, so a document is taken floor or ceil of target / size times (never more than
MOST), and a source's taken tokens differ from its target by half a document at most.

Running totals are taken in ``BUCKETS`` ranges of the hash for each source, so no task holds a source.
Sources rank by code point, null last.  Documents of size 0 are never worth a token; they keep
their copies.  Null ids are ordered by their text's hash.  An empty table gives an empty result.  Columns of docs
keep their names and values, whatever these are; ``mix`` takes the first free name from it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import free_name

WEIGHTS, SHARE, MOST, BUCKETS = (3, 1, 2), 1.5, 2, 4096
#: Weight at time 0 against the mean, repeating over the ranked sources.
STARTS = (0.5, 1.0, 1.5)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, target, start) of (source, source_size): a row for each source, so the
    windows here are over as many rows as there are sources."""
    repeat = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("rank") - 1, F.lit(len(values))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", repeat(WEIGHTS).cast("double")).withColumn("start", repeat(STARTS).cast("double"))
    cap = (MOST * F.col("source_size")).cast("double")
    by_cap = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    return leveled.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything))).select("source", "source_size", "rank", "target", "start")


def order_key(id_col: str, text: Column | None = None) -> Column:
    """32 bits of the id's MD5."""
    own = F.col(id_col).cast("string")
    return F.conv(F.substring(F.md5(F.coalesce(own, F.md5(text) if text is not None else F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", key: str = "order_key") -> DataFrame:
    """docs with a struct ``mix``: source_size, target, copies, taken and positions (one for each copy).

    docs has the size and the order key of each row as columns.
    """
    # Two columns that are never null stand for the source, so that the join and the window below share one
    # shuffle of the rows.
    name, none = F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull()
    bucket = F.floor(F.col(key) / ((1 << 32) // BUCKETS)).cast("int")
    out = free_name(docs, "mix")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d = docs.select(row, name.alias("_name"), none.alias("_none"), bucket.alias("_bucket"), F.col(id_col).alias("_id"), F.col(size).alias("_n"), F.col(key).alias("_key"))
    id_col, size, key = "_id", "_n", "_key"
    where = ["_name", "_none", "_bucket"]
    sums = d.groupBy(*where).agg(F.sum(size).alias("_sum"))
    before = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.partitionBy("_name", "_none").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_source = sums.groupBy("_name", "_none").agg(F.sum("_sum").alias("source_size"))
    totals = source_targets(by_source.select(F.when(~F.col("_none"), F.col("_name")).alias("source"), "source_size"))
    totals = totals.select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("start").alias("_start"))
    plan = before.join(totals, ["_name", "_none"]).drop("_sum")
    inner = Window.partitionBy(*where).orderBy(key, F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(plan, where).withColumn("_within", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    passes = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0)
    middle = F.col("_offset") + F.col("_within") + F.col(size) / 2
    d = d.withColumn("_passes", passes).withColumn("_middle", middle)
    d = d.withColumn("_copies", (F.col("_passes") + F.when(F.col("_middle") < F.col("_target") - F.col("_passes") * F.col("_size"), 1).otherwise(0)).cast("int"))

    def time(copy: Column) -> Column:
        used = F.least(F.lit(1.0), F.when(F.col("_target") > 0, (copy * F.col("_size") + F.col("_middle")) / F.col("_target")).otherwise(0.0))
        a, b = F.col("_start"), 1 - F.col("_start")  # share used by time t: a t + b t^2
        return F.when(b == 0, used).otherwise((F.sqrt(a * a + 4 * b * used) - a) / (2 * b))

    positions = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), time)).otherwise(F.array().cast("array<double>"))
    mix = F.struct(F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col(size) * F.col("_copies")).cast("long").alias("taken"), positions.alias("positions"))
    return d.select("_row", mix.alias("_mix")).select("_row.*", F.col("_mix").alias(out))


def in_training_order(mixed: DataFrame, mix: str = "mix", whole: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """A row for each copy, range-sorted by position, which is the last column, then by ties.  With ``whole`` the documents that
    aren't taken follow, without a position."""
    position = free_name(mixed, "position")
    each = F.explode_outer if whole else F.explode
    return mixed.withColumn(position, each(f"{mix}.positions")).orderBy(F.col(position).asc_nulls_last(), *ties)
