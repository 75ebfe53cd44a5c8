"""Plans of sub-questions, for many questions at once: their order, and answers put into what depends on
them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for what an earlier sub-question found.
POSSESSIVES = ("其", "该行的", "该银行的", "该公司的", "该企业的")
STANDINS = ("该行", "该银行", "该公司", "该企业", "它")


def ordered(plans: DataFrame, most: int = 5) -> DataFrame:
    """(qid, n, depth) of plans (qid, n, needs array<int>): sub-questions after those they need, none in a
    circle waiting for ever (their depth is that of the last round).  Plans have at most five parts, so
    as many rounds settle every depth; each round is a fold over a plan's own array."""
    each = plans.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("needs", F.array().cast("array<int>")).alias("needs")))).alias("_p"))
    each = each.withColumn("_d", F.transform("_p", lambda p: F.lit(0)))
    for _ in range(most):

        def deeper(p: Column) -> Column:
            known = F.filter(p["needs"], lambda m: (m != p["n"]) & F.exists("_p", lambda x: x["n"] == m))
            below = F.transform(known, lambda m: F.get("_d", (F.array_position(F.transform("_p", lambda x: x["n"]), m) - 1).cast("int")) + 1)
            return F.least(F.coalesce(F.array_max(below), F.lit(0)), F.lit(most))

        each = each.withColumn("_d", F.transform("_p", deeper))
    return each.select("qid", F.explode(F.arrays_zip(F.col("_p.n").alias("n"), F.col("_d").alias("depth"))).alias("z")).select("qid", "z.n", "z.depth")


def with_entity(question: Column, entity: Column) -> Column:
    """A dependent question with the entity found in place of the words that stand for it."""
    out = question
    for p in POSSESSIVES[1:]:
        out = F.replace(out, F.lit(p), F.concat(entity, F.lit("的")))
    for p in STANDINS:
        out = F.replace(out, F.lit(p), entity)
    return F.when(entity.isNull() | (entity == ""), question).otherwise(out)
