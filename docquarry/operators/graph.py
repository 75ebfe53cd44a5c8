"""Evidence graph: nodes and edges from facts, and what is reachable from anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.shared import written


def edges_of_facts(facts: DataFrame) -> DataFrame:
    """(src, dst, kind): company - fact - metric and year, fact - chunk, and each year of a company and
    metric to the one before.  Keys hold the document, so no path leaves one."""
    doc = F.col("doc_id").cast("string")
    node = lambda kind, *cols: F.concat_ws(":", F.lit(kind), doc, *(F.col(c).cast("string") for c in cols))
    fact = node("fact", "company", "metric", "year")
    parts = F.array(
        F.struct(node("company", "company").alias("src"), fact.alias("dst"), F.lit("HAS_FACT").alias("kind")),
        F.struct(fact.alias("src"), node("metric", "metric").alias("dst"), F.lit("OF_METRIC").alias("kind")),
        F.struct(fact.alias("src"), node("year", "year").alias("dst"), F.lit("IN_YEAR").alias("kind")),
        F.struct(fact.alias("src"), node("chunk", "chunk_id").alias("dst"), F.lit("EVIDENCED_BY").alias("kind")),
    )
    own = facts.select(F.explode(parts).alias("e")).select("e.*").distinct()
    w = Window.partitionBy("doc_id", "company", "metric").orderBy(F.desc("year"))
    years = facts.select("doc_id", "company", "metric", "year").distinct().withColumn("_fact", fact)
    before = years.withColumn("_before", F.lead("_fact").over(w)).where("_before IS NOT NULL")
    return own.unionByName(before.select(F.col("_fact").alias("src"), F.col("_before").alias("dst"), F.lit("PREVIOUS_PERIOD").alias("kind")))


def reachable(edges: DataFrame, anchors: DataFrame, hops: int = 2) -> DataFrame:
    """(anchor, node, distance): nodes within so many edges, in either direction, of each anchor node."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = anchors.select(F.col("node").alias("anchor"), F.col("node"), F.lit(0).alias("distance")).distinct()
    frontier = found
    for d in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node"), F.lit(d).alias("distance")).distinct()
        frontier = step.join(found, ["anchor", "node"], "left_anti").select("anchor", "node", "distance")
        found = found.unionByName(frontier)
    return found


def evidence(edges: DataFrame, anchor_sets: DataFrame, hops: int = 2) -> DataFrame:
    """(query, node): chunk nodes reachable from every set of anchors (query, set, node) of a query, or,
    where there is none, from any."""
    near = reachable(edges, anchor_sets.select("node"), hops).where("node LIKE 'chunk:%'")
    by_set = anchor_sets.select("query", "set", F.col("node").alias("anchor")).join(near, "anchor").select("query", "set", "node").distinct()
    sets = anchor_sets.groupBy("query").agg(F.count_distinct("set").alias("sets"))
    n = by_set.groupBy("query", "node").agg(F.count("*").alias("n")).join(sets, "query").withColumn("all", F.col("n") == F.col("sets"))
    some = F.max("all").over(Window.partitionBy("query"))
    return n.withColumn("_some", some).where("all OR NOT _some").select("query", "node")


#: Nodes of more neighbours are no way from one node to another: nearly all nodes meet in them.
HUB = 100


def paths_between(edges: DataFrame, pairs: DataFrame, hops: int = 4, hub: int = HUB) -> DataFrame:
    """(query, path): the shortest paths of at most ``hops`` edges, in either direction, between the nodes a and b of pairs
    (query, a, b); a path is an array of nodes.  No path leads through a node of over ``hub`` neighbours, though it may begin
    or end in one.  Both ends are followed for half of the way and meet there, so the steps taken grow with the root of the
    number of all paths of that length, and hubs, by their degree, aren't spread through.  Pairs with a null say nothing."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    small = both.groupBy("src").agg(F.count("*").alias("_degree")).where(F.col("_degree") <= hub).select(F.col("src").alias("_small"))
    asked = written(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("query", "a", "b").distinct(), "path-pairs")
    through = both.join(small, F.col("src") == F.col("_small")).select("src", "dst")  # steps on from nodes that aren't hubs

    def followed(end: str, steps: int) -> list[DataFrame]:
        at = asked.select("query", F.col(end).alias("node"), F.array(end).alias("path")).distinct()
        out = [at]
        for d in range(steps):
            way = both if d == 0 else through  # the ends themselves may be hubs
            at = at.join(way, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("query", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
            at = written(at, f"paths-{end}")
            out.append(at)
        return out

    there, back = followed("a", (hops + 1) // 2), followed("b", hops // 2)
    found = None
    for n in range(hops + 1):
        left, right = there[(n + 1) // 2], back[n // 2].select("query", "node", F.col("path").alias("_back"))
        if n > 1:  # where they meet is on the way, so it is no hub
            left = left.join(small, F.col("node") == F.col("_small"), "left_semi")
        met = left.join(right, ["query", "node"]).select("query", F.concat("path", F.slice(F.reverse("_back"), 2, n + 1)).alias("path")).where(F.size(F.array_distinct("path")) == n + 1)
        found = met if found is None else found.unionByName(met)
    shortest = found.withColumn("_least", F.min(F.size("path")).over(Window.partitionBy("query")))
    return shortest.where(F.size("path") == F.col("_least")).select("query", "path").distinct()
