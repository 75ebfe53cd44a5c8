"""What filters take from a corpus in every order in which they can be applied: a lattice-edge aggregation.

A document's failures are a set of filters (a bit mask).  The lattice of subsets of n filters has n * 2^(n-1)
edges (80 for five): a subset that was applied already, and the filter applied next.  Every document adds to
all edges, by its mask: it is kept after the edge if its mask meets neither, removed on it if it fails the next
filter and none of the subset, redundant if it fails both.  Documents are first added up by part and mask, so at
most 2^n rows of a part are spread over edges.  An order of the filters is a path through the lattice, and its
steps are edges, so aggregated edges joined to the n * n! steps of all orders give the audit (600 rows a part
for five filters).  The Shapley sum of a filter needs no orders: an edge with k filters applied lies on
k! (n - 1 - k)! paths.

Defined results: a null text is empty; a null part is the empty string and one with it; a document
without an id is never a copy of a smaller id, nor makes others copies; rows that repeat an id are documents of
their own, and none is a copy of the other.  Labels of one id count as one, set if any of its rows is.  An empty
table gives no rows.  Columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import words, written

#: Orders grow as the factorial of the filters; their steps are broadcast.
MOST_FILTERS = 7


@dataclass(frozen=True)
class Filter:
    """A letter, and the condition under which a document fails: on ``text``, ``words`` (an array) and ``doc_id``, or
    (``across``) on ``doc_id`` and ``first_id``, the least id of equal texts."""

    letter: str
    fails: Column
    across: bool = False


def standard() -> tuple[Filter, ...]:
    """Short texts, few different words, capitals, symbols, and copies of a smaller id's text."""
    n, t = F.size("words"), F.col("text")
    return (
        Filter("A", n < 50),
        Filter("B", 100 * F.size(F.array_distinct("words")) < 65 * n),
        Filter("C", 100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.length(t)),
        Filter("D", t.rlike("[#$%&*|]")),
        Filter("E", F.col("doc_id") > F.col("first_id"), across=True),
    )


def with_failures(docs: DataFrame, filters: tuple[Filter, ...], id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of each document: bit i of mask is set if it fails filter i.  Only ids, parts, masks and 16
    bytes of a text's hash leave the scan."""

    def bits(own: list[int]) -> Column:
        out = F.lit(0)
        for i in own:
            out = out.bitwiseOR(F.when(filters[i].fails, 1 << i).otherwise(0))
        return out

    copies = [i for i, f in enumerate(filters) if f.across]
    others = [i for i in range(len(filters)) if i not in copies]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("text")).withColumn("words", words(F.col("text")))
    base = written(rows.select("doc_id", "part", bits(others).alias("mask"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")), "audit-base")
    first = written(base.groupBy("key").agg(F.min("doc_id").alias("first_id")), "audit-first")  # written, so that Spark may split the join where a text has very many copies
    return base.join(first, "key").select(F.col("doc_id").alias("id"), "part", F.col("mask").bitwiseOR(bits(copies)).alias("mask"))


def cells(failures: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many of them are labelled so."""
    if labels is None:
        marked = failures.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        set_to_1 = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
        one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_labelled")).agg(set_to_1("quality"), set_to_1("toxic"))
        one = written(one, "audit-labels")
        marked = failures.join(one, failures["id"] == one["_labelled"], "left").withColumn("good", F.coalesce("quality", F.lit(0)))
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def edges(by_mask: DataFrame, n_filters: int) -> DataFrame:
    """The lattice's edges for each part: (part, applied, bit) with kept, removed, redundant, unique_fails,
    good_lost and toxic_lost, zeros included."""
    every = [(s, 1 << i) for i in range(n_filters) for s in range(1 << n_filters) if not s >> i & 1]
    spread = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in every)))
    rows = by_mask.withColumn("edge", spread).select("part", "mask", "n", "good", "toxic", "edge.*")
    earlier, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    count = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    return rows.groupBy("part", "applied", "bit").agg(
        count(~earlier & ~fails, "n", "kept"),
        count(~earlier & fails, "n", "removed"),
        count(earlier & fails, "n", "redundant"),
        count(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        count(~earlier & fails, "good", "good_lost"),
        count(~earlier & fails, "toxic", "toxic_lost"),
    )


def audit(by_edge: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, with the edge that the step walks along and the
    Shapley sum of its filter: what it removes, summed over all orders."""
    n = len(letters)
    if n > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: all their orders are walked")
    steps = [
        ("".join(letters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), 1 << order[k])
        for order in permutations(range(n))
        for k in range(n)
    ]
    paths = by_edge.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    weights = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), (F.bit_count("applied") + 1).cast("int"))
    shapley = by_edge.groupBy("part", "bit").agg(F.sum(F.col("removed") * weights).alias("shapley"))
    walked = by_edge.join(shapley, ["part", "bit"]).join(F.broadcast(paths), ["applied", "bit"])  # n * n! rows, whatever the data
    return walked.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame | None = None, filters: tuple[Filter, ...] | None = None, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of filters over docs, by part."""
    filters = filters or standard()
    by_mask = cells(with_failures(docs, filters, id_col, text, part), labels)
    by_edge = written(edges(by_mask, len(filters)), "audit-edges")
    return audit(by_edge, "".join(f.letter for f in filters))
