"""A training corpus from raw documents: five stages, each written and read again before the next.

Every stage is a function of (spark, docs, sf_dir) that gives a DataFrame; all but the last give the
columns of documents.  They work on all rows of docs, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, mixture, quality_classifier, quality_rules, simhash
from docquarry.llm.common import free_name, n_words, table, written
from docquarry.llm.queries import rank_file


def _own(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row; columns with maps, which Spark doesn't hash, go in as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(_own(docs), docs.dtypes, strict=True)))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, doesn't reject."""
    got = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return got.where(F.col(got.columns[-1]) == 1).select(*_own(docs))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    kept = F.col(free_name(docs, "verdict"))["kept"]
    return quality_rules.judged(docs).where(kept).select(*_own(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: of least id, then of least hash of the text.  Rows without
    an id come last.  Of rows that share both, the one of least hash of all its columns stays; they are reduced to it
    before rows are shuffled, so copies of one row don't meet in a task.  No text is written again."""
    key, kept, row = (free_name(docs, n) for n in ("_key", "_kept", "_row"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.withColumn(key, order)
    groups = simhash.near_groups(rows, key)
    first = written(groups.where("id = component").select(F.col("id").alias(kept)).distinct(), "pipeline-groups")
    one = rows.groupBy(key).agg(F.min_by(F.struct(*_own(docs)), _row_hash(docs)).alias(row))
    return one.join(first, F.col(key) == F.col(kept), "left_semi").select(f"{row}.*")


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    doc = F.struct(*_own(docs)).alias("doc")  # so that no name of docs clashes
    sized = docs.select(doc, "doc_id", "source", n_words(F.col("text")).alias("size"), mixture.order_key("doc_id", F.coalesce("text", F.lit(""))).alias("order_key"))
    return mixture.in_training_order(mixture.mixed(sized)).select("doc.*")


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as the mix has it, and digests of the ids and of what they decode to."""
    got = bpe.with_ids(docs.select("doc_id", "text"), *rank_file())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources to target weights", mixture_stage),
    ("byte-level BPE encoding and decoding", byte_bpe_stage),
]

#: The classifier, the estimated rules, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
