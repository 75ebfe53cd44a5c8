import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import phrases
from docquarry.sources import shared


def test_numbers_and_quotes(spark):
    c = spark.createDataFrame([("d", "c1", "text", "网点 15,434 家，1.2%"), ("d", "c2", "section", "1.2%"), ("d", "c3", "text", "says: core capital plan"), ("d", "c4", "text", "不良率1.2%")], "doc_id string, chunk_id string, chunk_type string, content string")
    index = phrases.number_index(c)
    assert {(r["phrase"], r["chunk_id"]) for r in index.collect()} == {("15434家", "c1"), ("1.2%", "c1"), ("1.2%", "c4")}
    q = spark.createDataFrame([(1, "15,434家的1.2%"), (2, 'what of "core capital"'), (3, "none")], "qid int, question string")
    assert [(r["qid"], r["chunk_id"]) for r in phrases.number_hits(q, index).orderBy("rank").collect()] == [(1, "c1"), (1, "c4")]
    assert [(r["qid"], r["chunk_id"]) for r in phrases.quoted_hits(q, c).collect()] == [(2, "c3")]


def _joins(df):
    return re.findall(r"\w+Join(?= )", df._jdf.queryExecution().executedPlan().toString())


def test_sets_of_phrases_are_not_broadcast(spark):
    """Sets that repeat take little in files and much in memory: no join of hits may be planned by files.  Equal sets, ties, nulls."""
    words = [f"the phrase of number {i}" for i in range(6)]
    c = spark.createDataFrame([(i if i != 7 else None, " and ".join(words[: i % 4 + 1])) for i in range(40)], "chunk_id int, content string")
    asked = [(q if q != 9 else None, " or ".join(f'"{w}"' for w in words[: q % 3 + 1])) for q in range(12)] + [(20, '"the phrase"'), (21, "nothing")]
    q = spark.createDataFrame(asked, "qid int, question string")
    got = phrases.quoted_hits(q, c)
    assert "BroadcastHashJoin" not in _joins(got) and "SortMergeJoin" in _joins(got)
    held = {i: set(words[: i % 4 + 1]) | {"the phrase"} for i in range(40)}
    want = set()
    for qid, text in asked:
        own = {w for w in [*words, "the phrase"] if f'"{w}"' in text}
        order = sorted(((-sum(map(len, own & h)), i if i != 7 else -1) for i, h in held.items() if own & h))[:3]
        want |= {(qid, None if i < 0 else i, n + 1) for n, (_, i) in enumerate(order)}
    assert {(r["qid"], r["chunk_id"], r["rank"]) for r in got.collect()} == want


def test_written_rows_are_measured_not_their_files(spark, monkeypatch):
    df = shared.written(spark.range(1000).select(F.lit("much the same text").alias("t"), "id"), "sized")
    other = spark.range(1000)
    assert _joins(shared.sized(df, F.octet_length("t")).join(other, "id")) == ["BroadcastHashJoin"]
    monkeypatch.setattr(shared, "FEW_BYTES", 17_000)
    assert _joins(shared.sized(df, F.octet_length("t")).join(other, "id")) == ["SortMergeJoin"]
    assert shared.sized(df.limit(0), F.octet_length("t")).count() == 0


def test_union_of_routes(spark):
    a = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1)], "qid int, chunk_id string, score double")
    assert {r["chunk_id"]: r["score"] for r in phrases.union_best([a, a.withColumn("score", F.col("score") * 2)]).collect()} == {"a": 1.0, "b": 0.2}


def test_places(spark):
    w = [("d", p, n, word, float(n), 0.0, n + 1.0, 1.0) for p, text in ((1, "the net profit rose"), (2, "net profit and net profit"), (3, "net")) for n, word in enumerate(text.split())]
    df = spark.createDataFrame(w, "doc_id string, page int, n int, word string, x0 double, y0 double, x1 double, y1 double")
    got = {r["page"]: r for r in phrases.located(df, ["Net", "profit"]).collect()}
    assert set(got) == {1, 2} and (got[1]["x0"], got[1]["x1"]) == (1.0, 3.0) and got[2]["found"] == 2 and got[2]["x0"] is None


def test_stand_in_vectors(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(phrases.stand_in_vector(F.col("t"), 8).alias("v"))
    a, b, c = (r["v"] for r in df.collect())
    assert a == b != c and sum(x * x for x in a) == pytest.approx(1.0)
