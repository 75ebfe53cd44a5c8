import hashlib
from collections import Counter

import corpus_pipeline
from docquarry.llm import bpe, quality_rules, simhash
from docquarry.llm.queries import queries, rank_file

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    (_, classify), (_, rules), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    kept = classify(spark, docs, D)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and {i for i, q in labels.items() if q == 1} <= stay
    ruled = rules(spark, docs, D)
    verdicts = {r["doc_id"]: r["verdict"]["kept"] for r in quality_rules.judged(docs).collect()}
    assert ruled.columns == columns and {r["doc_id"] for r in ruled.collect()} == {i for i, k in verdicts.items() if k}
    one = dedup(spark, docs, D)
    groups = {r["id"]: r["component"] for r in simhash.near_groups(docs).collect()}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))
    mixed = mix(spark, docs, D)
    times = Counter(r["doc_id"] for r in mixed.collect())
    taken = {r["doc_id"]: r["copies"] for r in queries()["op2_source_mixture"](spark, D).collect()}
    assert mixed.columns == columns and times == Counter({i: n for i, n in taken.items() if n})
    enc = bpe.encoding(*rank_file())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encode(spark, docs, D).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run(spark):
    got = corpus_pipeline.run(spark, D)
    n, distinct = got.count(), got.select("doc_id").distinct().count()
    assert 0 < distinct <= n <= 400 and got.where("ids_sha256 IS NULL").count() == 0


def test_odd_and_empty(spark, odd):
    from pyspark.sql import functions as F

    more = {"a.b": F.lit(1), "marks": F.create_map(F.lit("k"), F.lit("v"))}
    for docs in (odd.withColumns(more), odd.withColumns(more | {"verdict": F.struct(F.lit(True).alias("kept")), "score": F.lit(0)})):
        assert docs.count() == 12
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, D)
            assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
            assert got.count() <= 2 * docs.count(), name
        # no text of the fixture passes the rules: all are under 50 words, or one word repeated
        assert dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, D).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() <= 2 * docs.count(), name
        assert stage(spark, docs.limit(0), D).count() == 0, name
    dedup = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    ids = [r["doc_id"] for r in dedup(spark, docs, D).collect()]
    assert ids.count(9) == 1 and ids.count(None) == 1 and 5 not in ids


def test_dedup_keeps_a_row_of_each_group(spark):
    texts = ["Ships came to the harbour before the storm began and stayed there", "A recipe asks for flour, eggs, sugar and two spoons of butter", "Numbers of the census were given by county, town and village"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, D).collect()
    assert sorted((r["text"], r["doc_id"] or 0) for r in got) == sorted([(texts[0], 1), (texts[1], 1), (texts[2], 0)])


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
