import random

from pyspark.sql import functions as F

from docquarry.operators import positions


def pairs(df):
    return sorted(((r["p"], r["t"]) for r in df.select("p", "t").collect()), key=str)


def brute(phrases, texts):
    return sorted(((p, t) for p, a in phrases for t, b in texts if a is not None and b is not None and a in b), key=str)


def test_against_every_pair(spark):
    rng = random.Random(2)
    words = ["the", "a", "of", "ab", "b", "xab", "harbour", "storm", "ship", "长期", "é"]
    seps = [" ", "  ", "\n", "\t"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n))

    texts = [(i, text(rng.randrange(40))) for i in range(60)] + [(60, None), (61, ""), (62, "the the the the the"), (None, "ab of b ab")]
    texts += [(100 + i, texts[i][1]) for i in range(5)]
    phrases = []
    for i in range(120):  # cut from texts, so that they begin and end within words
        t = rng.choice(texts)[1] or "?"
        a = rng.randrange(len(t) + 1)
        phrases.append((i, t[a : a + rng.randrange(30)]))
    phrases += [(200, "the the the"), (201, ""), (202, None), (203, "nowhere at all here"), (204, "xab of"), (205, "the storm of nothing"), (204, "xab of"), (206, "期 a"), (207, " of "), (208, " "), (209, "our"), (210, "r st"), (211, "a"), (212, "\n")]
    p = spark.createDataFrame(phrases, "p long, asked string").repartition(2)
    t = spark.createDataFrame(texts, "t long, content string").selectExpr("*", "1 AS f", "'x' AS at", "2 AS `a.b`").repartition(3)
    got = positions.containing(p, t, "asked", "content")
    assert got.columns == ["p", "asked", "t", "content", "f", "at", "a.b"]
    assert pairs(got) == brute(phrases, texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert pairs(positions.containing(p, t, "asked", "content")) == brute(phrases, texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert positions.containing(p.limit(0), t, "asked", "content").count() == positions.containing(p, t.limit(0), "asked", "content").count() == 0


def test_no_pairs_of_all_phrases_and_texts(spark):
    p = spark.createDataFrame([(1, "one two three four five"), (2, "four")], "p long, asked string")
    t = spark.createDataFrame([(1, "zero one two three four five six")], "t long, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = positions.containing(p, t, "asked", "content")
        assert pairs(got) == [(1, 1), (2, 1)]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "content" not in "".join(x for x in plan.split("\n") if "Cartesian" in x or "NestedLoop" in x)


def test_texts_stay_where_phrases_are_few(spark):
    """Rare words and pairs are of a known size, so neither postings nor texts are shuffled to be looked up."""
    small, name = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", F.col("text").alias("asked"))
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        got = positions.containing(asked, texts, "asked", "text")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    want = texts.join(asked, F.contains("text", "asked")).select("item_id", "doc_id")
    assert sorted(map(tuple, got.select("item_id", "doc_id").collect())) == sorted(map(tuple, want.collect()))
