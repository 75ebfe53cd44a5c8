"""Findings of the fourth round."""

import math

import duckdb
import numpy as np
import pyarrow as pa

from docquarry.operators import context, gram_blocks, vector_blocks
from docquarry.plans import evidence, registry


def _grams(t):
    return {t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1)}


def test_section_coverage_reads_whole_texts(spark, tmp_path):
    """What a question asks for stands after the first 600 characters, and after several thousand."""
    texts = ["head\n" + "x " * 400 + "net profit of the year", "head\nno such word", "head\n" + "x " * 9000 + "net profit", "head\nnet", "head\n" + "x " * 400]
    spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Net profit of the year")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = evidence.section_coverage(spark, str(tmp_path)).orderBy("position")
    assert [r["section_id"] for r in got.collect()] == [0, 2, 3, 1, 4]
    first = {r["section_id"]: r["score"] for r in evidence.section_scores(spark, str(tmp_path)).collect()}
    assert first[0] == first[2] == first[4]  # the first 600 characters are that score's definition


def test_long_texts_are_looked_up_in_parts(monkeypatch):
    """Grams that lie across the ends of parts count, and those that several parts have count once."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcd营"), n))
    asked, texts = [word(8) for _ in range(6)] + ["", None], [word(int(n)) for n in rng.integers(0, 60, 12)] + [None, "", "zzzzzzzzzz", word(100)]
    want = [[sum(len(g) ** 2 for g in _grams(t or "") & _grams(q or "")) for q in asked] for t in texts]
    questions = gram_blocks._Questions(pa.array(asked), 2, 5)
    for chars in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(gram_blocks, "CHARS", chars)
        assert questions.weights(pa.array(texts)).tolist() == want
    assert not gram_blocks._Questions(pa.array(["", None]), 2, 5).weights(pa.array(texts)).any()


def _deduplicated(blocks, budget, overhead, citation):
    """One question's blocks (rank, chunk_id, doc_id, parent_id, kind, content), written out."""
    b, used, ids = sorted(blocks), 0, []
    for x in b:
        if used + len(x[5]) + overhead <= budget:
            used, ids = used + len(x[5]) + overhead, [*ids, x[1]]
    own = [x for x in b if x[1] in ids]
    holds = lambda p, c: p[4] == "section" != c[4] and p[1] == c[3] and p[2] == c[2] and c[5] and p[5].count(c[5]) == 1
    entries = [(p[1], len(p[5]), [(c[1], p[5].index(c[5]), len(c[5])) for c in own if holds(p, c)], any(holds(q, p) for q in own)) for p in own]
    kept = [e[:3] for e in entries if not e[3]]
    size = lambda es: sum(n + overhead + citation * len(held) for _, n, held in es)
    if size(kept) > budget:
        kept = [(i, n, []) for i, n, _, _ in entries]
    used = size(kept)
    for x in b if kept else []:
        if x[1] not in ids and x[5] and used + len(x[5]) + overhead <= budget:
            kept, used = [*kept, (x[1], len(x[5]), [])], used + len(x[5]) + overhead
    return [(i, n + 1, held) for n, (i, _, held) in enumerate(kept)]


def test_deduplication_computes_each_step_once(spark):
    """Steps of the fold that were put into the lambdas of the next ones made a plan of 139,000 characters."""
    rng = np.random.default_rng(2)
    rows = []
    for q in range(200):
        parts = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 6, 5)]
        for i in range(int(rng.integers(1, 8))):
            section = bool(rng.integers(0, 2))
            text = "".join(rng.choice(parts, 4)) if section else str(rng.choice(parts))
            rows.append((q, f"c{i}", int(rng.integers(0, 2)), None if section else f"c{rng.integers(0, 8)}", "section" if section else "leaf", i, text))
    b = spark.createDataFrame(rows, "qid int, chunk_id string, doc_id int, parent_id string, kind string, rank int, content string")
    cited = 0
    for budget, overhead, citation in ((40, 3, 1), (25, 2, 9), (400, 1, 0)):
        df = context.deduplicated(b, budget, overhead, citation)
        assert len(df._jdf.queryExecution().executedPlan().toString()) < 10_000
        got = {}
        for r in df.orderBy("qid", "position").collect():
            got.setdefault(r["qid"], []).append((r["chunk_id"], r["position"], [tuple(x) for x in r["contained"]]))
        want = {q: _deduplicated([(r[5], r[1], r[2], r[3], r[4], r[6]) for r in rows if r[0] == q], budget, overhead, citation) for q in range(200)}
        assert got == {q: w for q, w in want.items() if w}
        cited += sum(len(held) for w in want.values() for _, _, held in w)
    assert cited > 10


def test_filtered_search_by_products_equals_sql(spark, tmp_path, monkeypatch):
    """Copies, ids given twice, labels and ids that are null, few others, vectors without a score; no pair is a row before the best are taken."""
    monkeypatch.setattr(vector_blocks, "PACK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 8)).astype(np.float32).tolist()
    rows = [(i, base[i % 250], i % 3) for i in range(300)] + [(40, base[7], 1), (80, base[8], 1), (80, base[9], 1), (340, base[1], None), (None, base[2], 1)]
    rows += [(400 + i, None, 0) for i in range(0, 30, 5)] + [(500, [math.nan] * 8, 1), (501, [math.inf] + [1.0] * 7, 1), (520, [1.0, math.nan] + [0.0] * 6, 1)]
    rows += [(600 + i, base[i] if i < 3 else None, 7) for i in range(50)] + [(700, base[5], 8), (720, base[6], 8), (740, None, 9), (741, base[4], 9)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
    query, sql = registry.queries()["dense_topk_filtered"], registry.oracle_sql()["dense_topk_filtered"]
    df = query(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    d = duckdb.connect()
    d.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    plain = lambda x: (x[0], x[1], repr(x[2]), x[3])
    got, want = sorted(plain(r) for r in df.select("qid", "chunk_id", "score", "rank").collect()), sorted(plain(r) for r in d.execute(sql).fetchall())
    assert got == want and {"nan", "None"} <= {r[2] for r in got}


def test_halves_are_rounded_as_sql_does(spark, tmp_path):
    """0.5047875 times a million is below a half."""
    a, b = 0.5047875, math.sqrt(1 - 0.5047875**2)
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [a, b], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r["score"] for r in registry.queries()["dense_topk_filtered"](spark, str(tmp_path)).collect()] == [0.504787]
