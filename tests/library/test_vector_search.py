import numpy as np
import pyarrow as pa

from docquarry.operators import pq_index, retrieval, vector_blocks, vector_index

SCHEMA = "chunk_id long, vector array<double>"


def clustered(seed, n, clusters, dim=32, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return [(i, (centres[i % clusters] + rng.standard_normal(dim) * spread).tolist()) for i in range(n)]


def brute(questions, rows, k):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v is not None}
    out = []
    for q, v in questions:
        x = np.array(v) / (np.linalg.norm(v) or 1)
        hits = sorted((-round(float(x @ u), 9), i) for i, u in unit.items() if len(u) == len(x))[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(hits)]
    return out


def hits(df):
    return sorted((r["qid"], r["chunk_id"], round(r["score"], 7), r["rank"]) for r in df.collect())


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "PACK", 7)
    rows = clustered(1, 300, 20) + [(300 + i, clustered(1, 300, 20)[i][1]) for i in range(30)]  # ties
    rows += [(400, [0.0] * 32), (401, None), (402, [1.0]), (403, [])]
    c = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [r for r in rows if r[0] % 20 == 0]
    q = spark.createDataFrame(asked, "qid long, vector array<double>").repartition(2)
    want = [(a, b, round(s, 7), r) for a, b, s, r in brute(asked, rows, 5)]
    got = hits(retrieval.dense_route(q, c, 5))
    assert got == sorted(want)
    assert retrieval.dense_route(q.limit(0), c, 5).count() == 0


def test_index_finds_neighbours_in_a_fifth_of_the_rows(spark):
    rows = clustered(2, 6000, 80)
    c = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    asked = rows[::20]
    q = spark.createDataFrame(asked, "qid long, vector array<double>")
    model = pq_index.train(c)
    assert 60 <= len(model.fine) <= 100 and model.words.shape == (16, 256, 2)
    indexed = pq_index.index(c, model).cache()
    assert indexed.count() == 6000 and indexed.select("chunk_id").distinct().count() == 6000
    found = pq_index.search(q, indexed, c, model, 10)
    exact = retrieval.dense_route(q, c, 10)
    got = vector_index.recall(found, exact).first()
    assert got["questions"] == 300 and got["recall"] >= 0.9
    assert pq_index.read_share(q, indexed, model).first()["share"] <= 0.2
    best = {(r["qid"], r["chunk_id"]): round(r["score"], 7) for r in exact.collect()}
    assert all(best.get((r["qid"], r["chunk_id"]), round(r["score"], 7)) == round(r["score"], 7) for r in found.collect())
    assert found.where("rank = 1 AND qid = chunk_id").count() >= 0.98 * len(asked)


def test_pieces_and_groups_change_nothing(spark, monkeypatch):
    rows = clustered(3, 500, 2, 8)
    c = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q = spark.createDataFrame(rows[::10], "qid long, vector array<double>")
    model = pq_index.train(c)
    want = hits(pq_index.search(q, pq_index.index(c, model), c, model, 5, rescore=40))
    monkeypatch.setattr(pq_index, "PIECE", 9)
    monkeypatch.setattr(pq_index, "ASKED", 4)
    assert hits(pq_index.search(q, pq_index.index(c, model), c, model, 5, rescore=40)) == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, None), (4, []), (5, [1.0, None, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0])]
    c = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(9, [2.0, 0.0, 0.0]), (10, None)], "qid long, vector array<double>")
    model = pq_index.train(c)
    indexed = pq_index.index(c, model)
    assert sorted((r["chunk_id"] for r in indexed.collect()), key=str) == [1, 2, 2, 6, None]
    got = pq_index.search(q, indexed, c, model, 2).collect()
    assert [(r["qid"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])][0] == (9, 1)
    assert pq_index.train(c.limit(0)) is None and pq_index.train(c.where("vector IS NULL")) is None
    one = c.where("chunk_id = 1")
    assert hits(pq_index.search(q, pq_index.index(one, pq_index.train(one)), one, pq_index.train(one), 3)) == [(9, 1, 1.0, 1)]


def test_questions_look_into_lists_a_few_at_once(monkeypatch):
    """What leaves a task together doesn't grow with the batch and the number of lists."""
    monkeypatch.setattr(pq_index, "PROBED", 1000)
    rng = np.random.default_rng(24)
    x = vector_blocks.unit(rng.standard_normal((300, 8)))
    model = pq_index.Model(x[:2], x[:100], np.zeros(100, int), np.zeros((2, 4, 4)), 9.0, x[:50].astype(np.float32), 300)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["qid", "vector"])
    got = list(pq_index._looks(batch, model, 5))
    assert max(b.num_rows for b in got) <= 1000
    assert sorted((q, n) for b in got for q, n in zip(b["qid"].to_pylist(), b["list"].to_pylist(), strict=True)) == [(q, n) for q in range(300) for n in range(100)]


def test_centres_are_the_same_in_parts(monkeypatch):
    x = np.random.default_rng(25).integers(-9, 9, (500, 4)).astype(float)
    want = pq_index.lloyd(x, 12)
    monkeypatch.setattr(pq_index, "GO", 100)
    assert np.allclose(pq_index.lloyd(x, 12), want)
