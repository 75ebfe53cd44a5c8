"""Findings of the third round: plans and results on inputs that earlier forms failed on at size."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.operators import companies, context, evaluation, facts, phrases, positions, pruned, retrieval, sections, sessions, term_blocks, vector_blocks, vector_index
from docquarry.sources import shared


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_safe_context_moves_blocks_once(spark):
    """No join carries texts: joins of well compressed texts were broadcast, and that failed."""
    long = "a long text that is here; "
    rows = [(1, "a", 1, None, "leaf", 1, long), (1, "b", 1, None, "leaf", 2, long * 3), (1, "c", 1, None, "leaf", 3, "short"), (2, "x", 1, None, "leaf", 1, "alone")]
    b = spark.createDataFrame(rows, "qid int, chunk_id string, doc_id int, parent_id string, kind string, rank int, content string")
    got = context.source_safe(b, budget=160)
    assert "Join" not in _plan(got)
    assert _rows(got.select("qid", "position", "chunk_id")) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "x")]


def test_frequent_numbers_meet_as_sets(spark):
    """Questions and chunks with one number each: pairs of sets are joined, not pairs of rows."""
    c = spark.range(400).selectExpr("1 AS doc_id", "id AS chunk_id", "'投资7.5 亿元用于建设' AS content")
    q = spark.range(50).selectExpr("id AS qid", "'谁投了7.5 亿元？' AS question")
    got = phrases.number_hits(q, phrases.number_index(c))
    assert _rows(got.select("qid", "rank", "chunk_id")) == [(i, n + 1, n) for i in range(50) for n in range(5)]
    assert "_set" in _plan(got)


def test_number_hits_over_sets_with_several_numbers(spark):
    c = spark.createDataFrame([(1, 9, "1.5亿元"), (1, 3, "2.5亿元"), (1, 2, "1.5亿元"), (1, 5, "2.5亿元和1.5亿元"), (1, 4, "3.5亿元")], "doc_id int, chunk_id int, content string")
    q = spark.createDataFrame([(1, "1.5亿元或2.5亿元"), (2, "3.5亿元"), (3, "无")], "qid int, question string")
    assert _rows(phrases.number_hits(q, phrases.number_index(c), 3).select("qid", "rank", "chunk_id")) == [(1, 1, 5), (1, 2, 2), (1, 3, 3), (2, 1, 4)]


def test_three_words_are_found_by_their_edges(spark):
    """The frequent word between rare ends is no hot key: texts that only share it never meet the phrase."""
    texts = spark.createDataFrame([("abc the xyz",), ("zzabc the xyzzz",), ("abc  the xyz",), ("ab the xyz",), ("é the ü",), ("aé the üb c",)], "text string")
    asked = spark.createDataFrame([("abc the xyz",), ("é the ü",), ("bc the x",)], "phrase string")
    got = _rows(positions.containing(asked, texts, "phrase", "text").select("phrase", "text"))
    want = sorted((p, t) for (p,) in asked.collect() for (t,) in texts.collect() if p in t)
    assert got == want and len(want) == 6
    pairs = positions._edged(asked.selectExpr("xxhash64(phrase) AS _p", "split(phrase, ' ') AS _w"), texts, F.xxhash64("text").alias("_t"), F.col("text"))
    assert pairs.count() < 18


def test_equal_questions_are_answered_once(spark):
    q = spark.range(300).selectExpr("id AS qid", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'net profit of Beta Works in 1995?' ELSE 'net profit?' END AS question")
    c = spark.createDataFrame([("Beta Works",), ("Alpha Steel",)], "company string")
    got = companies.subject(q, c)
    assert {(r["qid"] % 3, r["company"]) for r in got.collect()} == {(0, None), (1, "Beta Works"), (2, None)} and got.count() == 300
    assert _plan(got).count("Join") == 1


def _vectors(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    own = [(i, rng.standard_normal(8).tolist(), None if i % 11 == 0 else i % 3) for i in range(n)]
    return own + [(n + i, own[7][1], i % 3) for i in range(40)]  # ties


def test_blocks_by_group_and_by_list_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "PACK", 9)
    rows = _vectors(spark, 150)
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label int").repartition(3)
    q = c.where("chunk_id % 20 = 7").select(F.col("chunk_id").alias("qid"), "vector")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    asked = [i for i in unit if i % 20 == 7]
    cos = lambda a, b: round(float(unit[a] @ unit[b]), 9)
    best = lambda a, of: [x for _, x in sorted((-cos(a, i), i) for i in of)[:2]]
    got = vector_blocks.nearest(q, c, 2, by="label")
    w = Window.partitionBy("qid", "label").orderBy(F.desc("score"), "chunk_id")
    kept = got.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    want = {(a, g, i) for a in asked for g in (None, 0, 1, 2) for i in best(a, [i for i, _, x in rows if x == g])}
    assert {(r["qid"], r["label"], r["chunk_id"]) for r in kept.collect()} == want
    # of a bucket at most k rows of a question and a group go on, however many blocks and ties it has
    assert got.count() <= len(asked) * 4 * 2 * vector_blocks.BUCKETS
    listed = lambda df: df.withColumn("list", F.coalesce("label", F.lit(9)))
    near = retrieval.top(vector_blocks.nearest(listed(q.join(c.select(F.col("chunk_id").alias("qid"), "label"), "qid")), listed(c), 2, lists=True), 2)
    label = {i: x for i, _, x in rows}
    assert {(r["qid"], r["chunk_id"]) for r in near.collect()} == {(a, i) for a in asked for i in best(a, [i for i in label if label[i] == label[a]])}


def test_no_task_has_all_questions_and_vectors(spark):
    """The only key of the join was the length of the vectors, so a merge had one task."""
    v = spark.createDataFrame(_vectors(spark, 50), "chunk_id long, vector array<double>, label int")
    pairs = vector_blocks.met(vector_blocks.packs(v.withColumnRenamed("chunk_id", "qid"), "qid", "q"), vector_blocks.packs(v.repartition(40), "chunk_id", "c"))
    assert "q_bucket" in _plan(pairs) and pairs.select("q_bucket").distinct().count() > 1


def test_lists_are_placed_by_products(spark):
    """Lists are found in one pass over packed rows, not centre by centre in an expression; odd vectors are in none."""
    rows = _vectors(spark, 60)
    c = spark.createDataFrame([*rows, (900, None, 1), (901, [1.0], 1), (902, [None] * 8, 2)], "chunk_id long, vector array<double>, label int")
    middle = vector_index.centres(c.where("chunk_id < 60"), 6)
    centre = {r["list"]: np.array(r["centre"]) for r in middle.collect()}
    placed = vector_index.with_lists(c, middle, 2)
    assert placed.columns == ["chunk_id", "vector", "label", "list"] and "MapInArrow" in _plan(placed)
    cos = lambda v, x: round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 9)
    want = sorted((i, n) for i, v, _ in rows for _, n in sorted((-cos(np.array(v), x), n) for n, x in centre.items())[:2])
    assert _rows(placed.select("chunk_id", "list")) == want


def test_relevance_by_class_needs_no_pairs(spark):
    hits = spark.createDataFrame([(1, 10, 1, True), (1, 11, 2, False), (2, 10, 1, False)], "qid int, chunk_id int, rank int, is_relevant boolean")
    size = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "qid int, relevant long")
    pairs = spark.createDataFrame([(1, 10), (1, 20), (1, 21), (2, 22), (3, 23), (3, 24)], "qid int, chunk_id int")
    assert _rows(evaluation.judged_metrics(hits, size, 2)) == _rows(evaluation.ir_metrics(hits.drop("is_relevant"), pairs, 2))


def test_first_level_keeps_only_what_it_returns(spark):
    rows = _vectors(spark, 120)
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label int").repartition(3)
    q = c.where("chunk_id % 20 IN (0, 7)").select(F.col("chunk_id").alias("qid"), "vector", F.col("label").alias("wanted"))
    s = retrieval.scored(q, c)
    own = F.col("label") == F.col("wanted")
    levels = [(0.5, True), (0.1, True), (0.2, False)]
    level = F.explode(F.array(*(F.when((own if o else F.lit(True)) & (F.col("score") > x), i) for i, (x, o) in enumerate(levels)))).alias("level")
    each = s.select("qid", "chunk_id", level, (F.col("score") > 0.55).alias("is_real"), F.lit(False).alias("is_relay")).where("level IS NOT NULL")
    want = _rows(retrieval.first_healthy(each, 30, 5).select("qid", "level", "chunk_id"))
    got = vector_blocks.first_level(q, c, levels, "label", "wanted", 30, 5, 0.55)
    assert _rows(got) == want and len({x[1] for x in want}) > 1


def _corpus(spark, seed=5, docs=1300, asked=300):
    rng = np.random.default_rng(seed)
    d = [(i, f"t{t}", int(rng.integers(1, 5))) for i in range(docs) for t in np.unique(rng.geometric(0.05, 12))]
    q = [(i, f"t{t}", int(rng.integers(1, 3))) for i in range(asked) for t in np.unique(rng.geometric(0.1, 5))]
    return d, q, spark.createDataFrame(d, "doc_id long, term string, tf long").repartition(5), spark.createDataFrame(q, "qid long, term string, tf long")


def _plain(d, q, k, part, asked_once=False):
    of = {}
    for i, t, n in d:
        of.setdefault(t, []).append((i, n))
    scores = {}
    for i, t, n in q:
        for doc, tf in of.get(t, ()):
            scores[i, doc] = scores.get((i, doc), 0.0) + part(t, 1 if asked_once else n, doc, tf)
    out = {}
    for (i, doc), s in scores.items():
        out.setdefault(i, []).append((-round(s, 9), doc))
    return sorted((i, doc, -s, n + 1) for i, hits in out.items() for n, (s, doc) in enumerate(sorted(hits)[:k]))


def test_routes_over_several_packs(spark):
    """Some packs of documents and of questions: the k best are those of all pairs, ties by id."""
    d, q, docs, asked = _corpus(spark)
    got = _rows(retrieval.sparse_route(asked, docs, 7).select("qid", "chunk_id", "score", "rank"))
    assert got == _plain(d, q, 7, lambda t, n, doc, tf: float(n * tf))
    lengths, df = {}, {}
    for i, t, n in d:
        lengths[i] = lengths.get(i, 0) + n
        df[t] = df.get(t, 0) + 1
    avg, many = sum(lengths.values()) / len(lengths), len(lengths)
    want = _plain(d, q, 7, lambda t, n, doc, tf: np.log(1 + (many - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / avg)), True)
    got = _rows(retrieval.bm25_route(asked, docs, 7).select("qid", "chunk_id", "score", "rank"))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-9)


def test_routes_keep_no_pair_as_a_row(spark):
    """Pairs of a question and a document were shuffled, most of what these queries moved."""
    _, _, docs, asked = _corpus(spark, docs=40, asked=10)
    for route in (retrieval.sparse_route(asked, docs, 3), retrieval.bm25_route(asked, docs, 3)):
        assert "Aggregate [qid" not in _plan(route)


def test_equal_documents_have_equal_scores(spark):
    """Terms are added in one order, whatever the order of rows: 1e16 + 1 - 1e16 is 0, 1e16 - 1e16 + 1 is 1."""
    rows = {"a": 1e16, "b": 1.0, "c": -1e16}
    docs = spark.createDataFrame([(i, t, rows[t]) for i, order in enumerate(("abc", "acb", "cab", "bac")) for t in order], "doc_id long, term string, tf double").coalesce(1)
    asked = spark.createDataFrame([(1, t, 1) for t in "cab"], "qid long, term string, tf long")
    assert len({r["score"] for r in retrieval.sparse_route(asked, docs, 4).collect()}) == 1


def test_scores_are_rounded_and_added_as_sql_has_them(spark):
    """Halves went to even digits (1548.3660537285 became ...728), and equal parts in another order gave another ninth decimal."""
    half = 1548.3660537285
    docs, asked = spark.createDataFrame([(1, "a", 1.0)], "doc_id long, term string, tf double"), spark.createDataFrame([(1, "a", half)], "qid long, term string, tf double")
    want = spark.sql(f"SELECT round({half}D, 9) AS r").first()["r"]
    assert want == 1548.366053729 and retrieval.sparse_route(asked, docs, 1).first()["score"] == want

    rng = np.random.default_rng(1)
    parts = rng.uniform(0, 9000, (400, 12))
    orders = [parts, parts[:, ::-1], *(rng.permuted(parts, axis=1) for _ in range(6))]
    rounded = lambda sums: len({tuple(np.round(s, 9)) for s in sums}) > 1
    assert rounded([np.bincount(np.repeat(np.arange(400), 12), weights=p.ravel()) for p in orders])
    assert len({tuple(term_blocks.added(np.repeat(np.arange(400), 12), p.ravel(), 400)) for p in orders}) == 1


def test_wide_packs_are_added_up_in_parts(spark, monkeypatch):
    _, _, docs, asked = _corpus(spark, docs=60, asked=20)
    weights = asked.select("qid", "term", F.col("tf").cast("double").alias("w"))
    pairs = term_blocks.packs(docs).crossJoin(term_blocks._questions(weights)).toArrow().to_batches()

    def sums():
        out = {}
        for batch in pairs:
            for i in range(batch.num_rows):
                arrays = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("q_starts", np.int64), ("q_of", np.int64), ("q_w", np.float64)))
                q = (batch["q_ids"][i].values, batch["q_vocab"][i].values, *arrays)
                for scores, ids in term_blocks._sums(q, batch, i, lambda w, tf, length, avg: w * tf, 0.0):
                    out |= {(a, b): s for a, row in zip(q[0].to_pylist(), scores.tolist(), strict=True) for b, s in zip(ids.to_pylist(), row, strict=True)}
        return out

    whole = sums()
    monkeypatch.setattr(term_blocks, "PAIRS", 7)
    assert len(whole) == 1200 and sums() == whole


def test_pruned_postings_leave_no_task(spark, monkeypatch):
    """Postings were shuffled by document, by term and by question, and those read were written: a row for each question and document."""
    rows = {}

    def counted(df, tag):
        out = shared.written(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(pruned, "written", counted)
    _, _, docs, asked = _corpus(spark)
    indexed = pruned.postings(docs).cache()
    tasks, questions, k = indexed.rdd.getNumPartitions(), asked.select("qid").distinct().count(), 2
    got, counts = pruned.bm25(asked, indexed, k)
    assert _rows(got.select("qid", "chunk_id", "score", "rank")) == _rows(retrieval.bm25_route(asked, docs, k).select("qid", "chunk_id", "score", "rank"))
    bound = max(tasks * (questions * k + 1), asked.count())
    assert counts.first()["all"] > 10 * bound and max(rows.values()) <= bound


def test_pruned_is_exact_for_any_block(spark):
    """Null ids, equal documents, blocks of one document, fewer documents than k."""
    _, _, docs, asked = _corpus(spark, docs=90, asked=30)
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    for block, k in ((1, 4), (7, 1), (64, 200)):
        want = _rows(retrieval.top(retrieval.bm25_route(asked, docs, k + 1).drop("rank"), k).select("qid", "chunk_id", "score", "rank"))
        assert _rows(pruned.bm25(asked, pruned.postings(docs, block=block), k)[0].select("qid", "chunk_id", "score", "rank")) == want
    assert _rows(pruned.bm25(asked, pruned.postings(docs.limit(0)), 3)[0]) == []


def test_words_are_packed_as_counted_terms(spark, tmp_path):
    """Rows of one id are one document, also across batches; null ids too; documents without words are none."""
    texts = {None: ["x y", "y"], 1: ["b a b", None, "a"], 2: [""], 3: ["c"] * 5000, 4: None, **{i: [f"w{i % 7} a b{i % 3}"] for i in range(5, 900)}}
    rows = spark.createDataFrame([(i, t) for i, own in texts.items() for t in (own or [None])], "doc_id long, text string").repartition(3)
    got = term_blocks.word_packs(rows, F.filter(F.split("text", " "), lambda w: w != ""))
    terms = rows.select("doc_id", F.explode(F.split("text", " ")).alias("term")).where("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))

    def plain(df):
        out = {}
        for r in df.collect():
            codes, tfs, at = np.frombuffer(r["codes"], np.int32), np.frombuffer(r["tfs"], np.float64), 0
            for i, length, size in zip(r["ids"], r["lens"], r["sizes"], strict=True):
                assert i not in out
                out[i] = length, [(r["vocab"][c], n) for c, n in zip(codes[at : at + size], tfs[at : at + size], strict=True)]
                at += size
        return out

    assert plain(got) == plain(term_blocks.packs(terms)) and plain(got)[1] == (4.0, [("a", 2.0), ("b", 2.0)]) and 2 not in plain(got)
    assert _rows(term_blocks.frequency(got)) == _rows(retrieval.document_frequency(terms))


def test_section_scores_move_texts_not_grams(spark):
    """Several packs of sections, Han characters, nulls (that share nothing, as in SQL), an empty question; no join carries arrays of grams."""
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcd12营收 ,"), n))
    asked = [(i, f"d{i % 2}", word(int(rng.integers(0, 9)))) for i in range(140)] + [(200, "d0", None), (201, "d1", ""), (202, None, "ab")]
    parts = [(f"d{i % 2}", i, 1, word(4), word(30)) for i in range(300)] + [("d0", 400, 1, None, "abc"), ("d1", 401, 1, "ab", None)]
    q = spark.createDataFrame(asked, "qid long, doc_id string, question string")
    s = spark.createDataFrame(parts, "doc_id string, section_id long, page int, path string, content string").coalesce(1)

    def grams(t):
        t = "".join(c for c in t or "" if c not in " ,")
        return {t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1)}

    want = [(i, k, 3 * sum(len(g) ** 2 for g in grams(x) & grams(p)) + sum(len(g) ** 2 for g in grams(x) & grams(c[:20] if c else c))) for i, d, x in asked for e, k, _, p, c in parts if d == e]
    got = sections.scored(q, s, 20)
    assert _rows(got.select("qid", "section_id", "score")) == sorted(want)
    assert "array_intersect" not in _plan(got)


def test_cached_answers_are_exact_for_any_bound(spark):
    """Questions meet entries by products: nothing depends on which sides of planes vectors lie, so far pairs are found too."""
    rng = np.random.default_rng(23)
    base = rng.standard_normal((40, 16))
    asked = 0.7 * base[:20] + 0.8 * rng.standard_normal((20, 16))
    norms = [f"what was the revenue in {i % 3}" if i % 4 else "quite other words" for i in range(40)]
    c = spark.createDataFrame([(i, norms[i], base[i].tolist()) for i in range(40)], "entry_id long, q_norm string, q_vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, "what was the revenue of 1", asked[i].tolist()) for i in range(20)], "qid long, q_norm string, q_vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    able = np.array([i % 4 > 0 for i in range(40)])
    scores = np.where(able, unit(asked) @ unit(base).T, -1)
    want = {i: int(np.argmax(scores[i])) for i in range(20) if scores[i].max() >= 0.4}
    got = sessions.cached_answers(q, c, similar=0.4).collect()
    assert {r["qid"]: r["entry_id"] for r in got} == want and len(want) > 8
    assert all(abs(r["similarity"] - scores[r["qid"], r["entry_id"]]) < 1e-9 for r in got)


def test_tables_are_dealt_out_and_cells_read_once(spark):
    """Files of tables are few, so reading them in the scan's tasks used few cores; patterns of a cell were matched several times."""
    cells = spark.createDataFrame([("(1,234.5)",), ("7万元",), ("12％",), ("不适用",), (None,), ("—",), ("about",)], "cell string")
    read = cells.select(finance.number(F.col("cell")).alias("n"), finance.year_of_cell(F.col("cell")), finance.matched_metric(F.col("cell")))
    assert read._jdf.queryExecution().analyzed().toString().count("百万元") == 1
    assert [(r["n"]["value"], r["n"]["unit"]) for r in read.collect()] == [(-1234.5, None), (7.0, "万元"), (12.0, "%"), (None, None), (None, None), (None, None), (None, None)]
    t = spark.createDataFrame([(1, 1, 1, ["项目", "2020年"], [["营业收入", "1,200"], ["其他", "1"]])], "doc_id int, page int, table_no int, headers array<string>, rows array<array<string>>")
    got = facts.from_tables(t)
    assert "RepartitionByExpression" in _plan(got)
    assert _rows(got.select("doc_id", "metric", "year", "value")) == [(1, "revenue", 2020, 1200.0)]
