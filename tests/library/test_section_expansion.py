import random

from docquarry.operators import sections


def brute(candidates, near, cover, chunks, limit, dense, children, preserve, cap):
    """One question, written out; cover(rows, limit) gives section ids."""
    near = sorted(near, key=lambda s: (s[2], s[1]))[: min(dense, limit)]
    selected = [(d, s) for d, s, _ in near]
    selected += cover({s for _, s in selected}, limit - len(selected))
    ids = {s for _, s in selected}
    head = candidates[:preserve]
    under = [c for d, s in selected for c in sorted((c for c in chunks if (c[0], c[2]) == (d, s)), key=lambda c: (c[3], c[1]))][:children]
    child = [c[1] for c in under if c[1] not in head and c[1] not in ids]
    tail = [c for c in candidates[preserve:] if c not in ids and c not in child]
    out = [(c, "head") for c in head] + [(c, "child") for c in child] + [(s, "coverage") for _, s in selected] + [(c, "tail") for c in tail]
    return out[:cap]


def test_expansion_against_one_question_at_a_time(spark):
    rng = random.Random(3)
    docs = {f"d{i}": [f"d{i}s{k}" for k in range(rng.randrange(1, 12))] for i in range(4)}
    chunks = [(d, f"{s}c{k}", s, k) for d, own in docs.items() for s in own for k in range(rng.randrange(4))]
    asked = {q: rng.sample(sorted(docs), rng.randrange(0, 4)) for q in range(8)}
    every = [c[1] for c in chunks] + [s for own in docs.values() for s in own] + [f"x{i}" for i in range(20)]
    candidates = {q: rng.sample(every, rng.randrange(25)) for q in asked}
    ranked = [(q, d, s, k, rng.randrange(0, 30)) for q, own in asked.items() for d in own for k, s in enumerate(docs[d])]
    near = {q: [(d, s, r) for r, (d, s) in enumerate(rng.sample([(d, s) for d in own for s in docs[d]], min(3, sum(len(docs[d]) for d in own))), 1)] for q, own in asked.items()}
    limit, dense, children, preserve, cap = 9, 2, 14, 6, 30
    r = spark.createDataFrame(ranked, "qid int, doc_id string, section_id string, page int, score int")

    def cover(q):
        def of(out, n):
            rest = r.where((r.qid == q) & ~r.section_id.isin(*out)) if out else r.where(r.qid == q)
            return [(x["doc_id"], x["section_id"]) for x in sections.covered(rest, n, 3, 0.8).orderBy("position").collect()] if n > 0 else []

        return of

    got = sections.expanded(
        spark.createDataFrame([(q, c, i) for q, own in candidates.items() for i, c in enumerate(own, 1)], "qid int, chunk_id string, rank int"),
        spark.createDataFrame([(q, *x) for q, own in near.items() for x in own], "qid int, doc_id string, section_id string, rank int"),
        r,
        spark.createDataFrame(chunks, "doc_id string, chunk_id string, parent_id string, seq int"),
        limit, dense, 3, 0.8, children, preserve, cap,
    )
    found = {}
    for x in got.orderBy("qid", "position").collect():
        found.setdefault(x["qid"], []).append((x["chunk_id"], x["kind"]))
    want = {q: brute(candidates[q], near[q], cover(q), chunks, limit, dense, children, preserve, cap) for q in asked}
    assert found == {q: w for q, w in want.items() if w}
    assert {k for w in want.values() for _, k in w} == {"head", "child", "coverage", "tail"}
