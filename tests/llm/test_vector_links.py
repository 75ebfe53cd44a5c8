import math

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import vector_links as vl

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    """{row: (n_links, component)} by comparing all pairs."""
    n = len(rows)
    good = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) and label is not None for _, e, label in rows]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [np.array(e) / np.abs(e).max() if g else None for g, (_, e, _) in zip(good, rows, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                x, y = unit[i], unit[j]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=str)


def found(df, **kw):
    return sorted(((r["id"], r["n_links"], r["component"]) for r in vl.linked(df, **kw).collect()), key=str)


def planted(seed, n, dim, labels, spread):
    """Vectors about centres, many of their pairs near the threshold, with copies and multiples."""
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        centre, label = rng.standard_normal(dim), int(rng.integers(labels))
        for _ in range(int(rng.integers(1, 12))):
            x = centre + rng.standard_normal(dim) * spread * rng.random()
            rows.append((len(rows), x.tolist(), label))
            if rng.random() < 0.2:
                rows += [(len(rows), x.tolist(), label), (len(rows) + 1, (x * 3).tolist(), label)]
    return rows


@pytest.mark.parametrize("dim, blocks, leaf, chunk", [(64, 8, 4096, 8192), (64, 8, 16, 8192), (20, 6, 10, 7), (3, 8, 12, 5), (64, 1, 30, 20)])
def test_against_all_pairs(spark, dim, blocks, leaf, chunk):
    rows = planted(dim + leaf, 400, dim, 2, 0.4)
    want = brute(rows)
    assert 100 < sum(r[1] for r in want)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, blocks=blocks, leaf=leaf, chunk=chunk) == want


def test_open_pairs_are_computed_exactly(spark):
    """Pairs whose cosine is the threshold within a byte's error, on both sides of it."""
    rng, rows = np.random.default_rng(3), []
    for k in range(150):
        u, v = rng.standard_normal((2, 16))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        c = 0.93 + (k - 75) * 1e-4
        rows += [(2 * k, u.tolist(), k), (2 * k + 1, (5 * (c * u + math.sqrt(1 - c * c) * v)).tolist(), k)]
    rows += [(400, rows[140][1], 70), (401, rows[141][1], 70)]  # copies of both sides of a pair
    want = brute(rows)
    assert 100 < sum(r[1] > 0 for r in want) < 250
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want


def test_one_group_with_most_rows(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * 0.05).tolist(), 1) for i in range(300)] + [(i, centre.tolist(), 1) for i in range(300, 500)]
    rows += [(i, rng.standard_normal(32).tolist(), 1) for i in range(500, 700)]
    assert found(spark.createDataFrame(rows, SCHEMA), leaf=40, chunk=50) == brute(rows)


def test_odd_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [
        (1, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1),
        (11, [*e, 0.0], 1), (12, [x * 1e300 for x in e], 1), (13, [x * 1e-300 for x in e], 1), (14, [-x for x in e], 1), (None, e, 1), (None, [9.0, -1.0, 0.0], 3), (None, [9.0, -1.0, 0.0], 3), (15, [0.0, 5.0], 4), (15, [0.0, 5.0], 4), (16, [-0.0, 5.0], 4),
        (None, None, None), (17, e, 1), (18, [7.0], 5), (19, [2.0], 5), (20, [-2.0], 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS key", "2 AS `a.b`")
    want = brute(rows)
    got = found(df)
    assert got == want
    assert (12, 5, 1) in got and (4, 0, 4) in got and (None, 1, None) in got
    assert vl.linked(df.limit(0)).count() == 0


def test_boxes_bring_every_near_pair_together_once():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    tree = vl.grown(x, 5)
    reach = rng.random(300)
    row, box, home = vl.boxes(tree, 5, x, reach)
    own = {r: b for r, b, h in zip(row, box, home, strict=True) if h}
    visits = {}
    for r, b, h in zip(row.tolist(), box.tolist(), home.tolist(), strict=True):
        if not h:
            assert b < own[r]
            visits.setdefault(r, set()).add(b)
    assert len(own) == 300 and len(set(own.values())) > 20
    for i in range(300):
        for j in range(300):
            if own[j] < own[i] and np.linalg.norm(x[i] - x[j]) <= reach[i]:
                assert own[j] in visits[i]


def test_sketch_errors_hold():
    x = np.random.default_rng(7).standard_normal((200, 24)) * 10.0 ** np.arange(-100, 100)[:, None]
    made, error = vl.sketch(x)
    got, stored = vl.unsketched(pa.array([r.tobytes() for r in made], pa.binary()), 24)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ vl.rotation(24)
    assert (stored == error).all() and (np.linalg.norm(unit - got, axis=1) <= error).all() and error.max() < 0.03
