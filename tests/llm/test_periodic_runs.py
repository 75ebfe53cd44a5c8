import random

import pytest
from pyspark.sql import functions as F

from docquarry.llm import periodic_runs as pr


def brute(ids):
    """Every stretch of every period, by definition."""
    n, out = len(ids), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i - a + q
            if length >= max(6, 4 * q):
                out.setdefault((a, length), q)  # q ascends, so the smallest period stays
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def words(ids):
    return [b"w%d" % x for x in ids]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


CASES = {
    "one word": [0] * 50,
    "pairs": [0, 1] * 30,
    "fibonacci": fibonacci(300),
    "cubes of fibonacci": fibonacci(21) * 5 + [2] + fibonacci(13) * 4,
    "thue-morse": [bin(i).count("1") % 2 for i in range(256)] * 5,
    "nested": ([0] * 7 + [1]) * 6 + [0] * 7,
    "overlapping": [0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1],
    "five only": [0] * 5,
    "six": [0] * 6,
    "at the end": list(range(9)) + [20, 21, 22] * 4,
    "short of four": [0, 1, 2] * 3 + [0, 1],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("modulus", [pr.MODULUS, 7, 1])  # small ones make wrong hashes common, 1 makes all of them equal
def test_named(name, modulus):
    ids = CASES[name]
    assert sorted(pr.runs_within(ids, modulus), key=lambda r: (r[0], r[2])) == brute(ids)
    assert pr.word_runs(words(ids)) == brute(ids)


def test_random():
    rng = random.Random(5)
    for k in range(1500):
        ids = [rng.randrange(rng.choice((1, 2, 2, 3, 6))) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):  # plant repeats
            a, q = rng.randrange(len(ids) + 1), rng.randrange(1, 8)
            ids[a:a] = [rng.randrange(4) for _ in range(q)] * rng.randrange(3, 7)
        want = brute(ids)
        assert pr.word_runs(words(ids)) == want, ids
        assert sorted(pr.runs_within(ids, 11 if k % 2 else pr.MODULUS), key=lambda r: (r[0], r[2])) == want, ids


def test_longest_lyndon_words():
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        for order in (ids, [-x for x in ids]):
            got = pr.lyndon_factors(ids, order, pr.Agreement(ids))
            for i, (end, _) in enumerate(got):
                lyndon = [j for j in range(i + 1, len(ids) + 1) if all(order[i:j] < order[k:j] for k in range(i + 1, j))]
                assert end == max(lyndon)


def test_collapsed():
    assert pr.collapsed([b"a", b"x", b"x", b"x", b"x", b"x", b"x", b"b"], [(1, 6, 1)]) == b"a x b"
    assert pr.collapsed([], []) == b""


def test_long_periodic_texts_take_linear_time():
    n = 200_000
    assert pr.word_runs([b"word"] * n) == [(0, n, 1)]
    block = words(range(20_000))
    assert pr.word_runs(block * 5) == [(0, 100_000, 20_000)]
    assert pr.word_runs(words(fibonacci(100_000))) == []  # no fourth powers


def test_rows(spark, odd, empty):
    docs = odd.withColumns({"runs": F.lit(1), "a.b": F.lit(2)})
    got = pr.with_runs(docs)
    assert got.columns == [*docs.columns, "runs_"]
    seen = {}
    for r in got.collect():
        w = (r["text"] or "").encode().split()
        assert [tuple(x) for x in r["runs_"]["runs"]] == brute(w) if len(w) < 1000 else True
        seen[r["doc_id"]] = (len(r["runs_"]["runs"]), r["runs_"]["collapsed"])
    assert seen[2] == seen[3] == seen[4] == (0, "") and seen[7] == (1, "word") and seen[9] == (0, "same row") and seen[None][0] == 0
    assert pr.with_runs(empty).count() == 0


def test_strongest(spark):
    df = spark.createDataFrame([([(9, 12, 3), (3, 8, 2), (5, 8, 2), (30, 41, 10)],), ([],)], "r array<struct<start: long, length: long, period: long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(pr.strongest(F.col("r"))).collect()] == [(30, 41, 10), None]
