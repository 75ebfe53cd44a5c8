import random

from docquarry.operators import graph


def brute(edges, pairs, hops, hub):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for q, a, b in pairs:
        ways, found = [(a,)], set()
        for _ in range(hops + 1):
            found = {w for w in ways if w[-1] == b}
            if found:
                break
            ways = [(*w, x) for w in ways for x in near.get(w[-1], ()) if x not in w and (len(w) == 1 or len(near[w[-1]]) <= hub)]
        out |= {(q, w) for w in found}
    return out


def test_shortest_paths_without_hubs(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(38)] + [("hub", f"n{i}") for i in range(20)]
    pairs = [(i, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for i in range(40)] + [(100, "hub", "n3"), (101, "n1", "hub"), (102, "nowhere", "n1"), (103, "n2", "n2")]
    e = spark.createDataFrame(edges, "src string, dst string")
    p = spark.createDataFrame([*pairs, (200, None, "n1")], "query long, a string, b string")
    got = {(r["query"], tuple(r["path"])) for r in graph.paths_between(e, p, 4, 10).collect()}
    assert got == brute(edges, pairs, 4, 10)
    assert any(len(w) == 5 for _, w in got) and not any("hub" in w[1:-1] for _, w in got)
    assert graph.paths_between(e, p.limit(0)).count() == 0
