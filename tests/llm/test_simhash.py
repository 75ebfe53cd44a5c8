import random

import xxhash
from pyspark.sql import functions as F

from docquarry.llm import simhash
from docquarry.llm.components import components


def brute(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=3):
    """Least id reachable of (id, fp), by comparing all pairs."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def test_fingerprint():
    for t in [None, "", "one", "one two", "A b C d e f g h", "é ü\tß\n中文 x", "w " * 300, "The THE the " * 5]:
        assert simhash.fingerprint((t or "").encode()) == brute(t)
    long = " ".join(str(i) for i in range(simhash.BLOCK + 50))
    assert simhash.fingerprint(long.encode()) == brute(long)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)


def planted(seed=1, centres=40, each=25):
    """Fingerprints in balls of three bits or so, chained and apart, with copies."""
    rng, out = random.Random(seed), []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, each)):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            out += [x] * rng.randrange(1, 3)
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def test_links_and_components_against_all_pairs(spark):
    fps = planted()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "id long, fp long")
    least = df.groupBy("fp").agg(F.min("id").alias("least"))
    want = groups([(i, x % (1 << 64)) for i, x in enumerate(fps)])
    for chunk, equal in ((simhash.CHUNK, 2), (3, 2), (simhash.CHUNK, 3)):  # 3: nearly every key is dealt out in pairs of chunks
        roots = {r["node"]: r["root"] for r in components(simhash.near_links(least, chunk=chunk, equal=equal)).collect()}
        of = {}
        for i, x in enumerate(fps):
            of.setdefault(roots.get(x, x), []).append(i)
        assert {i: min(m) for m in of.values() for i in m} == want


def test_pivots_discard_nothing_near():
    refs = [r % (1 << 64) for r in simhash.references()]
    rng = random.Random(3)
    for _ in range(300):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert max(abs((x ^ r).bit_count() - (y ^ r).bit_count()) for r in refs) <= 3


def test_blocks_cover_every_pair():
    rng = random.Random(4)
    for equal, many in ((2, 10), (3, 20)):
        masks = [m % (1 << 64) for m in simhash.block_masks(equal=equal)]
        assert len(masks) == many
        for _ in range(2000):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(d & m == 0 for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(500, 540))
    assert 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["id"] is None or r["component"] <= r["id"]
    by_id = {r["id"]: r for r in rows}
    assert {by_id[i]["component"] for i in (2, 3, 4)} == {2} and by_id[2]["fp"] == 0
    assert by_id[5]["component"] == 1 and by_id[None]["component"] is None
    assert simhash.near_groups(empty).count() == 0


def test_query_against_brute_force(spark):
    from docquarry.llm.queries import op10_simhash

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    fps = [(i, brute(t)) for i, t in texts.items()]
    want, fp = groups(fps), dict(fps)
    rows = op10_simhash(spark, d).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in texts}
