import json
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import pruned, retrieval, sessions
from docquarry.sources.versioned import VersionedTable
from docquarry.streaming import ingest, machines

SCHEMA = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.append(make((1, "a"), (2, "b"), (None, "n"))) == 1
    assert t.append(make((3, "c"))) == 2
    assert t.replace(make((2, "B"), (2, "BB"), (None, "N"), (9, "z")), ["id"]) == 3
    assert rows(t.read()) == sorted([(1, "a"), (3, "c"), (2, "B"), (2, "BB"), (None, "N"), (9, "z")], key=str)
    assert t.delete(make((3, ""), (77, "")).select("id"), ["id"]) == 4
    assert rows(t.read()) == sorted([(1, "a"), (2, "B"), (2, "BB"), (None, "N"), (9, "z")], key=str)
    assert rows(t.read(2)) == sorted([(1, "a"), (2, "b"), (None, "n"), (3, "c")], key=str)
    assert t.compact(1) == 5 and len(t.manifest()["files"]) == 1
    assert t.rebuild(make((5, "e"))) == 6 and rows(t.read()) == [(5, "e")] and rows(t.read(5)) == rows(t.read(4))
    with pytest.raises(ValueError, match="columns"):
        t.append(spark.createDataFrame([(1,)], "id long"))
    assert t.append(make().limit(0)) == 7 and rows(t.read()) == [(5, "e")]
    assert t.vacuum(1) > 0 and t.versions() == [7] and rows(t.read()) == [(5, "e")]
    with pytest.raises(ValueError, match="no version"):
        t.read(2)


def test_only_files_with_a_key_are_written_anew(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(4):
        t.append(spark.createDataFrame([(i, "x"), (i + 10, "y")], SCHEMA).coalesce(1))
    before = set(t.manifest()["files"])
    t.delete(spark.createDataFrame([(2,)], "id long"), ["id"])
    assert len(before & set(t.manifest()["files"])) == 3 and len(rows(t.read())) == 7


def test_a_writer_that_fails_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, "a")], SCHEMA))

    def broken(self, manifest):
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "_commit", broken)
    with pytest.raises(RuntimeError, match="lost"):
        t.rebuild(spark.createDataFrame([(2, "b")], SCHEMA))
    monkeypatch.undo()
    assert rows(VersionedTable(spark, t.path).read()) == [(1, "a")]
    assert t.vacuum() == 1 and rows(t.read()) == [(1, "a")]


def test_two_writers(spark, tmp_path):
    t, other, raced = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t")), []
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).coalesce(1))
    commit = t._commit

    def late(manifest):
        if not raced:
            raced.append(other.replace(spark.createDataFrame([(1, "other")], SCHEMA), ["id"]))
        return commit(manifest)

    t._commit = late
    assert t.replace(spark.createDataFrame([(2, "mine")], SCHEMA), ["id"]) == 3 and raced == [2]
    assert rows(t.read()) == [(1, "other"), (2, "mine")]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    assert [t.append(one, ("stream", 0)), t.append(one, ("stream", 0)), t.append(one, ("stream", 1)), t.append(one, ("else", 0))] == [1, 1, 2, 3]
    assert len(rows(t.read())) == 3


def test_a_stream_into_versions(spark, tmp_path):
    land, check = tmp_path / "in", str(tmp_path / "check")
    land.mkdir()
    t = VersionedTable(spark, str(tmp_path / "t"))
    run = lambda c=check: ingest.versioned_sink(ingest.arrivals(spark, str(land), SCHEMA, files_a_batch=1), t, c, "feed", ["id"]).awaitTermination(120)
    (land / "1.json").write_text("\n".join(json.dumps({"id": i, "v": "a"}) for i in (1, 2)))
    run()
    (land / "2.json").write_text(json.dumps({"id": 2, "v": "b"}))
    run()
    assert rows(t.read()) == [(1, "a"), (2, "b")] and rows(t.read(1)) == [(1, "a"), (2, "a")] and t.versions() == [1, 2]
    run(str(tmp_path / "lost"))  # its checkpoint is lost: the batches come again under their numbers
    assert t.versions() == [1, 2] and rows(t.read()) == [(1, "a"), (2, "b")]


# --- state ----------------------------------------------------------------------------------------


def stream(spark, folder, schema, batches, make, name):
    machines.prepare(spark)
    folder.mkdir()
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for i, b in enumerate(batches):
            (folder / f"{i}.json").write_text("\n".join(map(json.dumps, b)))
            q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_lifecycles_of_a_stream_and_of_a_table(spark, tmp_path):
    rng = random.Random(1)
    events, at = [], 0
    for i in range(120):
        at += rng.randrange(0, 3)
        events.append({"doc_id": rng.choice([1, 1, 1, 2, 3]), "ts": f"2024-01-01T{at // 60:02d}:{at % 60:02d}:00", "seq": i, "event": rng.choice(["submit", "error", "error", "error", "done", "other"])})
    schema = "doc_id long, ts timestamp, seq long, event string"
    batches = [events[i : i + 30] for i in range(0, 120, 30)]
    got = stream(spark, tmp_path / "in", schema, batches, lambda s: machines.lifecycles(s, "1 hour"), "lifecycles")
    table = machines.lifecycles_of(spark.read.schema(schema).json(str(tmp_path / "in")))
    key = lambda r: (r["doc_id"], r["seq"], r["event"], r["state"], r["errors"])
    assert sorted(map(key, got)) == sorted(map(key, table.collect()))
    state = {}
    for e in events:  # the machine written out
        s, n = state.get(e["doc_id"], (None, 0))
        if e["event"] == "submit":
            s, n = "pending", 0
        elif s == "pending" and e["event"] == "error":
            s, n = ("failed" if n == 2 else "pending"), n + 1
        elif s == "pending" and e["event"] == "done":
            s = "indexed"
        state[e["doc_id"]] = (s, n)
        if s:
            assert (e["doc_id"], e["seq"], e["event"], s, n) in set(map(key, got))


def test_silence_fails_a_document_and_late_events_stay_out(spark, tmp_path):
    e = lambda d, day, s, x: {"doc_id": d, "ts": f"2024-01-{day:02d}T00:00:00", "seq": s, "event": x}
    batches = [[e(1, 1, 1, "submit"), e(2, 1, 2, "submit"), e(2, 1, 3, "done")], [e(3, 9, 4, "submit")], [e(1, 2, 5, "done"), e(3, 9, 6, "other")], [e(3, 9, 7, "other")]]
    got = stream(spark, tmp_path / "in", "doc_id long, ts timestamp, seq long, event string", batches, lambda s: machines.lifecycles(s, "1 day", silence=86_400), "silent")
    assert [(r["event"], r["state"]) for r in got if r["doc_id"] == 1] == [("submit", "pending"), ("silence", "failed")]
    assert [r["state"] for r in got if r["doc_id"] == 2] == ["pending", "indexed"]


def test_cache_of_a_stream_and_of_a_table(spark, tmp_path):
    rng = random.Random(4)
    events, at = [], 0
    for i in range(150):
        at += rng.randrange(0, 4)
        events.append({"bucket": rng.choice([1, 1, 2]), "ts": f"2024-01-01T{at // 60:02d}:{at % 60:02d}:00", "seq": i, "event": rng.choice(["put", "get", "get"]), "key": rng.choice("abc"), "value": float(i)})
    schema = "bucket long, ts timestamp, seq long, event string, key string, value double"
    got = stream(spark, tmp_path / "in", schema, [events[i : i + 40] for i in range(0, 150, 40)], lambda s: machines.lookups(s, "1 hour", ttl=600), "lookups")
    key = lambda r: (r["bucket"], r["seq"], r["key"], r["hit"], r["value"])
    table = machines.lookups_of(spark.read.schema(schema).json(str(tmp_path / "in")), 600).collect()
    want = []
    for i, e in enumerate(events):
        if e["event"] == "get":
            puts = [p for p in events[:i] if p["event"] == "put" and (p["bucket"], p["key"]) == (e["bucket"], e["key"])]
            minutes = lambda x: int(x["ts"][11:13]) * 60 + int(x["ts"][14:16])
            hit = bool(puts) and minutes(e) - minutes(puts[-1]) < 10
            want.append((e["bucket"], e["seq"], e["key"], hit, puts[-1]["value"] if hit else None))
    assert sorted(map(key, table), key=str) == sorted(want, key=str) == sorted(map(key, got), key=str)
    assert 10 < sum(w[3] for w in want) < len(want)


def test_a_bucket_holds_so_many_entries(spark, tmp_path):
    e = lambda s, x, k: {"bucket": 1, "ts": f"2024-01-01T00:{s:02d}:00", "seq": s, "event": x, "key": k, "value": float(s)}
    batches = [[e(1, "put", "a"), e(2, "put", "b"), e(3, "put", "a"), e(4, "put", "c")], [e(5, "get", "a"), e(6, "get", "b"), e(7, "get", "c")]]
    got = stream(spark, tmp_path / "in", "bucket long, ts timestamp, seq long, event string, key string, value double", batches, lambda s: machines.lookups(s, "1 hour", most=2), "bounded")
    assert {r["key"]: r["value"] for r in got} == {"a": 3.0, "b": None, "c": 4.0}


# --- caches of answers, pruned postings -------------------------------------------------------------


def test_cached_answers(spark):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(60)]
    near = lambda v, s: [x + rng.gauss(0, s) for x in v]
    cache = [(i, f"what was the revenue in {i % 7}", base[i]) for i in range(60)] + [(60 + i, "quite other words", base[i]) for i in range(10)] + [(90, "what was the revenue in 0", base[0]), (91, None, base[1]), (92, "no vector", None)]
    asked = [(i, f"what was the revenue of {i % 7}", near(base[i], rng.choice([0.05, 0.2, 0.4]))) for i in range(60)] + [(100, "what was the revenue of 0", base[0]), (101, "what was the revenue of 0", base[0]), (102, "x", None)]
    q, c = spark.createDataFrame(asked, "qid long, q_norm string, q_vec array<double>"), spark.createDataFrame(cache, "entry_id long, q_norm string, q_vec array<double>").repartition(3)

    def dice(a, b):
        a, b = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a.lower().replace(" ", ""), b.lower().replace(" ", "")))
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0

    def cosine(u, v):
        return sum(x * y for x, y in zip(u, v, strict=True)) / (sum(x * x for x in u) * sum(y * y for y in v)) ** 0.5

    want = {}
    for qid, n, v in asked:
        hits = [(-round(cosine(v, w), 9), e) for e, m, w in cache if v and w and m is not None and cosine(v, w) >= 0.95 and dice(n, m) >= 0.5]
        if hits:
            want[qid] = min(hits)[1]
    got = {r["qid"]: r["entry_id"] for r in sessions.cached_answers(q, c).collect()}
    assert got == want and 20 < len(want) < 62
    assert sessions.cached_answers(q, c.limit(0)).count() == 0


def test_pruned_bm25_is_bm25(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 8)
    rng = random.Random(3)
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(d, f"t{t}", rng.randrange(1, 4)) for d in range(600) for t in set(rng.choices(range(200), weights, k=25))]
    asked = [(q, f"t{t}") for q in range(25) for t in {0, 1, 2, *rng.sample(range(50, 200), 3)}] + [(99, "nowhere"), (98, "t0")]
    d = spark.createDataFrame(docs, "doc_id long, term string, tf long").repartition(3)
    q = spark.createDataFrame(asked, "qid long, term string")
    want = retrieval.bm25_route(q, d, 5).collect()
    got, read = pruned.bm25(q, pruned.postings(d, block=8).cache(), 5)
    assert sorted(map(tuple, got.select("qid", "chunk_id", "score", "rank").collect())) == sorted((r["qid"], r["chunk_id"], r["score"], r["rank"]) for r in want)
    n = read.first()
    assert n["questions"] == 26 and n["read"] + n["looked_up"] < 0.6 * n["all"]
    assert pruned.bm25(q.limit(0), pruned.postings(d), 5)[0].count() == 0
