import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bpe, license_scan, mixture, quality_classifier, quality_rules, rollups, sharding
from docquarry.llm.common import n_words
from docquarry.llm.queries import rank_file

SPACE = " \t\n\x0b\x0c\r"
SMALL = "/root/testdata/sf0.001"


def split_words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(*rank_file())


@pytest.mark.parametrize("longest", [1, 2, 7, 50])
def test_pieces_match_as_the_whole_does(enc, longest):
    rng = random.Random(5)
    texts = ["", "  lead", "tail  ", "it's we'll 12 3a\n\n b", " a b\x1cc d ", "x" * 40]
    texts += ["".join(rng.choice("ab 1'\n.é  😀s") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert "".join(bpe.safe_pieces(t, longest)) == t
        assert bpe.encode_one(enc, t, longest).tolist() == enc.encode_ordinary(t)


def test_bpe_on_odd_rows(odd, empty, enc):
    rows = bpe.with_ids(odd, *rank_file()).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.with_ids(empty, *rank_file()).count() == 0
    clash = bpe.with_ids(odd.withColumns({"ids": F.lit(1), "DECODED": F.lit(2)}), *rank_file())
    assert clash.columns[-2:] == ["ids_", "decoded_"] and clash.where("ids = 1 AND decoded = 2").count() == odd.count()


def test_bpe_decodes_ids_that_are_no_text(spark, enc):
    lone = enc.encode_ordinary("😀")[:1]
    df = spark.createDataFrame([(lone,), ([],), (None,)], "ids array<int>")
    got = df.select(bpe.decoder(spark, *rank_file())(F.col("ids")).alias("d")).collect()
    assert bytes(got[0]["d"]) == enc.decode_bytes(lone) and bytes(got[1]["d"]) == b"" == bytes(got[2]["d"])


def test_bpe_query(spark, enc):
    from docquarry.llm.queries import op7_byte_bpe

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op7_byte_bpe(spark, SMALL).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- quality classifier -------------------------------------------------------------------------


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = ["", "a", "The same word. The same word.", "CAPS!! MORE!! CAPS!!", "é ü 1 22 *** $$$"] + [" ".join(rng.choice(["of", "The", "xx,", "12", "***"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    w = np.random.default_rng(0).normal(size=(1 << 10) + 1).astype(np.float32)
    whole = quality_classifier.score(np.frombuffer(b"".join(raw), np.uint8), at, w)
    for i, r in enumerate(raw):
        alone = quality_classifier.score(np.frombuffer(r, np.uint8), np.array([0, len(r)]), w)
        assert alone[0] == pytest.approx(whole[i], abs=1e-12)


def test_long_texts_are_read_in_blocks():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["of", "The", "xx,", "12", "***", "OF", "OF", "a" * 70, "!" * 55]) for _ in range(rng.randrange(400))) for _ in range(60)] + ["", " " * 300, "x"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    w = np.random.default_rng(0).normal(size=(1 << 10) + 1).astype(np.float32)
    for size in (90, 200, 1000):
        assert quality_classifier.score(data, at, w, size) == pytest.approx(quality_classifier.score(data, at, w), abs=1e-9)
        for (a, n), (b, m) in zip(quality_classifier._rows(data, at, 10, size), quality_classifier._rows(data, at, 10), strict=True):
            assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
    run = np.frombuffer(b"y" * 1000, np.uint8)  # a run longer than a block is several words
    assert sum(s * len(p) for s, p in quality_classifier._long_blocks(run, 10, 100)) == 10 + 9 + 8


def test_features_against_plain_words():
    text = b"the cat THE CAT cat cat. cat"
    data = np.frombuffer(text, np.uint8)
    who, place = quality_classifier.features(data, np.array([0, len(text)]), 18)
    words = ["the", "cat", "the", "cat", "cat", "cat", ".", "cat"]
    n = Counter(place.tolist())
    assert len(who) == len(words) + (len(words) - 1) + 2 + 4  # words, pairs, capitals, repeats of the last but one
    assert n[11] == 2 and n[7] == 2 and n[13] == 4
    assert Counter(Counter(words).values())[5] == 1 and 5 in n.values()


def test_held_out_accuracy(spark):
    from docquarry.llm.queries import op4_quality_classifier

    d = "/root/testdata/sf0.01"
    got = op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    assert len(got) > 40 and right >= 0.9
    assert sum(r["predicted"] for r in got if r["quality"] == 1) >= 0.98 * sum(r["quality"] for r in got)


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (9, 1), (None, 1), (99, 0), (10, None)], "doc_id long, quality int")
    got = quality_classifier.classify(odd, labels)
    assert {"score", "predicted", "SCORE"} & set(got.columns) == {"predicted", "SCORE"} and "score_" in got.columns
    assert got.count() == odd.count() and got.where("score_ >= 0 AND score_ <= 1").count() == odd.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    none = quality_classifier.classify(odd, labels.limit(0)).select("score_").distinct().collect()
    assert [r[0] for r in none] == [0.5]


def test_held_out_ids_never_train(spark):
    ids = list(range(200))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"id{i}") for i in ids], "doc_id long, text string")
    used = {int(r["text"][2:]) for r in quality_classifier.labelled_sample(docs, labels, allowed=~quality_classifier.held_out()).collect()}
    assert used == {i for i in ids if zlib.crc32(str(i).encode()) % 5}
    assert quality_classifier.labelled_sample(docs, labels, most=50).count() == 50


# --- quality rules ------------------------------------------------------------------------------


def plain_measures(text):
    words, text = split_words(text), text or ""
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_against_plain_ones(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "a b a b a b a", "x\n\nx\ny\nx ", "|*# <b> é z", "A\x0bB\x0cC\rD"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(["aa", "bb", "c1", "d!", "*"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += [" ".join(str(rng.randrange(900)) for _ in range(4000)) + " 1 2 3 1 2 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in quality_rules.measures(df).select("text", "_m.*").collect():
        assert tuple(r[m] for m in MEASURES) == plain_measures(r["text"]), r["text"]


def plain_em(votes):
    """Posterior of each vote tuple, by EM over whole texts, written out without the operator's code: a
    Beta prior of 100 texts, no bounds on what a vote may add."""
    votes = np.array(votes)
    k, bad, voted = votes.shape[1], votes < 0, votes != 0
    good, alarm, recall = 0.8, np.full(k, 0.05), np.full(k, 0.4)

    def post():
        yes = good * np.prod(np.where(voted, np.where(bad, alarm, 1 - alarm), 1.0), axis=1)
        no = (1 - good) * np.prod(np.where(voted, np.where(bad, recall, 1 - recall), 1.0), axis=1)
        return yes / (yes + no)

    for _ in range(quality_rules.ROUNDS):
        p = post()
        good = (p.sum() + 80) / (len(p) + 100)
        for j in range(k):
            at = voted[:, j]
            a_bad, a_all = p[bad[:, j]].sum() + 5, p[at].sum() + 100
            r_bad, r_all = (1 - p)[bad[:, j]].sum() + 40, (1 - p)[at].sum() + 100
            alarm[j], recall[j] = a_bad / a_all, r_bad / r_all
            if alarm[j] > recall[j]:
                alarm[j] = recall[j] = (a_bad + r_bad) / (a_all + r_all)
    return post()


def test_verdicts_against_plain_estimate(spark):
    """The query itself against measures, votes and EM taken plainly; and its verdicts against the labels."""
    from docquarry.llm.queries import op3_quality_rules

    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    votes = {r["doc_id"]: tuple(r["votes"]) for r in quality_rules.judged(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).select("doc_id", "verdict.votes").collect()}
    rows = op3_quality_rules(spark, d).collect()
    assert len(rows) == len(texts)
    post = dict(zip(votes, plain_em([votes[i] for i in votes]), strict=True))
    for r in rows:
        i, got = r["doc_id"], plain_measures(texts[r["doc_id"]])
        n, rep = got[0], got[4]
        failed = n < 50 or 100 * rep > 50 * n
        assert tuple(r[m] for m in MEASURES) == got
        assert r["base_failed"] == failed and r["posterior"] == pytest.approx(post[i], rel=1e-6, abs=1e-9)
        assert r["kept"] == (not failed and post[i] >= quality_rules.KEEP)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(r["kept"], label[r["doc_id"]]) for r in rows if r["doc_id"] in label and not r["base_failed"]]
    assert all(k for k, q in judged if q == 1) and not any(k for k, q in judged if q == 0)


def test_estimated_accuracies_decide():
    """Planted votes: rules with known false alarms and recall; the noisy one is outvoted when it alone calls
    a text bad, the accurate one is not."""
    rng = random.Random(4)
    rates = [(0.3, 0.6), (0.002, 0.9), (0.01, 0.4), (0.01, 0.4), (0.02, 0.5)]
    rows, truth = [], []
    for _ in range(20000):
        good = rng.random() < 0.8
        truth.append(good)
        rows.append(tuple(0 if rng.random() < 0.1 else -1 if rng.random() < (a if good else r) else 1 for a, r in rates))
    m = quality_rules.estimate(sorted(Counter(rows).items()), len(rates))
    for (a, r), got_a, got_r in zip(rates, m.alarm, m.recall, strict=True):
        assert got_a == pytest.approx(a, abs=0.02) and got_r == pytest.approx(r, abs=0.06)
    assert m.good == pytest.approx(0.8, abs=0.02)
    assert quality_rules.posterior(m, (-1, 1, 1, 1, 1)) > 0.9 > 0.5 > quality_rules.posterior(m, (1, -1, 1, 1, 1))
    kept = [quality_rules.posterior(m, v) >= quality_rules.KEEP for v in rows]
    strict = [-1 not in v for v in rows]
    right = lambda got: sum(a == b for a, b in zip(got, truth, strict=True)) / len(truth)
    assert right(kept) > 0.97 and right(kept) > right(strict) + 0.15
    noise = [tuple(-1 if rng.random() < 0.5 else 1 for _ in range(3)) for _ in range(500)]
    assert all(a <= r for a, r in zip(*(lambda x: (x.alarm, x.recall))(quality_rules.estimate(sorted(Counter(noise).items()), 3)), strict=True))


def test_clean_corpus_stays(spark):
    clean = spark.createDataFrame([(i, " ".join(f"w{i}x{j}." if j % 10 == 0 else f"some{j}" for j in range(80))) for i in range(200)], "doc_id int, text string")
    assert quality_rules.judged(clean).where("verdict.kept").count() == 200


def test_rules_on_odd_rows(odd, empty):
    got = quality_rules.judged(odd)
    assert got.columns == [*odd.columns, "verdict_"] and got.count() == odd.count()
    assert got.where("text IS NULL").select("verdict_.*").first()["n_words"] == 0
    assert quality_rules.judged(empty).count() == 0
    own = ["_m", "_v", "_w", "_h", "_x", "_l", "_p", "_s", "_again", "_pairs", "_row", "_text", "a.b"]
    clash = odd.withColumns({c: F.lit(c) for c in own})
    rows = quality_rules.judged(clash).collect()
    assert all(r[c] == c for r in rows for c in own)
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r["verdict_"])
    assert sorted(map(key, rows)) == sorted(map(key, got.collect()))


# --- mixture ------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_ = set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixture_query(spark):
    from docquarry.llm.queries import op2_source_mixture

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op2_source_mixture(spark, SMALL).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(split_words(docs[r["doc_id"]]["text"]))
        sizes[docs[r["doc_id"]]["source"]] += r["size"]
    want, taken, largest = plain_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_source_mixture(spark, SMALL).collect()))


def test_mixture_query_is_in_training_order(spark):
    """The query took its rows before the range sort, so they came in order of hash ranges."""
    from docquarry.llm.queries import op2_source_mixture

    df = op2_source_mixture(spark, SMALL)
    first = [r["first_position"] for r in df.collect()]
    taken = [p for p in first if p is not None]
    assert taken == sorted(taken) and first == taken + [None] * (len(first) - len(taken)) and len(set(taken)) > 50
    assert len(first) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_positions_follow_the_schedule(spark):
    """At each time, each source has given what the integral of its weight asks for, within a document."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 60), rng.randrange(1 << 32)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id int, source string, size int, order_key long")
    got = mixture.mixed(df).withColumn("position", F.explode("mix.positions")).select("source", "size", "mix.target", "position").collect()
    for k, s in enumerate(["a", "b", "c", None]):
        own = [r for r in got if r["source"] == s]
        start = mixture.STARTS[k % 3]
        for t in (0.1, 0.35, 0.5, 0.8, 1.0):
            asked = own[0]["target"] * (start * t + (1 - start) * t * t)
            assert abs(sum(r["size"] for r in own if r["position"] <= t) - asked) <= 61
    ordered = [r["position"] for r in mixture.in_training_order(mixture.mixed(df)).collect()]
    assert ordered == sorted(ordered)


def test_mixture_on_odd_rows(odd, empty):
    sized = lambda d: d.withColumn("size", n_words(F.col("text"))).withColumn("order_key", mixture.order_key("doc_id", F.coalesce("text", F.lit(""))))
    got = mixture.mixed(sized(odd))
    assert got.count() == odd.count() and got.where("mix.taken > 2 * size").count() == 0
    assert mixture.mixed(sized(empty)).count() == 0
    own = ["mix", "_name", "_none", "_bucket", "_row", "_id", "_n", "_key", "_size", "position"]
    clash = mixture.mixed(sized(odd).withColumns({c: F.lit(c) for c in own}))
    assert clash.columns[-1] == "mix_" and all(r[c] == c for r in clash.collect() for c in own)
    ordered = mixture.in_training_order(clash, "mix_")
    assert ordered.columns[-1] == "position_" and ordered.count() == got.selectExpr("sum(mix.copies)").first()[0]


# --- token rollups ------------------------------------------------------------------------------


def changes(spark, rows):
    return spark.createDataFrame(rows, "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")


def test_rollups_count_each_batch_once(spark, tmp_path):
    store = rollups.Store(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    one = changes(spark, [("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 7, None), ("insert", None, None, "t1", None, None)])
    two = changes(spark, [("delete", "a", "en", "t1", 7, None), ("revise", "a", "en", "t1", 9, 5), ("insert", "a", "en", "t2", 4, None)])
    assert store.apply("one", one) and store.apply("two", two)
    assert not store.apply("one", one) and not store.apply("two", two)
    want = {("a", "en", "t1", 1, 9), ("a", "en", "t2", 1, 4), (None, None, "t1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    (tmp_path / "store" / "attempt-of-three").mkdir()  # a batch that failed half way counts nothing
    (tmp_path / "store" / "attempt-of-three" / "part-0.parquet").write_bytes(b"junk")
    assert {tuple(r) for r in store.totals().collect()} == want and store.batches() == ["one", "two"]
    assert store.apply("three", changes(spark, [("delete", "a", "en", "t2", 4, None)]))
    assert {tuple(r) for r in store.totals().collect()} == {w for w in want if w[2] == "t1"}
    assert store.apply("none", one.limit(0))
    odd_id = "2024/01/01 ü=%"
    assert store.apply(odd_id, two) and not store.apply(odd_id, one) and odd_id in store.batches()
    before = sorted(map(tuple, store.totals().collect()), key=str)
    assert not store._commit(rollups.added(rollups.signed(one)), store._folder("one"))  # a second writer of one id
    store.compact()
    store.compact()
    assert sorted(map(tuple, store.totals().collect()), key=str) == before
    assert store.apply("four", one) and not store.apply("one", one)
    assert store.totals().where("source = 'a' AND tokenizer = 't1'").first()["n_docs"] == dict((r[:3], r[3]) for r in before).get(("a", "en", "t1"), 0) + 2
    store.compact()
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("attempt-") and p.name != "attempt-of-three"]
    with pytest.raises(Exception, match="unknown change"):
        store.apply("bad", changes(spark, [("oops", "a", "en", "t1", 1, None)]))


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path):
    path = str(tmp_path / "racing")

    class Racing(rollups.Store):
        late = False

        def batches(self):
            own = super().batches()
            if not Racing.late:
                Racing.late = True
                rollups.Store(spark, path).apply("late", changes(spark, [("insert", "a", "en", "t", 5, None)]))
            return own

    store = Racing(spark, path)
    rollups.Store(spark, path).apply("early", changes(spark, [("insert", "a", "en", "t", 10, None)]))
    store.compact()
    assert Racing.late
    for _ in range(2):
        got = rollups.Store(spark, path).totals().first()
        assert (got["n_docs"], got["n_tokens"]) == (2, 15)
        store.compact()


# --- sharding -----------------------------------------------------------------------------------


def test_place_is_greedy_by_dot_product():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 50, (60, 3)).astype(float)
    share = items / items.sum(axis=0) * 4
    got = sharding.place(share, 4)[0]
    left = np.ones((4, 3)) + np.array(sharding.SLACK)
    for i in sorted(range(60), key=lambda i: (-share[i].max(), i)):
        fits = [s for s in range(4) if all(round(left[s][d] - share[i][d], 12) >= 0 for d in range(3))]
        fits = fits or [s for s in range(4) if round(left[s][0] - share[i][0], 12) >= 0]
        score = {s: round(sum(left[s][d] * share[i][d] for d in range(3)), 12) for s in fits} or {s: round(left[s][0], 12) for s in range(4)}
        assert got[i] == min(s for s in score if score[s] == max(score.values()))
        left[got[i]] -= share[i]


def shard_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), n_words(F.col("text")).alias("tokens"), sharding.group_key(F.col("text")).alias("group"))
    return sharding.sharded(base).collect()


def test_sharding_query_against_plain_packing(spark):
    """Every group where the dot product is highest, large ones first, written out for one lot."""
    from docquarry.llm.queries import op8_vector_sharding

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    groups = defaultdict(lambda: np.zeros(3))
    for r in docs:
        t = r["text"] or ""
        groups[hashlib.md5(t.encode()).digest()] += (len(t.encode()) + 1, len(split_words(t)), 1)
    total = sum(groups.values())
    share = {g: x / total * 8 for g, x in groups.items()}
    large = sorted((g for g in groups if (groups[g] / total).max() > 1 / sharding.PARTS))
    small = sorted(set(groups) - set(large))
    where, left = {}, np.ones((8, 3)) + np.array(sharding.SLACK)
    for lot in (large, small):
        if lot is small:
            room = left - np.array(sharding.SLACK)
            own = sum(share[g] for g in small) if small else np.zeros(3)
            left = np.maximum(room, 0) / np.maximum(room, 0).sum(axis=0) * own + np.array(sharding.SLACK) * own / 8
        for g in sorted(lot, key=lambda g: -share[g].max()):
            fits = [s for s in range(8) if (np.round(left[s] - share[g], 12) >= 0).all()] or [s for s in range(8) if round(left[s][0] - share[g][0], 12) >= 0]
            score = {s: round(float(left[s] @ share[g]), 12) for s in fits} or {s: round(left[s][0], 12) for s in range(8)}
            where[g] = min(s for s in score if score[s] == max(score.values()))
            left[where[g]] -= share[g]
    got = {r["doc_id"]: r for r in op8_vector_sharding(spark, SMALL).collect()}
    slots = defaultdict(list)
    assert len(got) == len(docs)
    for r in docs:
        t, x = (r["text"] or "").encode(), got[r["doc_id"]]
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        assert x["shard"] == where[hashlib.md5(t).digest()]
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_lots_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LOT", 500)
    rng = random.Random(3)
    got = shard_rows(spark, [(i, " ".join(["w"] * rng.randrange(1, 80)) + str(i)) for i in range(6000)])
    load = Counter()
    for r in got:
        load[r["shard"]] += r["bytes"]
    assert len(got) == 6000 and len(load) == 8 and max(load.values()) <= 1.02 * min(load.values())


def test_groups_stay_together_and_sizes_are_near(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 80)) + str(i)) for i in range(4000)] + [(5000 + i, "copy of one text") for i in range(300)]
    got = shard_rows(spark, rows)
    load, groups, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["bytes"]
        groups[bytes(r["group"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in groups.values()) and set(load) == set(range(8))
    assert max(load.values()) <= 1.02 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_too_large_for_a_shard_is_split(spark):
    got = shard_rows(spark, [(i, "the same") for i in range(900)] + [(1000 + i, f"own {i}") for i in range(900)])
    load = Counter(r["shard"] for r in got)
    assert len(got) == 1800 and max(load.values()) <= 1.2 * min(load.values())


def test_sharding_on_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = shard_rows(spark, rows)
    assert len(got) == len(rows) and shard_rows(spark, []) == []
    own = ["shard", "slot", "rows", "_row", "_group", "_to", "_range", "_d0"]
    clash = spark.createDataFrame([(1, 2, 3, "g", *own)], "doc_id long, bytes long, tokens long, `group` string, " + ", ".join(f"{c} string" for c in own))
    assert sharding.sharded(clash).select(*own).first() == tuple(own) and sharding.sharded(clash).columns[-2:] == ["shard_", "slot_"]
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_classifier.labelled_sample(docs, labels, most=10).count() == 10


# --- licence scan -------------------------------------------------------------------------------


def plain_judge(words):
    """Family, probability, overlap and confirmation of the words of a paragraph, plainly; None if unknown."""
    w, bias = license_scan.model()
    vocab, own = license_scan.vocabulary(), license_scan.telling()
    hits = [(i, n) for n in (1, 2, 3) for i in range(len(words) - n + 1) if set(words[i : i + n]) & own and (n > 1 or len(words[i]) >= 4)]
    hits = [(i, n, vocab[license_scan._hash(words[i : i + n])]) for i, n in hits if license_scan._hash(words[i : i + n]) in vocab]
    if not hits:
        return None
    p = license_scan._softmax([b + sum(row[h] for _, _, h in hits) for row, b in zip(w, bias, strict=True)])
    k = p.index(max(p))
    if k == len(license_scan.FAMILIES) or p[k] < license_scan.MIN_PROBABILITY:
        return None
    family = license_scan.FAMILIES[k]
    span = set(words[min(i for i, _, _ in hits) : max(i + n for i, n, _ in hits)])
    names = {f: [license_scan._tokens(x) for x in license_scan.NAMES[f]] for f in license_scan.FAMILIES}
    at = lambda name, words: [i for i in range(len(words) - len(name) + 1) if words[i : i + len(name)] == name]
    mine = {(i, len(x)) for x in names[family] for i in at(x, words)}
    denied = any(words[j : j + len(d.split())] == d.split() and 0 <= i - j - len(d.split()) <= 4 for i, _ in mine for d in license_scan.NEGATIONS for j in range(len(words)))
    named = bool(mine) and not denied
    share, alike = 0.0, False
    for t in license_scan.NOTICES.get(family, ()):
        t = set(license_scan._tokens(t))
        share = max(share, len(t & span) / len(t))
        alike |= len(t & span) / len(t) >= license_scan.CONFIRM and len([x for x in span - t if not x.isdigit()]) / len(t) <= license_scan.EXTRA
    cut = [None if any(i <= j < i + n for i, n in mine) else x for j, x in enumerate(words)]
    other = any(at(x, cut) for f, xs in names.items() if f != family for x in xs)
    return family, round(p[k], 9), round(1.0 if named else share, 9), named or (alike and not other)


def plain_scan(text):
    out = []
    for i, line in enumerate((text or "").split("\n"), 1):
        got = plain_judge(license_scan._tokens(line)) if any(s in line.lower() for s in license_scan.STEMS) else None
        if got:
            out.append((i, *got))
    return out


STATEMENTS = [" ".join(w) for f in license_scan.FAMILIES for w in license_scan._framed(license_scan.NAMES[f])] + [t for ts in license_scan.NOTICES.values() for t in ts]


def test_licences_against_a_plain_scan(spark, odd, empty):
    rng = random.Random(11)
    every = [w for t in STATEMENTS for w in t.split()]
    lines = [*rng.sample(STATEMENTS, 120), *license_scan.ORDINARY, "", "Licensed under", "ALL RIGHTS RESERVED!!", "rights reserved all", "Ünder thé MIT"]
    lines += [" ".join(rng.choice(every) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    lines += [f"{rng.choice(license_scan.NEGATIONS)} {' '.join(['so'] * rng.randrange(7))} {t}" for t in rng.sample(STATEMENTS, 40)]
    texts = ["\n".join(rng.sample(lines, 6)) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in license_scan.scanned(df).collect():
        assert [(x["line"], x["family"], round(x["probability"], 9), round(x["overlap"], 9), x["confirmed"]) for x in r["licences"]] == plain_scan(r["text"])
    got = license_scan.scanned(odd)
    assert got.count() == odd.count() and "licences_" in got.columns and got.where("size(licences_) > 0").count() == 0
    assert license_scan.scanned(empty).count() == 0
    clash = spark.createDataFrame([("Released under the MIT License",)], "text string").withColumns({c: F.lit(c) for c in ("_paragraphs", "_windows", "_lines")})
    assert tuple(license_scan.scanned(clash).select("_paragraphs", "_windows", "_lines").first()) == ("_paragraphs", "_windows", "_lines")


def test_licence_query_against_a_plain_scan(spark):
    from docquarry.llm.queries import op9_license_scan

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op9_license_scan(spark, SMALL).collect()}
    assert set(got) == set(texts) and any(r["n_confirmed"] for r in got.values())
    for i, t in texts.items():
        found = plain_scan(t)
        sure = [x for x in found if x[4]]
        assert (got[i]["n_paragraphs"], got[i]["n_confirmed"], got[i]["families"]) == (len(found), len(sure), ",".join(sorted({x[1] for x in sure})))


def test_every_statement_is_found_and_ordinary_text_is_not():
    for family in license_scan.FAMILIES:
        for t in [" ".join(w) for w in license_scan._framed(license_scan.NAMES[family])] + list(license_scan.NOTICES.get(family, ())):
            assert plain_judge(license_scan._tokens(t))[::3] == (family, True), t
    assert not any(plain_scan(t) for t in license_scan.ORDINARY)


def test_held_out_statements():
    """Frames and licences that neither training nor calibration has had."""
    frames = ("The code here is available under {}", "You may use these data under the {} terms", "Distributed under {}; see COPYING", "Text and images: {}, unless said otherwise")
    cases = [(f, frame.format(n)) for f in license_scan.FAMILIES for n in license_scan.NAMES[f] for frame in frames]
    right = sum((plain_judge(license_scan._tokens(t)) or (None,) * 4)[::3] == (f, True) for f, t in cases)
    assert right >= 0.98 * len(cases)
    unseen = ("PostgreSQL License", "PHP License 3.01", "Educational Community License", "Open Data Commons Attribution License", "W3C Software Notice and License", "Ruby License", "Unicode License v3", "Vim License", "Nethack General Public License", "Creative Commons Developing Nations License")
    for t in unseen:
        for frame in (*frames, *license_scan.FRAMES[:5]):
            got = plain_judge(license_scan._tokens(frame.format(t)))
            assert not got or not got[3], (t, got)


@pytest.mark.parametrize(
    "text, family",
    [
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND"),
        ("Creative Commons Attribution-ShareAlike", "CC-BY-SA"),
        ("GNU Affero General Public License, version 3", "AGPL"),
        ("Released under the ISC License", "ISC"),
        ("Eclipse Public License, Version 2.0", "EPL"),
        ("BSD 2-Clause", "BSD"),
        ("All rights not reserved", None),
        ("Some rights reserved", None),
        ("This code is not released under the MIT License", None),
        ("It is neither under the MIT License nor the GPL v3", None),
    ],
)
def test_variants_are_right_or_unknown(text, family):
    got = plain_judge(license_scan._tokens(text))
    assert (got and got[3] and got[0]) == family or (family is None and (not got or not got[3]))


def test_licences_wrapped_over_lines(spark):
    gpl = ["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by", "# the Free Software Foundation, either version 3 of the License"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met"]
    cases = {
        "\n".join(["Words of the story here.", "", *bsd, "", "More of it."]): [("BSD", 3)],
        "\n".join([" * Redistribution and use in source and binary forms, with or without modification,", " * are permitted provided that the following", " * conditions are met"]): [("BSD", 1)],
        "Licensed under the Mozilla\nPublic License, Version 2.0": [("MPL-2.0", 1)],
        "Redistribution and use in source\n\nand binary forms, with or without modification": [],
        "Released under the MIT License\nand more words\nof the story": [],  # confirmed as a line
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in license_scan.scanned(df).collect():
        assert [(x["family"], x["line"]) for x in r["wrapped_licences"]] == cases[r["text"]], r["text"]
    r = license_scan.scanned(spark.createDataFrame([("\n".join([*bsd, "", *gpl]),)], "text string")).first()
    assert {x["family"] for x in [*r["licences"], *r["wrapped_licences"]] if x["confirmed"]} == {"BSD", "GPL"}


def test_unknown_is_calibrated_on_unseen_examples():
    w, bias = license_scan.model()
    seen = license_scan._examples(77, license_scan.OTHER_FRAMES, license_scan.OTHER_UNSEEN)
    probs = []
    for features, y in seen:
        p = license_scan._softmax([b + sum(r[f] for f in features) for r, b in zip(w, bias, strict=True)])
        probs.append((max(p), p.index(max(p)) == y))
    assert sum(ok for _, ok in probs) / len(probs) > 0.95
    assert abs(sum(p for p, _ in probs) - sum(ok for _, ok in probs)) / len(probs) < 0.05
