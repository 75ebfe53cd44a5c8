"""The quality query against its method written out: tokens, hashes, FTRL updates and scores, one at a time."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import quality_classifier as qc
from docquarry.llm.queries import op4_quality_classifier

D = "/root/testdata/sf0.001"
U64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & U64
    x = (x ^ (x >> 29)) * 0x94D049BB133111EB & U64
    return x ^ (x >> 32)


def kind(b):
    if b in b" \t\n\x0b\x0c\r":
        return 0
    c = chr(b)
    return 1 if b >= 128 or c.isalpha() else 2 if c.isdigit() else 3


def places(text):
    """Counts of the places of a text's features."""
    words, run = [], bytearray()
    for b in text.encode():
        if run and kind(b) != kind(run[-1]):
            words.append(bytes(run))
            run = bytearray()
        run.append(b)
    words = [w for w in (*words, bytes(run)) if w and kind(w[0])]
    back, out, hashes = pow(0x9E3779B97F4A7C15, -1, 1 << 64), Counter(), []
    for w in words:
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        hashes.append(mix(sum((b + 1) * pow(back, j, 1 << 64) for j, b in enumerate(lower)) & U64))
    mask = (1 << qc.HASH_BITS) - 1
    for i, (w, h) in enumerate(zip(words, hashes, strict=True)):
        out[h & mask] += 1
        if i:
            out[11 if h == hashes[i - 1] else mix((hashes[i - 1] * 3 + h) & U64) & mask] += 1
        if len(w) > 1 and all(65 <= b <= 90 for b in w):
            out[7] += 1
        if i > 1 and h == hashes[i - 2] and kind(w[0]) == 1:
            out[13] += 1
    return out


def vector(text):
    counts = places(text)
    total = max(1, sum(counts.values()))
    return [(k, c * qc.SCALE / total) for k, c in counts.items()] + [("bias", 1.0)]


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def test_training_and_scores_written_out(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.read.parquet(f"{D}/labels.parquet").where("quality IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).collect()
    sample = sorted((r["h"], r["doc_id"], r["quality"]) for r in labels if r["doc_id"] in docs and not held(r["doc_id"]))
    assert 30 < len(sample) <= qc.TRAIN_ROWS
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= qc.L1:
            return 0.0
        return -(z[k] - math.copysign(qc.L1, z[k])) / ((qc.BETA + math.sqrt(n[k])) / qc.ALPHA + qc.L2)

    rows = [(vector(docs[i]), y) for _, i, y in sample]
    for _ in range(qc.EPOCHS):
        for x, y in rows:
            w = {k: weight(k) for k, _ in x}
            p = sigmoid(sum(w[k] * v for k, v in x))
            for k, v in x:
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / qc.ALPHA * w[k]
                n[k] += g * g
    got = {r["doc_id"]: r for r in op4_quality_classifier(spark, D).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        want = sigmoid(sum(weight(k) * v for k, v in vector(t)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-4) and got[i]["held_out"] == held(i), i
        if abs(want - qc.THRESHOLD) > 1e-4:
            assert got[i]["predicted"] == int(want >= qc.THRESHOLD)


def test_places_of_a_batch():
    texts = ["Plain words, of a text.", "GO GO go stop GO", "a b a b a", "", "x1y2 ééé 中文", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    text, place = qc.features(data, at)
    for i, t in enumerate(texts):
        assert Counter(place[text == i].tolist()) == places(t)
