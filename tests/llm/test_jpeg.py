import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import jpeg, media


def padded(p: bytes) -> bytes:
    return p + b"\0" * (64 * max(1, -(-len(p) // 64)) - len(p))


def back(payloads):
    frames, planes, coefs = jpeg.coefficients(jpeg.encode(payloads))
    return frames, planes, coefs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([0, 0, 0, 0, 1, 2, 255]), max_size=400).map(bytes)), min_size=1, max_size=4))
def test_round_trip(payloads):
    frames, planes, coefs = back(payloads)
    assert jpeg.payloads(frames, planes, coefs) == [padded(p) for p in payloads]
    assert [f.n_bytes for f in frames] == [len(p) for p in payloads]


class Reader:
    """A decoder of entropy-coded data one bit at a time, by the format's rules."""

    def __init__(self, data):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n):
        out = int(self.bits[self.at : self.at + n] or "0", 2)
        self.at += n
        return out

    def symbol(self, table):
        code = ""
        while code not in table:
            code += self.bits[self.at]
            self.at += 1
        return table[code]

    def value(self, s):
        v = self.take(s)
        return v if not s or v >= 1 << (s - 1) else v - (1 << s) + 1


def codes(counts, symbols):
    out, code, i = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[f"{code:0{n}b}"] = symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def plain_decode(file: bytes):
    """Coefficients of each component, block by block: the brute-force version."""
    at, comps, tables, scans = 2, [], {}, []
    while file[at + 1] != 0xD9:
        marker, n = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4) for i in range(body[5])]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                m = sum(body[k + 1 : k + 17])
                tables[body[k]] = codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + m])
                k += 17 + m
        elif marker == 0xDA:
            end = at
            while not (file[end] == 0xFF and file[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            parts, cur, k = [], bytearray(), at
            while k < end:
                if file[k] == 0xFF and 0xD0 <= file[k + 1] <= 0xD7:
                    parts.append(bytes(cur))
                    cur, k = bytearray(), k + 2
                elif file[k] == 0xFF:
                    cur.append(0xFF)
                    k += 2
                else:
                    cur.append(file[k])
                    k += 1
            parts.append(bytes(cur))
            ids = [body[1 + 2 * i] for i in range(body[0])]
            scans.append((ids, *body[1 + 2 * body[0] : 4 + 2 * body[0]], parts))
            at = end
    mw, mh = w // 16, h // 16
    blocks = {cid: np.zeros((mh * s * mw * s, 64), int) for cid, s in comps}
    size = dict(comps)
    for ids, ss, se, a, parts in scans:
        ah, al = a >> 4, a & 15
        for seg, part in enumerate(parts):
            r = Reader(part)
            if ss == 0:
                my, mx = divmod(seg, mw)
                for cid in ids:
                    pred, s = 0, size[cid]
                    for dy in range(s):
                        for dx in range(s):
                            b = blocks[cid][(my * s + dy) * mw * s + mx * s + dx]
                            if ah:
                                b[0] |= r.take(1) << al
                            else:
                                pred += r.value(r.symbol(tables[0x00]))
                                b[0] = pred << al
                continue
            b, k = blocks[ids[0]][seg], ss
            if not ah:
                while k <= se:
                    rs = r.symbol(tables[0x10])
                    run, s = rs >> 4, rs & 15
                    if not s and run < 15:
                        break
                    k += run
                    if s:
                        b[k] = r.value(s) << al
                    k += 1
                continue
            while k <= se:
                rs = r.symbol(tables[0x10])
                run, s = rs >> 4, rs & 15
                new = (1 if r.take(1) else -1) if s else 0
                eob = not s and run < 15
                while k <= se:
                    if b[k]:
                        if r.take(1):
                            b[k] += (1 << al) * (1 if b[k] > 0 else -1)
                    elif eob:
                        pass
                    elif run == 0:
                        b[k] = new << al if new > 0 else -(-new << al)
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
    return [blocks[cid] for cid, _ in comps]


@pytest.mark.parametrize("payload", [b"", b"A text of some words, and more of them. " * 20, bytes(range(256)), b"\0" * 70 + b"\1" + b"\0" * 40 + b"\1\2\3" + b"z" * 500])
def test_scans_against_a_plain_decoder(payload):
    _, planes, coefs = back([payload, b"another file in the batch"])
    want = plain_decode(jpeg.encode([payload])[0])
    for p, w in zip(planes[0], want, strict=True):
        assert (coefs[:, p.start : p.start + p.across * p.down].T == w).all()


def test_rgb_against_the_formula():
    payload = bytes(range(1, 200)) * 2
    frames, planes, coefs = back([payload])
    got = jpeg.rgb(frames, planes, coefs)[0]
    zig = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
    assert jpeg.ZIGZAG.tolist() == zig
    full = []
    for p in planes[0]:
        plane = np.zeros((p.down * 8, p.across * 8))
        for i in range(p.across * p.down):
            f = np.zeros(64)
            f[zig] = coefs[:, p.start + i]
            f = f.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
                    plane[i // p.across * 8 + y, i % p.across * 8 + x] = min(255, max(0, s + 128))
        up = got.shape[0] // plane.shape[0]
        full.append(np.repeat(np.repeat(plane, up, 0), up, 1))
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    assert np.abs(np.clip(want, 0, 255) - got).max() < 1.01


def test_column(spark, odd):
    rows = odd.withColumn("media", media.stored(F.col("text"))).withColumn("image", media.image(F.col("media"))).select("text", "media", "image").collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert bytes(r["image"]["payload"]) == padded(raw) and r["image"]["n_bytes"] == len(raw)
        assert len(r["image"]["rgb"]) == r["image"]["height"] * r["image"]["width"] * 3
        assert by_text.setdefault(raw, bytes(r["media"])) == bytes(r["media"])
    assert odd.limit(0).select(media.image(media.stored(F.col("text")))).count() == 0
    assert spark.range(2).select(media.image(F.lit(None).cast("binary")).alias("i")).where("i IS NULL").count() == 2


def test_query(spark):
    from docquarry.llm.queries import op1_progressive_jpeg

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op1_progressive_jpeg(spark, d).collect():
        p = padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        f = jpeg.encode([texts[r["doc_id"]]])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(f), hashlib.sha256(f).hexdigest())
