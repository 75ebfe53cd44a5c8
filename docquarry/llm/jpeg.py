"""Progressive JPEG as a media column: encoding of payload bytes, and decoding to RGB tensors.

Decoding accumulates spectral-selection and successive-approximation scans into arrays of coefficients,
applies the inverse transform in numpy, upsamples chroma and gives full-resolution RGB.  A JPEG's entropy
coded data can only be read in order, but not across restart markers: all restart segments of all files
of a batch are read in step, one Huffman symbol of each at a time, by numpy.  Files without restart
markers are read too, each scan of a file being one segment.

A payload is stored losslessly in the coefficients, the unit that JPEG itself keeps exactly: byte k of 64
is coefficient k, in zigzag order, of an 8 x 8 block, at quantisation 1.  Blocks fill the luma plane in
raster order, then the two chroma planes, which are subsampled 2 x 2; the rest are zero.  The number of
bytes before padding stands in a comment segment.

Null and empty payloads are 64 zero bytes.  Equal payloads give equal files.  Files of any length are
decoded whole; the memory needed grows with the largest file of a batch.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed by the format: the natural-order place of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)
#: Payload bytes (or file bytes) that are worked on together.
CHUNK = 1 << 20
_U = np.uint64
_SIZE = np.array([int(v).bit_length() for v in range(2048)], np.int64)


# --- Huffman tables -----------------------------------------------------------------------------


def _own_tables() -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """(counts of codes by length, symbols) for DC and AC: short codes for what text bytes need."""

    def table(short: dict[int, int], rest: list[int], length: int) -> tuple[bytes, bytes]:
        by_length = [[s for s, n in short.items() if n == k] for k in range(1, 17)]
        by_length[length - 1] = by_length[length - 1] + [s for s in rest if s not in short]
        return bytes(map(len, by_length)), bytes(s for x in by_length for s in x)

    dc = table({6: 2, 0: 3, 5: 3, 7: 3, 4: 4}, list(range(12)), 8)
    ac = table({0x06: 1, 0x05: 3, 0x07: 4, 0x00: 3, 0x16: 6}, [r << 4 | s for r in range(16) for s in range(11)], 12)
    return dc, ac


@lru_cache(64)
def decode_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) by the next 16 bits; length 0: no such code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            symbol[lo : lo + (1 << (16 - n))] = symbols[at]
            length[lo : lo + (1 << (16 - n))] = n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


@lru_cache(8)
def encode_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    codes, lengths = np.zeros(256, _U), np.zeros(256, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            codes[symbols[at]], lengths[symbols[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


DC_TABLE, AC_TABLE = _own_tables()


# --- Encoding -----------------------------------------------------------------------------------


def _pack(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of the bits of codes one after another; their total is a multiple of 8."""
    at = np.cumsum(length) - length
    total = int(at[-1] + length[-1]) // 8 if len(at) else 0
    word = at >> 5
    value = code << (64 - (at & 31) - length).astype(_U)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(total // 4 + 3, _U)
    if len(first):
        out[word[first]] += np.add.reduceat(value >> _U(32), first)
        out[word[first] + 1] += np.add.reduceat(value & _U(0xFFFFFFFF), first)
    return out.astype(">u4").view(np.uint8)[:total]


def _finish(raw: np.ndarray, begins: np.ndarray, files: np.ndarray, n_files: int) -> list[bytes]:
    """The entropy-coded data of each file: restart segments raw[begins[i]:begins[i + 1]] of file
    files[i], with stuffed zeros and restart markers."""
    stuffed = np.cumsum(raw == 0xFF)
    last = np.append(files[1:] != files[:-1], True)  # no marker after a file's last segment
    marks = np.cumsum(~last) * 2
    per_byte = np.repeat(marks - 2 * ~last, np.diff(begins))
    where = np.arange(len(raw)) + stuffed - (raw == 0xFF) + per_byte
    size = len(raw) + (int(stuffed[-1]) if len(raw) else 0) + (int(marks[-1]) if len(marks) else 0)
    out = np.zeros(size, np.uint8)
    out[where] = raw
    before = np.concatenate([[0], stuffed])[begins[1:]] + begins[1:]
    ends = before + marks  # after each segment and its marker
    number = np.arange(len(files)) - np.searchsorted(files, files)
    out[ends[~last] - 2] = 0xFF
    out[ends[~last] - 1] = 0xD0 + (number[~last] & 7)
    cut = np.concatenate([[0], ends[last]]).tolist()
    buffer = out.tobytes()
    assert len(cut) == n_files + 1
    return [buffer[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _segments(codes: np.ndarray, lengths: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of rows of codes, each row filled up with ones.  row rises; the last code of
    each row is a free place for the filling."""
    bits = np.bincount(row, weights=lengths, minlength=n).astype(np.int64)
    pad = -bits % 8
    last = np.searchsorted(row, np.arange(n), side="right") - 1
    lengths[last], codes[last] = pad, (_U(1) << pad.astype(_U)) - _U(1)
    return _pack(codes, lengths), np.concatenate([[0], np.cumsum((bits + pad) // 8)])


def _dc_first(mcus: np.ndarray, comps: tuple[int, ...], al: int) -> tuple[np.ndarray, np.ndarray]:
    """mcus: DC values, a row for each restart interval of one MCU; comps: component of each column."""
    v = mcus >> al
    diff = v.copy()
    last: dict[int, int] = {}
    for k, c in enumerate(comps):
        if c in last:
            diff[:, k] -= v[:, last[c]]
        last[c] = k
    size = _SIZE[np.abs(diff)]
    hc, hl = encode_table(*DC_TABLE)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(_U)
    n, m = diff.shape
    codes, lengths = np.zeros((n, m + 1), _U), np.zeros((n, m + 1), np.int64)
    codes[:, :m], lengths[:, :m] = hc[size] << size.astype(_U) | extra, hl[size] + size
    return _segments(codes.ravel(), lengths.ravel(), np.repeat(np.arange(n), m + 1), n)


def _bits_rows(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of single bits, filled up with ones."""
    n, m = bits.shape
    full = np.ones((n, -(-m // 8) * 8), np.uint8)
    full[:, :m] = bits
    return np.packbits(full, axis=1).ravel(), np.arange(n + 1) * (full.shape[1] // 8)


def _merged(where: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a where ``where`` holds, of b elsewhere, in order."""
    sizes = np.zeros(len(where), np.int64)
    sizes[where], sizes[~where] = np.diff(a[1]), np.diff(b[1])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(begins[-1]), np.uint8)
    mine = np.repeat(where, sizes)
    out[mine], out[~mine] = a[0], b[0]
    return out, begins


def _ac_first(coefs: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray]:
    """A restart segment for each row, a band of one block's coefficients (bytes, so never negative)."""
    n, m = coefs.shape
    v = coefs >> al
    full = (v != 0).all(axis=1)
    hc, hl = encode_table(*AC_TABLE)
    if full.all():  # no run of zeros and no end of block
        codes, lengths = np.zeros((n, m + 1), _U), np.zeros((n, m + 1), np.int64)
        size = _SIZE[v]
        codes[:, :m], lengths[:, :m] = hc[size] << size.astype(_U) | v.astype(_U), hl[size] + size
        return _segments(codes.ravel(), lengths.ravel(), np.repeat(np.arange(n), m + 1), n)
    if full.sum() > n // 4:
        return _merged(full, _ac_first(coefs[full], al), _ac_first(coefs[~full], al))
    row, col = np.nonzero(v)
    val = v[row, col].astype(np.int64)
    first = np.diff(row, prepend=-1) != 0
    run = col - np.where(first, -1, np.concatenate([[-1], col[:-1]])) - 1
    skips = run >> 4
    last = np.full(n, -1)
    last[row] = col  # the last assignment holds
    eob = last < m - 1
    per = 1 + skips
    places_by_row = np.bincount(row, weights=per, minlength=n).astype(np.int64) + eob + 1
    start = np.cumsum(places_by_row) - places_by_row
    at = np.cumsum(per) - 1 + np.concatenate([[0], np.cumsum(eob + 1)])[row]
    total = int(places_by_row.sum())
    codes, lengths = np.full(total, hc[0xF0]), np.full(total, hl[0xF0])  # what nothing else fills skips 16 zeros
    size = _SIZE[val]
    symbol = (run & 15) << 4 | size
    codes[at] = hc[symbol] << size.astype(_U) | val.astype(_U)
    lengths[at] = hl[symbol] + size
    ends = start + places_by_row - 1
    codes[ends[eob] - 1], lengths[ends[eob] - 1] = hc[0], hl[0]
    lengths[ends] = 0
    return _segments(codes, lengths, np.repeat(np.arange(n), places_by_row), n)


def _refine_plain(coefs: np.ndarray, al: int) -> list[tuple[int, int]]:
    """(code, length) of one block's AC refinement, by the format's own rules, for blocks of any kind."""
    hc, hl = encode_table(*AC_TABLE)
    mag = [int(c) >> al for c in coefs]
    news = [k for k, a in enumerate(mag) if a == 1]
    out: list[tuple[int, int]] = []
    run, waiting = 0, []
    end = news[-1] if news else -1
    for k, a in enumerate(mag):
        if a > 1:
            waiting.append((a & 1, 1))
            continue
        if a == 0 and k > end:
            continue
        if a == 0:
            run += 1
            if run == 16:
                out += [(int(hc[0xF0]), int(hl[0xF0])), *waiting]
                run, waiting = 0, []
            continue
        out += [(int(hc[run << 4 | 1]), int(hl[run << 4 | 1])), (1, 1), *waiting]
        run, waiting = 0, []
    if end < len(mag) - 1:
        out += [(int(hc[0]), int(hl[0])), *waiting]
    return out


def _ac_refine(coefs: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray]:
    """A restart segment for each row.  Rows without a coefficient that this scan makes nonzero (nearly
    all rows of text) are one end-of-block code and their correction bits."""
    n = len(coefs)
    mag = coefs >> al
    full = (mag > 1).all(axis=1)
    if full.all():
        (code,), (length,) = (x[[0]] for x in encode_table(*AC_TABLE))
        row = np.empty((n, int(length) + coefs.shape[1]), np.uint8)
        row[:, :length] = [(int(code) >> (int(length) - 1 - j)) & 1 for j in range(int(length))]
        row[:, length:] = mag & 1
        return _bits_rows(row)
    if full.sum() > n // 4:
        return _merged(full, _ac_refine(coefs[full], al), _ac_refine(coefs[~full], al))
    plain = np.flatnonzero((mag == 1).any(axis=1))
    old = mag > 1
    old[plain] = False
    hc, hl = encode_table(*AC_TABLE)
    eob = int(hl[0])
    many = old.sum(axis=1)
    slow = {int(r): _refine_plain(coefs[r], al) for r in plain}
    bits = eob + many
    for r, x in slow.items():
        bits[r] = sum(length for _, length in x)
    sizes = (bits + 7) // 8
    start = (np.cumsum(sizes) - sizes) * 8
    out = np.ones(int(sizes.sum()) * 8, np.uint8)
    for j in range(eob):
        out[start + j] = (int(hc[0]) >> (eob - 1 - j)) & 1
    row, col = np.nonzero(old)
    where = np.repeat(start + eob - (np.cumsum(many) - many), many) + np.arange(len(row))
    out[where] = mag[row, col] & 1
    for r, x in slow.items():
        own = [(code >> (length - 1 - j)) & 1 for code, length in x for j in range(length)]
        at = int(start[r])
        out[at : at + len(own)] = own
        out[at + len(own) : at + int(sizes[r]) * 8] = 1
    return np.packbits(out), np.concatenate([[0], np.cumsum(sizes)])


#: Spectral bands of the first AC scans; all AC coefficients are refined together.
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(n_bytes: int, mw: int, mh: int) -> bytes:
    tables = b"".join(bytes([kind]) + counts + symbols for kind, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    frame = struct.pack(">BHHB", 8, 16 * mh, 16 * mw, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % n_bytes) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", 1))


def _scan(comps: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([ss, se, ah << 4 | al]))


def layout(n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MCUs in width and height for payloads of so many blocks (six to an MCU)."""
    m = -(-n_blocks // 6)
    mw = np.ceil(np.sqrt(m)).astype(np.int64)
    return mw, -(-m // mw)


def _mcu_order(mw: np.ndarray, mh: np.ndarray, y_start: np.ndarray) -> np.ndarray:
    """For each MCU of all files, the four luma blocks (numbers of luma blocks of all files)."""
    m = mw * mh
    file = np.repeat(np.arange(len(m)), m)
    k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    my, mx, w = k // mw[file], k % mw[file], mw[file]
    top = y_start[file] + 2 * my * 2 * w + 2 * mx
    return np.stack([top, top + 1, top + 2 * w, top + 2 * w + 1], axis=1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload."""
    if not payloads:
        return []
    n_bytes = np.array([len(p) for p in payloads])
    blocks = np.maximum(1, -(-n_bytes // 64))
    mw, mh = layout(blocks)
    m = mw * mh
    whole = np.zeros(int(6 * m.sum()) * 64, np.uint8)
    base = np.cumsum(6 * m) - 6 * m
    for at, p in zip((base * 64).tolist(), payloads, strict=True):
        whole[at : at + len(p)] = np.frombuffer(p, np.uint8)
    coefs = whole.reshape(-1, 64)
    files = np.arange(len(m))
    numbers = lambda skip, count: np.repeat(base + skip - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    planes = [coefs[numbers(0, 4 * m)], coefs[numbers(4 * m, m)], coefs[numbers(5 * m, m)]]
    of = [np.repeat(files, 4 * m), np.repeat(files, m), np.repeat(files, m)]
    order = _mcu_order(mw, mh, np.cumsum(4 * m) - 4 * m)
    dc = np.concatenate([planes[0][order, 0], planes[1][:, :1], planes[2][:, :1]], axis=1).astype(np.int64)
    parts: list[tuple[bytes, list[bytes]]] = []

    def add(head: bytes, coded: tuple[np.ndarray, np.ndarray], file: np.ndarray) -> None:
        parts.append((head, _finish(*coded, file, len(m))))

    add(_scan((0, 1, 2), 0, 0, 0, 1), _dc_first(dc, (0, 0, 0, 0, 1, 2), 1), of[1])
    for c in range(3):
        for a, b in BANDS:
            add(_scan((c,), a, b, 0, 1), _ac_first(planes[c][:, a : b + 1], 1), of[c])
    add(_scan((0, 1, 2), 0, 0, 1, 0), _bits_rows((dc & 1).astype(np.uint8)), of[1])
    for c in range(3):
        add(_scan((c,), 1, 63, 1, 0), _ac_refine(planes[c][:, 1:], 0), of[c])
    return [_head(n, w, h) + b"".join(head + data[i] for head, data in parts) + b"\xff\xd9" for i, (n, w, h) in enumerate(zip(n_bytes.tolist(), mw.tolist(), mh.tolist(), strict=True))]


# --- Decoding -----------------------------------------------------------------------------------


@dataclass
class _File:
    height: int = 0
    width: int = 0
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    n_bytes: int | None = None


def _parse(buf: bytes, base: int, marks: list[int], at_mark: int) -> _File:
    """Segments of one file that begins at ``base`` of the batch.  marks: where markers stand."""
    f, dc, ac, restart, pos, end = _File(), {}, {}, 0, base + 2, 0
    if buf[base : base + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no SOI marker")
    while True:
        while buf[pos] == 0xFF and buf[pos + 1] == 0xFF:
            pos += 1
        marker = buf[pos + 1]
        if marker == 0xD9:
            return f
        n = buf[pos + 2] << 8 | buf[pos + 3]
        body = buf[pos + 4 : pos + 2 + n]
        pos += 2 + n
        if marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                many = sum(counts)
                (ac if body[k] >> 4 else dc)[body[k] & 15] = (counts, body[k + 17 : k + 17 + many])
                k += 17 + many
        elif marker == 0xDA:
            ids = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            by_id = {c[0]: i for i, c in enumerate(f.comps)}
            comps = tuple(by_id[i] for i, _ in ids)
            used = tuple((ac if ss else dc).get(t & 15 if ss else t >> 4) for _, t in ids)
            while marks[at_mark] < pos:
                at_mark += 1
            end = marks[at_mark]
            f.scans.append(((comps, ss, se, a >> 4, a & 15, used, restart), pos, end))
            pos = end
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                f.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                k += 65 + 64 * wide
        elif marker == 0xC2:
            f.height, f.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            f.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xFE and body.startswith(b"bytes="):
            f.n_bytes = int(body[6:])
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError(f"not a progressive JPEG: frame marker {marker:02x}")


@dataclass
class _Plane:
    """Blocks of one component of one file within the batch's coefficients."""

    start: int
    across: int  # blocks in a stored row, a multiple of the sampling factor
    down: int
    own_across: int  # blocks in a row of a scan of this component alone
    own_down: int


class _Bits:
    """Entropy-coded data without stuffing, read at many places at once."""

    def __init__(self, raw: np.ndarray):
        ff = raw == 0xFF
        after = np.concatenate([[False], ff[:-1]])
        marker = after & (raw >= 0xD0) & (raw <= 0xD7)
        drop = (after & (raw == 0)) | marker | np.concatenate([marker[1:], [False]])
        self.place = np.concatenate([[0], np.cumsum(~drop)])  # of a byte of raw
        data = np.concatenate([raw[~drop], np.zeros(16, np.uint8)])
        self.data = data
        self.windows = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
        self.restarts = np.flatnonzero(marker) + 1  # where segments begin after a marker

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, on top of 64."""
        return self.windows[at >> 3].astype(_U) << (at & 7).astype(_U)


def _dc_scan(bits: _Bits, at: np.ndarray, seg_mcus: np.ndarray, first: np.ndarray, order: list, tables: list, coefs: np.ndarray, ah: int, al: int) -> None:
    """order: for each block of an MCU its component's place in the scan and a function from MCU numbers
    (of the batch) to block numbers."""
    pred = np.zeros((len({c for c, _ in order}), len(at)), np.int64)
    active, step = np.arange(len(at)), 0
    at = at.copy()
    while True:
        active = active[seg_mcus[active] > step]
        if not len(active):
            return
        for comp, number in order:
            block = number(first[active] + step)
            w = bits.peek(at[active])
            if ah:
                coefs[0, block] |= (w >> _U(63)).astype(coefs.dtype) << al
                at[active] += 1
                continue
            symbol, length = tables[comp]
            code = (w >> _U(48)).astype(np.int64)
            s, n = symbol[code], length[code]
            v = ((w << n.astype(_U)) >> _U(1) >> (63 - s).astype(_U)).astype(np.int64)
            pred[comp, active] += np.where((v < (1 << s) >> 1), v - (1 << s) + 1, v)
            coefs[0, block] = pred[comp, active] << al
            at[active] += n + s
        step += 1


def _ac_first_scan(bits: _Bits, at: np.ndarray, count: np.ndarray, number, table: tuple, coefs: np.ndarray, ss: int, se: int, al: int) -> None:
    """number: from (segment, block of the segment) to block numbers."""
    symbol, length = table
    lane = np.arange(len(at))
    pos, k, done = at.copy(), np.full(len(at), ss), np.zeros(len(at), np.int64)
    left, block = count.copy(), number(lane, done)
    while len(lane):
        w = bits.peek(pos)
        code = (w >> _U(48)).astype(np.int64)
        rs, n = symbol[code], length[code]
        r, s = rs >> 4, rs & 15
        v = ((w << n.astype(_U)) >> _U(1) >> (63 - s).astype(_U)).astype(np.int64)
        k = k + r
        special = s == 0
        if special.any():
            some = ~special
            kk, ss_, vv = k[some], s[some], v[some]
            if len(kk) and kk.max() > 63:
                raise ValueError("damaged JPEG: a coefficient beyond the block")
            coefs[kk, block[some]] = np.where(vv < 1 << (ss_ - 1), vv - (1 << ss_) + 1, vv) << al
            k = k + 1
            pos = pos + n + s
            ended = special & (r < 15)
            if ended.any():
                e = np.flatnonzero(ended)
                extra = ((w[e] << n[e].astype(_U)) >> _U(1) >> (63 - r[e]).astype(_U)).astype(np.int64)
                pos[e] += r[e]
                k[e] = 64
                done[e] += (1 << r[e]) - 1 + extra
        else:
            if k.max() > 63:
                raise ValueError("damaged JPEG: a coefficient beyond the block")
            coefs[k, block] = np.where(v < 1 << (s - 1), v - (1 << s) + 1, v) << al
            k = k + 1
            pos = pos + n + s
        over = k > se
        if over.any():
            o = np.flatnonzero(over)
            done[o] += 1
            k[o] = ss
            alive = done < left
            if not alive.all():
                lane, pos, k, done, left = lane[alive], pos[alive], k[alive], done[alive], left[alive]
            block = number(lane, done)


def _ac_refine_scan(bits: _Bits, at: np.ndarray, count: np.ndarray, number, table: tuple, coefs: np.ndarray, ss: int, se: int, al: int) -> None:
    symbol, length = table
    offsets = np.cumsum(count) - count
    seg = np.repeat(np.arange(len(at)), count)
    blocks = number(seg, np.arange(int(count.sum())) - offsets[seg])  # of the scan, segment by segment
    values = coefs[ss : se + 1, blocks].T
    old = values != 0
    width = se - ss + 1
    before = np.zeros((len(blocks), width + 1), np.int16)  # nonzero coefficients before each place
    np.cumsum(old, axis=1, dtype=np.int16, out=before[:, 1:])
    starts = np.cumsum(before[:, -1], dtype=np.int64) - before[:, -1]
    events: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # row, from, to (exclusive), bit
    lane = np.arange(len(at))
    pos, k, row, end = at.copy(), np.zeros(len(at), np.int64), offsets.copy(), offsets + count
    while len(lane):
        w = bits.peek(pos)
        code = (w >> _U(48)).astype(np.int64)
        rs, n = symbol[code], length[code]
        r, s = rs >> 4, rs & 15
        pos = pos + n
        ended = (s == 0) & (r < 15)
        to = np.full(len(lane), width)
        new = np.flatnonzero(~ended)
        if len(new):
            zeros = np.arange(width)[None, :] - before[row[new], :-1]  # zeros before each place
            want = k[new] - before[row[new], k[new]] + r[new]
            hit = (zeros == want[:, None]) & ~old[row[new]] & (np.arange(width)[None, :] >= k[new][:, None])
            if not hit.any(axis=1).all():
                raise ValueError("damaged JPEG: a run beyond the block")
            to[new] = hit.argmax(axis=1) + 1
            fresh = s[new] == 1
            f = new[fresh]
            sign = np.where((w[f] << n[f].astype(_U)) >> _U(63) == 1, 1, -1)
            coefs[ss + to[f] - 1, blocks[row[f]]] = sign << al
            pos[f] += 1
        e = np.flatnonzero(ended)
        more = np.zeros(len(lane), np.int64)
        if len(e):
            extra = ((w[e] << n[e].astype(_U)) >> _U(1) >> (63 - r[e]).astype(_U)).astype(np.int64)
            pos[e] += r[e]
            more[e] = (1 << r[e]) - 1 + extra
        events.append((row.copy(), k.copy(), to, pos.copy()))
        pos = pos + (before[row, to] - before[row, k]).astype(np.int64)
        k = to.copy()
        over = k >= width
        row = row + over
        k[over] = 0
        while (more > 0).any():  # whole blocks of an end-of-band run
            m = np.flatnonzero(more > 0)
            events.append((row[m], np.zeros(len(m), np.int64), np.full(len(m), width), pos[m]))
            pos[m] += before[row[m], width]
            row[m] += 1
            more[m] -= 1
        alive = row < end
        if not alive.all():
            lane, pos, k, row, end = lane[alive], pos[alive], k[alive], row[alive], end[alive]
    row, a, b, bit = (np.concatenate(x) for x in zip(*events, strict=True))
    many = (before[row, b] - before[row, a]).astype(np.int64)
    whole = np.flatnonzero((many == width) & (values[row, 0] > 0)) if (values >= 0).all() else np.zeros(0, np.int64)
    if len(whole):  # one correction bit for each coefficient of the band, all of them positive
        at_bit = bit[whole] + np.arange(width)[:, None]
        one = (bits.data[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8)) & 1
        coefs[ss : se + 1, blocks[row[whole]]] += one.astype(coefs.dtype) << al
        rest = np.ones(len(row), bool)
        rest[whole] = False
        row, a, bit, many = row[rest], a[rest], bit[rest], many[rest]
    flat_row, flat_col = np.nonzero(old)
    shift = np.repeat(np.cumsum(many) - many, many)
    each = np.arange(int(many.sum())) - shift
    which = np.repeat(starts[row] + before[row, a], many) + each
    at_bit = np.repeat(bit, many) + each
    one = (bits.data[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8)) & 1
    i, j = flat_row[which], flat_col[which]
    c, bl = ss + j, blocks[i]
    coefs[c, bl] += np.where(values[i, j] < 0, -1, 1).astype(coefs.dtype) * (one.astype(coefs.dtype) << al)


def _pieces(bits: _Bits, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start bit, span) of each restart segment of the spans (begin, end) of the raw data."""
    lo, hi = np.searchsorted(bits.restarts, spans[:, 0], side="right"), np.searchsorted(bits.restarts, spans[:, 1], side="left")
    many = hi - lo + 1
    span = np.repeat(np.arange(len(spans)), many)
    each = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin = np.where(each == 0, spans[span, 0], bits.restarts[np.minimum(lo[span] + each - 1, max(0, len(bits.restarts) - 1))] if len(bits.restarts) else spans[span, 0])
    return bits.place[begin] * 8, span


def coefficients(files: list[bytes]) -> tuple[list[_File], list[list[_Plane]], np.ndarray]:
    """The files' frames, where their blocks stand, and all coefficients (64, blocks) in zigzag order."""
    buf = b"".join(files)
    raw = np.frombuffer(buf, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    nxt = raw[ff + 1]
    marks = ff[(nxt != 0) & (nxt != 0xFF) & ((nxt < 0xD0) | (nxt > 0xD7))]
    bases = np.cumsum([0, *map(len, files)])
    near = np.searchsorted(marks, bases[:-1]).tolist()
    listed = marks.tolist()
    frames = [_parse(buf, base, listed, i) for base, i in zip(bases[:-1].tolist(), near, strict=True)]
    planes: list[list[_Plane]] = []
    total = 0
    for f in frames:
        hm, vm = max(c[1] for c in f.comps), max(c[2] for c in f.comps)
        mw, mh = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
        own = []
        for _, h, v, _q in f.comps:
            own.append(_Plane(total, mw * h, mh * v, -(-(-(-f.width * h // hm)) // 8), -(-(-(-f.height * v // vm)) // 8)))
            total += mw * h * mh * v
        planes.append(own)
    coefs = np.zeros((64, total), np.int32)
    bits = _Bits(raw)
    for level in range(max((len(f.scans) for f in frames), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(frames):
            if level < len(f.scans):
                key = f.scans[level][0]
                groups.setdefault((key, tuple((f.comps[c][1], f.comps[c][2]) for c in key[0])), []).append(i)
        for ((comps, ss, se, ah, al, used, restart), factors), members in groups.items():
            spans = np.array([frames[i].scans[level][1:] for i in members])
            at, span = _pieces(bits, spans)
            own = [[planes[i][c] for i in members] for c in comps]
            first = np.searchsorted(span, np.arange(len(members)))
            each = np.arange(len(span)) - first[span]  # segment of its file
            alone = len(comps) == 1
            across = np.array([p.own_across if alone else p.across // factors[0][0] for p in own[0]])
            units = across * np.array([p.own_down if alone else p.down // factors[0][1] for p in own[0]])
            per = restart or int(units.max())
            count = np.minimum(per, units[span] - each * per)
            if (count < 0).any():
                raise ValueError("damaged JPEG: more restart segments than blocks")
            tables = [decode_table(*t) if t else None for t in used]
            if ss == 0:
                offset = (np.cumsum(units) - units)
                file_of = np.repeat(np.arange(len(members)), units)

                def place(c: int, dy: int, dx: int, units=units, offset=offset, file_of=file_of, own=own, across=across, factors=factors, alone=alone):
                    start = np.array([p.start for p in own[c]])
                    stride = np.array([p.across for p in own[c]])
                    h, v = (1, 1) if alone else factors[c]

                    def number(unit: np.ndarray) -> np.ndarray:
                        f = file_of[unit]
                        u = unit - offset[f]
                        return start[f] + (u // across[f] * v + dy) * stride[f] + u % across[f] * h + dx

                    return number

                order = [(c, place(c, dy, dx)) for c, (h, v) in enumerate(factors) for dy in range(1 if alone else v) for dx in range(1 if alone else h)]
                _dc_scan(bits, at, count, offset[span] + each * per, order, tables, coefs, ah, al)
            else:
                start = np.array([p.start for p in own[0]])
                stride = np.array([p.across for p in own[0]])
                ahead = each * per

                def number(lane: np.ndarray, k: np.ndarray, span=span, ahead=ahead, start=start, stride=stride, across=across) -> np.ndarray:
                    f, u = span[lane], ahead[lane] + k
                    return start[f] + u // across[f] * stride[f] + u % across[f]

                (_ac_refine_scan if ah else _ac_first_scan)(bits, at, count, number, tables[0], coefs, ss, se, al)
    return frames, planes, coefs


_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


#: Blocks transformed at a time.  Products of this size stay in the cache and below what BLAS deals out to
#: threads, and as all have one shape, equal blocks give equal samples wherever they stand.
_SLICE = 512


def _samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples, not yet clipped.  quant: (blocks, 64), or one number."""
    n = coefs.shape[1]
    out = np.empty((-(-n // _SLICE) * _SLICE, 8, 8), np.float32)
    natural = np.zeros((_SLICE, 64), np.float32)
    for a in range(0, n, _SLICE):
        part = coefs[:, a : a + _SLICE].T * (quant if quant.ndim == 0 else quant[a : a + _SLICE])
        natural[: len(part), ZIGZAG] = part
        half = natural.reshape(-1, 8) @ _C  # rows
        half = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _C  # columns
        np.add(half.reshape(-1, 8, 8).transpose(0, 2, 1), np.float32(128), out=out[a : a + _SLICE])
    return out[:n]


def _plane(p: _Plane, samples: np.ndarray) -> np.ndarray:
    own = samples[p.start : p.start + p.across * p.down]
    return own.reshape(p.down, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(p.down * 8, p.across * 8)


def rgb(frames: list[_File], planes: list[list[_Plane]], coefs: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB, (height, width, 3) of 8 bits, of each file.  Grey files have three equal
    channels."""
    quant = np.ones((64, coefs.shape[1]), np.float32) if any((t != 1).any() for f in frames for t in f.quant.values()) else None
    if quant is not None:
        for f, own in zip(frames, planes, strict=True):
            for (_, _, _, q), p in zip(f.comps, own, strict=True):
                quant[:, p.start : p.start + p.across * p.down] = f.quant[q][:, None]
    samples = _samples(coefs, np.float32(1) if quant is None else quant.T)
    out = []
    for f, own in zip(frames, planes, strict=True):
        hm, vm = max(c[1] for c in f.comps), max(c[2] for c in f.comps)
        full = []
        for (_, h, v, _q), p in zip(f.comps, own, strict=True):
            x = _plane(p, samples)
            if vm > v:
                x = np.repeat(x, vm // v, axis=0)
            if hm > h:
                x = np.repeat(x, hm // h, axis=1)
            full.append(np.clip(x[: f.height, : f.width], 0, 255))
        if len(full) == 1:
            pixels = np.repeat(full[0][:, :, None], 3, axis=2)
        else:
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            pixels = np.empty((*y.shape, 3), np.float32)
            pixels[..., 0] = y + 1.402 * cr
            pixels[..., 1] = y - 0.344136 * cb - 0.714136 * cr
            pixels[..., 2] = y + 1.772 * cb
        out.append(np.clip(pixels + 0.5, 0, 255).astype(np.uint8))
    return out


def payloads(frames: list[_File], planes: list[list[_Plane]], coefs: np.ndarray) -> list[bytes]:
    """What ``encode`` stored, with its padding: zero bytes up to a positive multiple of 64."""
    flat = np.ascontiguousarray(coefs.T.astype(np.uint8))
    out = []
    for f, own in zip(frames, planes, strict=True):
        n = 64 * max(1, -(-(f.n_bytes or 0) // 64))
        a = own[0].start
        out.append(flat[a : a + n // 64].tobytes())  # the planes of a file stand one after another
    return out
