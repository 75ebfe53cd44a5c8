"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words: runs of letters (A-Z lower-cased; every non-ASCII character counts as a letter), runs of digits
and runs of other characters, told apart by case shape where a run of letters is all upper case.
Features: the words, pairs of neighbouring words, and features for a word that repeats the one before,
for one that repeats the last but one, and for a word in capitals.  They are hashed into ``2 ** HASH_BITS`` places; a feature's value is its share of the text's
features times ``SCALE``.  A null or empty text has no feature, so its score is the bias's.

Training takes at most ``TRAIN_ROWS`` labelled rows, those of least hash (a documented bound: the model
has a fixed size), in one task; without a labelled row every score is 0.5.  Scoring is a sparse dot
product per text, over whole texts, and a text's score depends on nothing but the text.  Texts of any length
are read in blocks of ``BYTES``, so a task's memory doesn't grow with them.  Columns of docs keep their names and
values, whatever these are; ``score`` and ``predicted`` take the first free names from these on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.common import bounded_batches, free_name

HASH_BITS, TRAIN_ROWS, EPOCHS, SCALE, THRESHOLD = 18, 6000, 4, 30.0, 0.3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.02
#: Bytes tokenised at a time; a longer text is read in blocks, and a longer run of one class is several words.
BYTES = 1 << 19

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[128:] = _LETTER
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 3 * BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _STEP), ("down", _BACK)):
                seq = np.full(size, base, np.uint64)
                seq[0] = 1
                _POWERS[name] = np.multiply.accumulate(seq)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def features(data: np.ndarray, at: np.ndarray, bits: int = HASH_BITS, cuts: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature of texts that stand one after another in data.  A word ends at
    cuts, too."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    kind = _CLASS[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = True  # a word ends with its text
    begins[list(cuts)] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != _SPACE
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, none
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data] + np.uint64(1)) * down[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * up[starts]
        uppers = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_UPPER[data], out=uppers[1:])
        shouted = (uppers[ends] - uppers[starts] == ends - starts) & (ends - starts > 1)
        text = np.searchsorted(at, starts, side="right") - 1
        h = _mix(h)
        pair = (text[1:] == text[:-1])
        same = pair & (h[1:] == h[:-1])
        two = _mix(h[:-1] * np.uint64(3) + h[1:])
        again = (text[2:] == text[:-2]) & (h[2:] == h[:-2]) & (kind[starts[2:]] == _LETTER)
    two[same] = 11
    mask = np.uint64((1 << bits) - 1)
    places = np.concatenate([h & mask, two[pair] & mask, np.full(int(shouted.sum()), 7, np.uint64), np.full(int(again.sum()), 13, np.uint64)])
    return np.concatenate([text, text[1:][pair], text[shouted], text[2:][again]]), places.astype(np.int64)


def _long_blocks(data: np.ndarray, bits: int, size: int):
    """(sign, places) of one long text, about ``size`` bytes at a time: the features of each block and of the two
    words before it, less those of these two words alone."""
    none, start, n = np.zeros(1, np.int64), 0, len(data)
    words: list[int] = []  # where the last two words begin
    cuts: list[int] = []
    while start < n:
        end = min(n, start + size)
        kind = _CLASS[data[start:end]]
        changes = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if end < n and len(changes):
            end = start + int(changes[-1])  # between two words
        context = words[0] if words else start
        inner = tuple(c - context for c in cuts if context < c < end)
        for sign, stop in ((1, end), (-1, start)):
            if stop > context:
                yield sign, features(data[context:stop], np.append(none, stop - context), bits, tuple(c for c in inner if c < stop - context))[1]
        kind = kind[: end - start]
        begins = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        words = (words + (begins[kind[begins] != _SPACE][-2:] + start).tolist())[-2:]
        cuts = [c for c in (*cuts, end) if c > words[0]] if words else [end]
        start = end


def _blocks(data: np.ndarray, at: np.ndarray, bits: int, size: int = BYTES):
    """((first, end), sign, text number within, place) of texts, about ``size`` bytes at a time.  A feature with sign
    -1 takes one away."""
    a, n = 0, len(at) - 1
    while a < n:
        if at[a + 1] - at[a] > size:
            for sign, places in _long_blocks(data[at[a] : at[a + 1]], bits, size):
                yield (a, a + 1), sign, np.zeros(len(places), np.int64), places
            a += 1
            continue
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1))
        yield (a, b), 1, *features(data[at[a] : at[b]], at[a : b + 1] - at[a], bits)
        a = b


def _rows(data: np.ndarray, at: np.ndarray, bits: int, size: int = BYTES):
    """(places, how often) of one text after another."""
    whole, last = None, -1
    for (a, b), sign, text, place in _blocks(data, at, bits, size):
        if whole is not None and a != last:
            yield np.flatnonzero(whole), whole[whole != 0]
            whole = None
        if b - a == 1 and at[b] - at[a] > size:
            whole = np.zeros(1 << bits, np.int64) if whole is None else whole
            whole += sign * np.bincount(place, minlength=1 << bits)
            last = a
            continue
        order = np.argsort(text, kind="stable")
        place, ends = place[order], np.searchsorted(text[order], np.arange(b - a + 1))
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            yield np.unique(place[i:j], return_counts=True)
    if whole is not None:
        yield np.flatnonzero(whole), whole[whole != 0]


def train(data: np.ndarray, at: np.ndarray, labels: np.ndarray, bits: int = HASH_BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights; the last is the bias."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [(np.append(where, size).astype(np.int32), np.append(count * (SCALE / max(1, count.sum())), 1.0).astype(np.float32)) for where, count in _rows(data, at, bits)]

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for (where, x), y in zip(rows, labels, strict=True):
            w = weights(where)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[where] += g - (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / ALPHA * w
            n[where] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


def score(data: np.ndarray, at: np.ndarray, weights: np.ndarray, size: int = BYTES) -> np.ndarray:
    """Scores of texts that stand one after another in data."""
    total, many = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for (a, b), sign, text, place in _blocks(data, at, (len(weights) - 1).bit_length() - 1, size):
        total[a:b] += sign * np.bincount(text, weights=weights[place], minlength=b - a)
        many[a:b] += sign * np.bincount(text, minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(total * (SCALE / np.maximum(many, 1)) + weights[-1], -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "quality", allowed: Column | None = None) -> DataFrame:
    """(ord, text, label) of at most ``most`` labelled ids of docs, those of least hash of the id.

    A label that is null, or an id that is null, isn't used; of several labels of an id the largest is.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        one = one.where(allowed)
    at_hand = docs.select(F.col(id_col).alias("_at_hand"))
    one = one.join(at_hand, F.col(id_col) == F.col("_at_hand"), "left_semi")
    ids = one.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label")).select("_id", "_label", F.xxhash64("_id").alias("_ord")).orderBy("_ord", "_id").limit(most)
    few = F.broadcast(ids)  # at most ``most`` rows of three numbers
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.join(few, "_id").select(F.col("_ord").alias("ord"), F.col("_text").alias("text"), F.col("_label").cast("int").alias("label"))


def fit(sample: DataFrame) -> np.ndarray:
    """The model of a bounded sample of (ord, text, label), trained in one task, in order of ``ord``."""
    bounded_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([("ord", "ascending"), ("text", "ascending")])
        data, at = arrow_text.utf8(t["text"])
        w = train(data, at, t["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["model"])

    got = sample.select(F.col("ord").cast("long"), "text", F.col("label").cast("int")).repartition(1).mapInArrow(run, "model binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << HASH_BITS) + 1, np.float32)


def with_score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each text; the model, of fixed size, is broadcast."""
    bounded_batches()
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        data, at = arrow_text.utf8(texts)
        return pa.array(score(data, at, shared.value))

    return df.withColumn(out, of(F.coalesce(F.col(text), F.lit(""))))


def held_out(id_col: str = "doc_id") -> Column:
    """Ids set aside for measuring: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 from THRESHOLD on), under free names if docs has these."""
    model = fit(labelled_sample(docs, labels, id_col=id_col, text=text, allowed=~held_out(id_col)))
    s = free_name(docs, "score")
    out = with_score(docs, model, text, s)
    return out.withColumn(free_name(docs, "predicted"), (F.col(s) >= THRESHOLD).cast("int"))
