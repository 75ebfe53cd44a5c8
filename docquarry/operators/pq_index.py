"""A vector index: lists under trained centres in two levels, product-quantised codes, exact rescoring.

Training sees a bounded sample (the ``SAMPLE`` rows of least hash).  Coarse centres come from Lloyd rounds, each a Spark
job over the sample that adds up its rows by nearest centre.  Under each coarse centre, fine centres are trained in a task
of its own.  There are about sqrt(n) fine centres, each with a list, at most ``MOST_LISTS``.  What is left of a unit vector
after its centre is taken away is cut into parts, and each part is named by the nearest of ``CODES`` code words, so a
vector is a byte for each part.

A question looks into the lists whose centres score within ``margin`` of its best centre.  The margin is measured on the
sample: it covers the lists of the ``COVER`` share of the true neighbours of sampled questions.  So clustered vectors
are found in few lists, and vectors without clusters in many.  Rows of these lists are scored by tables of products
of the question's parts and the code words; the best ``RESCORE`` times k of these are scored exactly.  Rows that score
below a floor, which the question's scores against ``FLOOR`` sampled vectors set, don't leave their task.

Every vector is in one list, whatever the sample.  Long lists are split into pieces of about ``PIECE`` rows, and the
questions of a list into groups of about ``ASKED``; a task holds one piece and one group.  Vectors that are null,
hold a null or have another length than the sample's first are in no list and are not found; zero vectors score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import vector_blocks as blocks
from docquarry.operators.retrieval import top
from docquarry.sources.shared import written

SAMPLE, MOST_LISTS, ROUNDS, PARTS, CODES = 1 << 16, 1 << 14, 6, 16, 256
COVER, CALIBRATION, RESCORE, FLOOR = 0.97, 256, 20, 8192
PIECE, ASKED = 1 << 16, 4096
#: Scores that a task has at hand at once; lists and sampled vectors that questions are compared with at once, each list looked
#: into being a row with the question's vector.
GO, PROBED = 1 << 20, 1 << 17
#: Coarse centres whose fine centres are compared when a vector is put into its list.
NEAR_CELLS = 4


@dataclass(frozen=True)
class Model:
    """coarse: (cells, dim).  fine: (lists, dim), cell: the coarse centre of each.  words: (parts, codes, width)."""

    coarse: np.ndarray
    fine: np.ndarray
    cell: np.ndarray
    words: np.ndarray
    margin: float = 0.0
    near: np.ndarray | None = None
    rows: int = 0

    @property
    def dim(self) -> int:
        return self.fine.shape[1]


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS, spherical: bool = False) -> np.ndarray:
    """At most k centres of the rows of x, beginning with rows spread evenly over x."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    step = max(1, GO // max(1, len(centres)))
    for _ in range(rounds):
        less = 0 if spherical else (centres * centres).sum(axis=1) / 2
        own = np.concatenate([np.argmax(x[at : at + step] @ centres.T - less, axis=1) for at in range(0, len(x), step)])
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, blocks.unit(sums) if spherical else sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _vectors(batch: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of those of the length."""
    for rows, x in blocks.matrices(batch["vector"]):
        if x.shape[1] == dim:
            return rows, blocks.unit(x)
    return np.zeros(0, np.int64), np.zeros((0, dim))


def _round(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """A Lloyd round on unit vectors: tasks add up their rows by nearest centre; the sums, one for each task and
    centre, meet on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            _, x = _vectors(batch, centres.shape[1])
            own = np.argmax(x @ centres.T, axis=1)
            np.add.at(sums, own, x)
            n += np.bincount(own, minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["sums", "n"])

    parts = sample.mapInArrow(run, "sums binary, n binary").collect()
    sums = sum(np.frombuffer(p["sums"]).reshape(centres.shape) for p in parts)
    n = sum(np.frombuffer(p["n"], np.int64) for p in parts)
    return np.where(n[:, None] > 0, blocks.unit(sums), centres)


def _fine(sample: DataFrame, coarse: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(fine centres, their cells): a task for each cell, which has as many as its share of the sample asks for."""
    dim = coarse.shape[1]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch, dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ coarse.T, axis=1).astype(np.int32)), batch["vector"].take(pa.array(rows))], ["cell", "vector"])

    total = sample.count()

    def train(table: pa.Table) -> pa.Table:
        _, x = _vectors(table, dim)
        found = lloyd(x, max(1, round(lists * len(x) / total)), spherical=True)
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), "centres": pa.array([found.tobytes()], pa.binary())})

    kind = dict(sample.dtypes)["vector"]
    got = sample.mapInArrow(celled, f"cell int, vector {kind}").groupBy("cell").applyInArrow(train, "cell int, centres binary").collect()
    each = [(r["cell"], np.frombuffer(r["centres"]).reshape(-1, dim)) for r in sorted(got, key=lambda r: r["cell"])]
    return np.concatenate([c for _, c in each]), np.concatenate([np.full(len(c), cell) for cell, c in each])


def _words(sample: DataFrame, model: Model, parts: int) -> np.ndarray:
    """Code words of each part of what is left after centres: a task for each part."""
    width = model.dim // parts

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _vectors(batch, model.dim)
            if len(x):
                rest = x - model.fine[own_list(x, model)]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([rest[:, p * width : (p + 1) * width].tobytes() for p in range(parts)], pa.binary())], ["part", "rest"])

    def train(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["rest"].to_pylist())).reshape(-1, width)
        found = lloyd(x[np.lexsort(x.T)], CODES)
        found = np.concatenate([found, np.repeat(found[:1], CODES - len(found), axis=0)])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "words": pa.array([found.tobytes()], pa.binary())})

    got = sample.mapInArrow(left, "part int, rest binary").groupBy("part").applyInArrow(train, "part int, words binary").collect()
    return np.stack([np.frombuffer(r["words"]).reshape(CODES, width) for r in sorted(got, key=lambda r: r["part"])])


def own_list(x: np.ndarray, model: Model) -> np.ndarray:
    """The list of each unit vector: of the fine centres under its nearest coarse ones the nearest."""
    near = np.argsort(-(x @ model.coarse.T), axis=1, kind="stable")[:, :NEAR_CELLS]
    most, out = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
    for cell in np.unique(near).tolist():
        lists = np.flatnonzero(model.cell == cell)
        rows = np.flatnonzero((near == cell).any(axis=1))
        if len(lists):
            scores = x[rows] @ model.fine[lists].T
            k = np.argmax(scores, axis=1)
            better = scores[np.arange(len(rows)), k] > most[rows]
            most[rows[better]], out[rows[better]] = scores[np.arange(len(rows)), k][better], lists[k[better]]
    return out


def _margin(x: np.ndarray, model: Model, k: int) -> float:
    """How far below its best centre the centres of a question's true neighbours score, for COVER of these."""
    asked = x[np.linspace(0, len(x) - 1, min(CALIBRATION, len(x))).astype(int)]
    hits = np.argsort(-(asked @ x.T), axis=1)[:, : k + 1]
    scores, lists = asked @ model.fine.T, own_list(x, model)
    gaps = scores.max(axis=1)[:, None] - np.take_along_axis(scores, lists[hits], axis=1)
    return float(np.quantile(gaps, COVER)) + 1e-9


def train(chunks: DataFrame, k: int = 10, sample: int = SAMPLE, parts: int = PARTS, most_lists: int = MOST_LISTS) -> Model | None:
    """The model of chunks (chunk_id, vector); None if no chunk has a vector."""
    own = chunks.where("vector IS NOT NULL AND size(vector) > 0")
    few = written(own.select("vector", F.xxhash64("chunk_id").alias("_h"), "chunk_id").orderBy("_h", "chunk_id").limit(sample).select("vector"), "pq-sample")
    first = few.first()
    if first is None:
        return None
    dim, n = len(first[0]), own.count()
    rows = few.toArrow()  # at most ``sample`` rows
    _, x = _vectors(rows, dim)
    lists = int(min(most_lists, max(1, round(n**0.5))))
    centres = x[np.linspace(0, len(x) - 1, min(len(x), max(1, round(lists**0.5)))).astype(int)]
    for _ in range(ROUNDS):
        centres = _round(few, centres)
    fine, cell = _fine(few, centres, lists)
    parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
    model = Model(centres, fine, cell, np.zeros((0, 0, 0)))
    model = Model(centres, fine, cell, _words(few, model, parts))
    return Model(centres, fine, cell, model.words, _margin(x, model, k), x[:FLOOR].astype(np.float32), n)


def coded(x: np.ndarray, lists: np.ndarray, model: Model) -> np.ndarray:
    """The code words (a byte for each part) of unit vectors."""
    rest, width = x - model.fine[lists], model.words.shape[2]
    out = np.zeros((len(x), len(model.words)), np.uint8)
    for p, words in enumerate(model.words):
        part = rest[:, p * width : (p + 1) * width]
        out[:, p] = np.argmax(part @ words.T - (words * words).sum(axis=1) / 2, axis=1)
    return out


def index(chunks: DataFrame, model: Model) -> DataFrame:
    """(list, piece, chunk_id, code) of every chunk (chunk_id, vector), in pieces of lists."""
    kind, shared = dict(chunks.dtypes)["chunk_id"], chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch, shared.value.dim)
            lists = own_list(x, shared.value)
            codes = coded(x, lists, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch["chunk_id"].take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "chunk_id", "code"])

    codes = written(chunks.select("chunk_id", "vector").mapInArrow(run, f"list int, chunk_id {kind}, code binary"), "pq-codes")
    pieces = codes.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_n"))  # at most MOST_LISTS rows
    return codes.join(F.broadcast(pieces), "list").select("list", F.pmod(F.xxhash64(F.lit("piece"), "chunk_id"), "_n").cast("int").alias("piece"), "chunk_id", "code")


def floors(x: np.ndarray, model: Model, most: int) -> np.ndarray:
    """For each question a score that about twice ``most`` of all vectors reach, by the sampled ones."""
    place = min(len(model.near), int(np.ceil(2 * most * len(model.near) / max(model.rows, 1))) + 8)
    scores = x.astype(np.float32) @ model.near.T
    return np.partition(scores, len(model.near) - place, axis=1)[:, -place].astype(np.float64) if len(x) else np.zeros(0)


def _looks(batch: pa.RecordBatch, model: Model, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``probes`` of a batch (qid, vector), of so few questions at once that at most ``PROBED`` rows leave together."""
    every, vectors = _vectors(batch, model.dim)
    step = max(1, PROBED // max(len(model.fine), len(model.near)))
    for at in range(0, len(every), step):
        rows, x = every[at : at + step], vectors[at : at + step]
        scores = x @ model.fine.T
        q, lists = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - model.margin)
        took = pa.array(rows[q])
        yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch["qid"].take(took), batch["vector"].take(took), pa.array(floors(x, model, most)[q])], ["list", "qid", "vector", "floor"])


def probes(questions: DataFrame, model: Model, most: int = RESCORE * 10) -> DataFrame:
    """(list, qid, vector, floor): each question (qid, vector) once for every list it looks into."""
    kinds, shared = dict(questions.dtypes), questions.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _looks(batch, shared.value, most)

    return questions.select("qid", "vector").mapInArrow(run, f"list int, qid {kinds['qid']}, vector {kinds['vector']}, floor double")


def candidates(questions: DataFrame, indexed: DataFrame, model: Model, most: int) -> DataFrame:
    """(qid, chunk_id, score): of each piece of a list and question the ``most`` best by code."""
    kinds, shared = (dict(questions.dtypes)["qid"], dict(indexed.dtypes)["chunk_id"]), questions.sparkSession.sparkContext.broadcast(model)
    asked = probes(questions, model, most)
    groups = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    pieces = indexed.groupBy("list").agg((F.max("piece") + 1).alias("pieces"))
    shape = F.broadcast(groups.join(pieces, "list"))  # at most MOST_LISTS rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "list").withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "qid"), "groups").cast("int")).withColumn("piece", each("pieces")).select("list", "piece", "group", "qid", "vector", "floor")
    right = indexed.join(shape, "list").withColumn("group", each("groups")).select("list", "piece", "group", "chunk_id", "code")

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        m = shared.value
        at, to, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and c.num_rows:
            codes = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(c.num_rows, -1)
            rows, x = _vectors(q, m.dim)
            width = m.words.shape[2]
            floor, start, found = q["floor"].to_numpy()[rows], x @ m.fine[q["list"][0].as_py()], []
            step = max(1, GO // max(c.num_rows, m.words.shape[0] * m.words.shape[1]))
            for s in range(0, len(x), step):
                tables = np.einsum("qpw,pcw->qpc", x[s : s + step].reshape(-1, len(m.words), width), m.words)
                part = start[s : s + step, None]
                for p in range(tables.shape[1]):
                    part = part + tables[:, p][:, codes[:, p]]
                least = floor[s : s + step]
                if c.num_rows > most:
                    least = np.maximum(least, np.partition(part, c.num_rows - most, axis=1)[:, -most])
                i, j = np.nonzero(part >= least[:, None])
                found.append((rows[s + i], j, part[i, j]))
            at, to, scores = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (at, to, scores)
        return pa.table({"qid": q["qid"].take(pa.array(at)), "chunk_id": c["chunk_id"].take(pa.array(to)), "score": pa.array(scores)})

    keys = ("list", "piece", "group")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double")


def search(questions: DataFrame, indexed: DataFrame, chunks: DataFrame, model: Model, k: int, rescore: int = RESCORE) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best of each question by exact cosine, of the best by code."""
    found = top(candidates(questions, indexed, model, rescore * k), rescore * k).select("qid", "chunk_id")
    kinds = dict(questions.dtypes)["qid"], dict(chunks.dtypes)["chunk_id"]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (at, u), (to, v) = (_vectors({"vector": b[c]}, model_dim) for c in ("_q", "_v"))
            both, i, j = np.intersect1d(at, to, return_indices=True)
            took = pa.array(both)
            yield pa.RecordBatch.from_arrays([b["qid"].take(took), b["chunk_id"].take(took), pa.array(np.round((u[i] * v[j]).sum(axis=1), 9))], ["qid", "chunk_id", "score"])

    model_dim = model.dim
    pairs = found.join(chunks.select("chunk_id", F.col("vector").alias("_v")), "chunk_id").join(questions.select("qid", F.col("vector").alias("_q")), "qid")
    return top(pairs.select("qid", "chunk_id", "_q", "_v").mapInArrow(exact, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def read_share(questions: DataFrame, indexed: DataFrame, model: Model) -> DataFrame:
    """(questions, share): the share of all codes that an average question reads."""
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n"))
    read = probes(questions, model).join(F.broadcast(sizes), "list").agg(F.sum("n").alias("read"))
    return read.crossJoin(questions.agg(F.count("*").alias("questions"))).crossJoin(indexed.agg(F.count("*").alias("rows"))).select("questions", F.round(F.col("read") / (F.col("questions") * F.col("rows")), 6).alias("share"))
