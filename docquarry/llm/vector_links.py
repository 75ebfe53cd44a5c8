"""Near-duplicate vectors of one label: a subspace pigeonhole join.

Two vectors are linked if their labels are equal and their cosine is at least a threshold t, that is if their unit
vectors are within the squared distance 2 (1 - t).  Unit vectors are turned by a fixed random rotation and cut into
``BLOCKS`` blocks of few dimensions.  Each block gets a share of that squared distance as its budget, in proportion to its
dimensions; a linked pair keeps to the budget of at least one block, so a range join in every block finds all.

Range join.  In a block, space is cut into boxes by splitting it again and again at medians (of a bounded sample; the
sample decides how even the boxes are, not what is found), as deep as the number of vectors of a label asks for.
A vector is at home in its box and visits every box before it that its range reaches.  Pairs of a box's homes, and
of its homes and visitors, are compared.  Boxes that stay too large are dealt out as pairs of chunks, so no task
holds more than two chunks, whatever a label's or a group's share of the rows.

What is shuffled is a sketch: the rotated unit vector in one byte for each dimension, with the error this makes.  All
distances allow for the errors of both sides.  A pair that several blocks find counts in the first one only.  Its
cosine is known from the sketches within their errors; if that leaves it open whether it reaches t, it is computed
exactly, in double precision, from the vectors themselves.  Tasks give counts of links and the links of a spanning
forest, not their pairs.

Equal vectors of a label are joined once, with their number.  Defined results: vectors that are null, empty, zero or
hold null or non-finite components link with nothing, nor do rows without a label, or vectors of different
lengths.  Rows without an id link like others; their component is the least id of those that have one, or null.
Repeated rows are vectors of their own.  An empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.common import bounded_batches, written
from docquarry.llm.components import components
from docquarry.llm.simhash import _forest

THRESHOLD, BLOCKS = 0.93, 8
#: Homes that a box should have; rows of a chunk; rows that medians are taken from; splits on the way to a box.
LEAF, CHUNK, SAMPLE, MOST_DEPTH = 4096, 8192, 1 << 15, 12
#: Rows of a tile of comparisons, and pairs looked at in one go.
TILE, GO = 512, 1 << 14
#: What rounding of float32 products may change, and of the rotation.
SLACK, ROUNDING = 1e-5, 1e-6

Tree = list[tuple[np.ndarray, np.ndarray]]  # for each level: the coordinate and the value that each of its boxes is split at


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def ranges(dim: int, threshold: float, blocks: int) -> np.ndarray:
    """The distance that each block allows: the root of its share of the squared distance."""
    return np.sqrt([2 * (1 - threshold) * (b - a) / dim for a, b in block_edges(dim, blocks)])


# --- sketches -------------------------------------------------------------------------------------


def sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, errors) of vectors of one length: scale and error as float32, then a byte for each dimension."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ rotation(x.shape[1])
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    q = np.clip(np.rint(unit / scale[:, None]), -127, 127).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None].astype(np.float64), axis=1) + ROUNDING
    error = np.nextafter(error.astype(np.float32), np.float32(np.inf))
    return np.hstack([scale[:, None].view(np.uint8), error[:, None].view(np.uint8), q.view(np.uint8)]), error


def unsketched(rows: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, errors) of sketches."""
    data = arrow_text.utf8(rows)[0].reshape(len(rows), dim + 8)
    scale, error = (np.ascontiguousarray(data[:, k : k + 4]).view(np.float32)[:, 0] for k in (0, 4))
    return data[:, 8:].view(np.int8) * scale[:, None], error


def _usable(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each length among the vectors that can be linked."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.nan_to_num(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield rows[ok], x[ok]


def sketches(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, key, err, sketch) of each row; all but id and label are null if it links with nothing.  key
    is a digest of the vector."""
    bounded_batches()

    @F.arrow_udf("struct<dim: int, key: binary, err: float, sketch: binary>")
    def of(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        dims, keys, errors, rows = ([None] * n for _ in range(4))
        for at, x in _usable(vectors):
            made, error = sketch(x)
            for k, i in enumerate(at.tolist()):
                dims[i], errors[i], rows[i] = x.shape[1], float(error[k]), made[k].tobytes()
                keys[i] = hashlib.blake2b(x[k].tobytes(), digest_size=16).digest()
        return pa.StructArray.from_arrays([pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(errors, pa.float32()), pa.array(rows, pa.binary())], ["dim", "key", "err", "sketch"])

    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), of(F.col(f"`{vector}`")).alias("s"))
    return own.select("id", "label", *(F.when(F.col("label").isNotNull(), F.col(f"s.{c}")).alias(c) for c in ("dim", "key", "err", "sketch")))


# --- boxes ----------------------------------------------------------------------------------------


def grown(x: np.ndarray, depth: int) -> Tree:
    """Splits at medians, each along the coordinate in which a box's rows of x are spread most."""
    box, tree = np.zeros(len(x), np.int64), []
    for level in range(depth):
        coordinate, value = np.zeros(1 << level, np.int64), np.zeros(1 << level)
        for k in range(1 << level):
            own = x[box == k]
            if len(own):
                coordinate[k] = c = int(np.argmax(own.std(axis=0)))
                value[k] = np.median(own[:, c])
        tree.append((coordinate, value))
        box = 2 * box + (x[np.arange(len(x)), coordinate[box]] >= value[box])
    return tree


def boxes(tree: Tree, depth: int, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, box, at home) of each row's own box and of those before it that are within its reach."""
    row, box, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    gaps = np.zeros(x.shape)  # to the box, along each coordinate
    for coordinate, value in tree[:depth]:
        c, s = coordinate[box], value[box]
        at = x[row, c]
        right = at >= s
        beyond = gaps.copy()
        k = np.arange(len(row))
        beyond[k, c] = np.maximum(beyond[k, c], np.abs(at - s))
        far = ((beyond * beyond).sum(axis=1) <= reach[row] ** 2) & (~home | right)
        row = np.concatenate([row, row[far]])
        box = np.concatenate([2 * box + right, (2 * box + ~right)[far]])
        home = np.concatenate([home, np.zeros(int(far.sum()), bool)])
        gaps = np.concatenate([gaps, beyond[far]])
    return row, box, home


def _placed(trees: dict[tuple[int, int], Tree], threshold: float, blocks: int, whole: bool):
    """Rows of (node, copies, sketch, dim, grp, depth, most_err) to (grp, block, box, home), with node, copies, dim and
    sketch if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x, error = unsketched(own["sketch"], dim)
                depths, most = own["depth"].to_numpy(), own["most_err"].to_numpy()
                for block, (a, b) in enumerate(block_edges(dim, blocks)):
                    reach = ranges(dim, threshold, blocks)[block] + error + most + SLACK
                    tree = trees.get((dim, block), [])
                    for depth in np.unique(depths).tolist():
                        these = np.flatnonzero(depths == depth)
                        row, box, home = boxes(tree, depth, x[these, a:b].astype(np.float64), reach[these])
                        rows = own.take(pa.array(these[row]))
                        out = [rows["grp"], pa.array(np.full(len(row), block, np.int32)), pa.array(box.astype(np.int32)), pa.array(home)]
                        yield pa.RecordBatch.from_arrays(out + [rows[c] for c in ("node", "copies", "dim", "sketch")] * whole, ["grp", "block", "box", "home", *("node", "copies", "dim", "sketch") * whole])

    return run


# --- pairs ----------------------------------------------------------------------------------------


class _Bucket:
    """Links among the rows of a box, or of a pair of its chunks."""

    def __init__(self, block: int, dim: int, rows: pa.Table, threshold: float, blocks: int):
        self.x, self.error = unsketched(rows["sketch"], dim)
        self.node, self.copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        self.block, self.edges, self.range, self.threshold = block, block_edges(dim, blocks), ranges(dim, threshold, blocks), threshold
        self.n_links, self.root = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def _within(self, block: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs keep to a block's budget, within their errors.  Added up in one order of coordinates, so that
        every task finds the same."""
        a, b = self.edges[block]
        d = self.x[i, a:b].astype(np.float64).T - self.x[j, a:b].astype(np.float64).T
        total = np.zeros(len(i))
        for row in d:
            total += row * row
        return np.sqrt(total) <= self.range[block] + self.error[i].astype(np.float64) + self.error[j]

    def compare(self, left: np.ndarray, right: np.ndarray, within: bool) -> None:
        """Pairs of left and right rows, and of left ones among themselves if ``within``."""
        a, b = self.edges[self.block]
        part = self.x[:, a:b].astype(np.float32)
        square = (part * part).sum(axis=1)
        sides = [(left, right, False)] + [(left, left, True)] * within
        for one, other, same in sides:
            for s in range(0, len(one), TILE):
                i = one[s : s + TILE]
                for t in range(s if same else 0, len(other), TILE):
                    j = other[t : t + TILE]
                    most = self.range[self.block] + self.error[i][:, None] + self.error[j][None, :]
                    near = square[i][:, None] + square[j][None, :] - 2 * (part[i] @ part[j].T) <= most * most + SLACK
                    if same and s == t:
                        near = np.triu(near, 1)
                    p, q = np.nonzero(near)
                    for k in range(0, len(p), GO):
                        self._verify(i[p[k : k + GO]], j[q[k : k + GO]])

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for block in range(self.block + 1):
            found = self._within(block, i, j)
            keep = found if block == self.block else ~found  # an earlier block's task counts the others
            i, j = i[keep], j[keep]
        if not len(i):
            return
        cosine = np.einsum("ij,ij->i", self.x[i].astype(np.float64), self.x[j].astype(np.float64))
        e, f = self.error[i].astype(np.float64), self.error[j].astype(np.float64)
        error = e + f + 3 * e * f
        sure = cosine - error >= self.threshold
        unsure = ~sure & (cosine + error >= self.threshold)
        if unsure.any():
            self.open.append((i[unsure], j[unsure]))
        i, j = i[sure], j[sure]
        np.add.at(self.n_links, i, self.copies[j])
        np.add.at(self.n_links, j, self.copies[i])
        a, b = self.root[i], self.root[j]
        apart = a != b
        if apart.any():
            self.root = _forest(len(self.root), a[apart], b[apart])[self.root]

    def result(self) -> pa.RecordBatch | None:
        """Rows of kind 0 (node, links counted), 1 (node, a node linked to it through others) and 2 (a pair to be
        computed from its vectors)."""
        some, moved = np.flatnonzero(self.n_links), np.flatnonzero(self.root != np.arange(len(self.root)))
        pairs = [np.concatenate(x) if self.open else np.zeros(0, np.int64) for x in (zip(*self.open, strict=True) if self.open else ((), ()))]
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(some), len(moved), len(pairs[0])])
        if not len(kind):
            return None
        a = np.concatenate([self.node[some], self.node[moved], self.node[pairs[0]]])
        b = np.concatenate([self.n_links[some], self.node[self.root[moved]], self.node[pairs[1]]])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])


_KEYS = ("grp", "block", "box", "i", "j")


def _joined(threshold: float, blocks: int):
    """Rows sorted by _KEYS to what _Bucket.result gives for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
            first = {c: t[c][0].as_py() for c in ("block", "dim", "within")}
            bucket = _Bucket(first["block"], first["dim"], t, threshold, blocks)
            right = t["right"].to_numpy()
            bucket.compare(np.flatnonzero(~right), np.flatnonzero(right), first["within"])
            if (got := bucket.result()) is not None:
                yield got

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = np.stack([t[c].to_numpy().astype(np.int64) for c in _KEYS], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(keys[a].tolist())
                if held and key != last:
                    yield from give(pa.concat_tables(held))
                    held = []
                held.append(t.slice(a, b - a))
                last = key
        if held:
            yield from give(pa.concat_tables(held))

    return run


def _trees(distinct: DataFrame, large: DataFrame, blocks: int, sample: int) -> dict[tuple[int, int], Tree]:
    """A tree for each length of vectors and block, from at most ``sample`` vectors of labels with many."""
    rows = distinct.join(large, ["label", "dim"], "left_semi").select("dim", "sketch", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(sample).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        x, _ = unsketched(pa.array([bytes(r["sketch"]) for r in rows if r["dim"] == dim], pa.binary()), dim)
        depth = min(MOST_DEPTH, max(0, int(np.log2(len(x) / 8))))
        for block, (a, b) in enumerate(block_edges(dim, blocks)):
            out[dim, block] = grown(x[:, a:b].astype(np.float64), depth)
    return out


def _exact(df: DataFrame, pairs: DataFrame, distinct: DataFrame, vector: str, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose vectors have a cosine of at least the threshold, in double precision."""
    bounded_batches()

    @F.arrow_udf("binary")
    def key(vectors: pa.Array) -> pa.Array:
        out = [None] * len(vectors)
        for at, x in _usable(vectors):
            for k, i in enumerate(at.tolist()):
                out[i] = hashlib.blake2b(x[k].tobytes(), digest_size=16).digest()
        return pa.array(out, pa.binary())

    @F.arrow_udf("double")
    def cosine(u: pa.Array, v: pa.Array) -> pa.Array:
        out = np.zeros(len(u))
        for i, (x, y) in enumerate(zip(u, v, strict=True)):
            x, y = (np.array(z.values.cast(pa.float64())) for z in (x, y))
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            out[i] = x @ y / np.sqrt((x @ x) * (y @ y))
        return pa.array(out)

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = distinct.select("node", "key").join(asked, "node")
    vectors = df.select(key(F.col(f"`{vector}`")).alias("key"), F.col(f"`{vector}`").alias("v")).join(nodes.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    of = nodes.join(vectors, "key").select("node", "v")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("v").alias("u")), "a").join(of.select(F.col("node").alias("b"), "v"), "b")
    return both.where(cosine("u", "v") >= threshold).select("a", "b")


def linked(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS, leaf: int = LEAF, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component) of each row of df."""
    base = written(sketches(df, id_col, vector, label), "vectors-base")
    usable = base.where("key IS NOT NULL")
    groups = usable.groupBy("label", "dim", "key", "err", "sketch").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    distinct = written(groups.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors-distinct")
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"), F.max("err").alias("most_err")).where("n > 1")
    sizes = written(sizes.select(F.monotonically_increasing_id().alias("grp"), "label", "dim", "most_err", F.least(depth, F.lit(MOST_DEPTH)).alias("depth")), "vectors-sizes")
    trees = _trees(distinct, sizes.where("depth > 0").select("label", "dim"), blocks, sample)
    deepest = {dim: len(t) for (dim, _), t in trees.items()}
    if deepest:  # no deeper than the sample's trees
        known = F.create_map(*(F.lit(x) for pair in deepest.items() for x in pair))
        sizes = sizes.withColumn("depth", F.least("depth", F.coalesce(known[F.col("dim")], F.lit(0))))
    bounded_batches()
    rows = distinct.join(sizes, ["label", "dim"]).select("node", F.col("copies").cast("long").alias("copies"), "sketch", "dim", "grp", "depth", "most_err")
    where = "grp long, block int, box int, home boolean"
    count = rows.mapInArrow(_placed(trees, threshold, blocks, False), where).groupBy("grp", "block", "box").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / chunk)).cast("int")
    large = written(count.where((F.col("homes") > 0) & ((F.col("homes") > chunk) | (F.col("visitors") > chunk))).select("grp", "block", "box", chunks("homes").alias("h"), chunks("visitors").alias("v")), "vectors-large")
    placed = rows.mapInArrow(_placed(trees, threshold, blocks, True), f"{where}, node long, copies long, dim int, sketch binary")
    dealt = placed.join(large, ["grp", "block", "box"], "left")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("home"), own).otherwise(F.col("h") + own))
    others = F.when(F.col("h").isNull(), F.array(F.lit(0))).when(F.col("home"), F.sequence(F.lit(0), F.col("h") + F.col("v") - 1)).otherwise(F.sequence(F.lit(0), F.col("h") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    whole = F.col("h").isNull()  # the box is one bucket
    i, j = (F.when(whole, 0).otherwise(f("own", "other")) for f in (F.least, F.greatest))
    right = F.when(whole, ~F.col("home")).otherwise(F.col("own") > F.col("other"))
    dealt = dealt.select("grp", "block", "box", i.alias("i"), j.alias("j"), right.alias("right"), (whole | (F.col("own") == F.col("other"))).alias("within"), "node", "copies", "dim", "sketch")
    found = written(dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_joined(threshold, blocks), "kind int, a long, b long"), "vectors-found")
    counts, links = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select("a", "b")
    unsure = found.where("kind = 2").select("a", "b")
    if unsure.limit(1).count():
        more = written(_exact(df, unsure, distinct, vector, threshold), "vectors-exact")
        links = links.unionByName(more)
        copies = distinct.select(F.col("node").alias("b"), "copies")
        both = more.unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counts = counts.unionByName(both.join(copies, "b").select("a", F.col("copies").alias("b")))
    n_links = counts.groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    roots = components(links)
    own = distinct.select("node", "label", "dim", "key", "copies", "least").join(n_links, "node", "left").join(roots, "node", "left")
    own = written(own.select("label", "dim", "key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "node").alias("root")), "vectors-roots")
    least = own.groupBy("root").agg(F.min("least").alias("component"))
    of = written(own.join(least, "root").select("label", "dim", "key", "n_links", "component"), "vectors-components")
    alone = base.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return base.where("key IS NOT NULL").select("id", "label", "dim", "key").join(of, ["label", "dim", "key"]).select("id", "n_links", "component").unionByName(alone)
