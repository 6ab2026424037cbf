"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, verified until a chi-square test holds.

Unit vectors at distance d keep, after projection by M Gaussian directions, a squared distance that is d^2 times a
chi-square variable with M degrees of freedom. So projected neighbours are taken from a kd-tree in order of their projected
distance and verified on the original vectors, until for a vector as near as the k-th best so far, a projected distance
beyond the present one has a probability of at most 1 - CONFIDENCE. Nothing else ends a search: no number of candidates.

The upper kd-tree is fitted on a bounded sample and gives cells; every row belongs to one cell, and a cell's rows are dealt
by hash into trees of about TREE_SIZE components. Queries lie in the shared folder in blocks of one cell each. They search
their own cell first, which bounds their k-th distance, and then the trees of all other cells whose boxes the test leaves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch, shared_dir, written

K = 5
#: Directions of the projection (an even number), and the seed they are drawn from.
M, SEED = 12, 20140901
#: The stopping test's probability that a true neighbour isn't missed.
CONFIDENCE = 0.95
#: Rows, by hash order, that the cells are fitted on; a cell has at least CELL_ROWS of them, so there are at most 64 cells.
SAMPLE_ROWS, CELL_ROWS = 2048, 32
#: Components of a tree's vectors, rows of its leaves, queries of a block, rows verified between two tests.
TREE_SIZE, LEAF_ROWS, QUERY_BLOCK, STEP = 1 << 20, 32, 1024, 64


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


def directions(n: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, m))


def split(points: np.ndarray, least: int) -> tuple[list, list[np.ndarray]]:
    """A kd-tree by medians of the widest axis: nested (axis, value, left, right) or a leaf's number, and the leaves' rows."""
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray):
        own = points[rows]
        spread = own.max(0) - own.min(0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        value = float(np.median(own[:, axis])) if len(rows) >= 2 * least else 0.0
        if len(rows) >= 2 * least and not (own[:, axis] < value).any():
            value = float(np.nextafter(value, np.inf))  # half of the rows are at the least value
        left = own[:, axis] < value if len(rows) >= 2 * least else np.zeros(0, bool)
        if not left.any() or left.all():  # too few rows, or all at one place
            leaves.append(rows)
            return len(leaves) - 1
        return [axis, value, grow(rows[left]), grow(rows[~left])]

    return grow(np.arange(len(points))), leaves


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    """The upper tree's leaf of each point."""
    out = np.zeros(len(points), np.int32)

    def go(node, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
        else:
            axis, value, left, right = node
            below = points[rows, axis] < value
            go(left, rows[below])
            go(right, rows[~below])

    go(tree, np.arange(len(points)))
    return out


@dataclass
class Vectors:
    """Vectors, their lengths and their projected directions. Each vector is scaled by a power of two, which no cosine notices."""

    ids: np.ndarray
    v: np.ndarray
    length: np.ndarray
    p: np.ndarray
    #: Single precision unit vectors, which tell what the exact cosine is needed of.
    unit: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray) -> Vectors:
        v = np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])
        length = np.sqrt((v * v).sum(1))
        unit = v / length[:, None]
        return cls(ids, v, length, unit @ directions(v.shape[1]), unit.astype(np.float32))

    def take(self, rows: np.ndarray | slice) -> Vectors:
        return Vectors(self.ids[rows], self.v[rows], self.length[rows], self.p[rows], self.unit[rows])


class Tree:
    """A kd-tree over the projections of some vectors, with the boxes of its leaves."""

    def __init__(self, rows: Vectors):
        _, leaves = split(rows.p, LEAF_ROWS)
        self.rows = rows.take(np.concatenate(leaves))
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([rows.p[x].min(0) for x in leaves])
        self.high = np.array([rows.p[x].max(0) for x in leaves])

    def boxes(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of each of the points p to each leaf."""
        out = np.zeros((len(p), len(self.low)))
        for a in range(p.shape[1]):
            x = p[:, a, None]
            out += np.square(np.maximum(np.maximum(self.low[:, a] - x, x - self.high[:, a]), 0))
        return out


class Search:
    """One query's k best so far (greatest cosine, then least id); floor: a cosine that k others are known to reach."""

    def __init__(self, query: Vectors, k: int, floor: float, stop: float):
        self.q, self.k, self.floor, self.stop = query, k, floor, stop
        self.scores, self.ids, self.verified = np.zeros(0), np.zeros(0, np.int64), 0

    def limit(self) -> float:
        """The squared projected distance at which the test holds."""
        least = max(self.scores[-1] if len(self.scores) == self.k else -2.0, self.floor)
        return np.inf if least <= -2 else self.stop * max(0.0, 2 - 2 * least + 1e-12)  # the slack covers a cosine's rounding

    def verify(self, rows: Vectors, at: np.ndarray) -> None:
        self.verified += len(at)
        least = max(self.scores[-1] if len(self.scores) == self.k else -2.0, self.floor)
        # the slack is far beyond the rounding of a product in single precision
        at = at[np.nonzero(rows.unit[at] @ self.q.unit[0] >= least - 1e-4)[0]]
        at = at[rows.ids[at] != self.q.ids[0]]
        if not len(at):
            return
        # sums along rows don't depend on the other rows, so equal vectors have equal scores
        scores = (rows.v[at] * self.q.v).sum(1) / (rows.length[at] * self.q.length[0])
        fine = scores >= self.floor
        s, i = np.concatenate([self.scores, scores[fine]]), np.concatenate([self.ids, rows.ids[at[fine]]])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]

    def run(self, tree: Tree, boxes: np.ndarray) -> None:
        """Takes the tree's rows in order of projected distance until the test holds.

        Leaves are opened in order of their boxes, ever more at a time; of the rows in open leaves, those nearer than the
        next leaf are next in the order. They are verified in runs that double, with a test before each.
        """
        order = np.argsort(boxes, kind="stable")
        near = boxes[order]
        waiting, far, opened, width, step = np.zeros(0, np.int64), np.zeros(0), 0, 1, STEP
        while True:
            limit = self.limit()
            if limit == np.inf or len(self.scores) < self.k and self.floor <= -2:
                width = max(1, min(width, 4))  # nothing is known of the k-th distance yet
            elif self.floor > -2:
                width = len(order)  # the bound is good: all leaves within it
            while opened < len(order) and near[opened] <= limit and not (len(far) and far[0] <= near[opened]):
                new = order[opened : min(opened + width, int(np.searchsorted(near, limit, side="right")))]
                rows = np.concatenate([np.arange(tree.starts[x], tree.starts[x + 1]) for x in new]) if len(new) < len(order) else np.arange(tree.starts[-1])
                waiting = np.concatenate([waiting, rows])
                far = np.concatenate([far, np.square(tree.rows.p[rows] - self.q.p).sum(1)])
                inside = far <= limit  # the limit only falls, so the others are out for good
                waiting, far = waiting[inside], far[inside]
                by = np.argsort(far, kind="stable")
                waiting, far, opened, width = waiting[by], far[by], opened + len(new), min(2 * width, 64)
            edge = near[opened] if opened < len(order) else np.inf
            n = min(step, int(np.searchsorted(far, min(edge, limit), side="right")))
            if not n:
                return  # the test holds for the nearest row that is left
            self.verify(tree.rows, waiting[:n])
            waiting, far, step = waiting[n:], far[n:], min(2 * step, 1024)


def usable(vectors: DataFrame) -> DataFrame:
    """Different (vec_id, v array<double>) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return vectors.where(fine).select(F.col("vec_id").cast("long"), e.alias("v")).distinct()


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, with zeros at the end of shorter ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of all other rows for each row whose vec_id is divisible by every.

    score is the cosine in double precision; ties go to the smaller vec_id. Rows with a null vec_id, and null, zero or empty
    vectors, or ones with a null or non-finite component, take no part. A shorter vector counts as one with zeros at its end.
    Rows equal in id and vector count once; rows that share the query's id count as its own; a query id with several
    vectors has the neighbours of each. Where fewer than k others exist, all are returned.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    points = scratch.written(usable(vectors), "points")
    width = points.agg(F.max(F.size("v"))).first()[0] or 1
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE_ROWS).toArrow()
    upper, _ = split(Vectors.of(sample["vec_id"].to_numpy(), _padded(sample["v"], width)).p, CELL_ROWS) if len(sample) else (0, [])

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(cell_of(upper, Vectors.of(np.zeros(len(v)), _padded(v, width)).p))

    celled = scratch.written(points.withColumn("cell", cell("v")), "cells")
    asks = F.col("vec_id") % every == 0
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("asking")).collect()  # at most SAMPLE_ROWS / CELL_ROWS

    def dealt(rows: DataFrame, count: str, most: int) -> DataFrame:
        parts = F.create_map(F.lit(-1), F.lit(1), *(F.lit(x) for r in sizes for x in (r["cell"], max(1, math.ceil(r[count] / most)))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), parts[F.col("cell")]).cast("int"))

    trees = dealt(celled, "n", max(1024, TREE_SIZE // width)).groupBy("cell", "salt")
    queries = celled.where(asks).withColumn("row", F.xxhash64("v"))

    def found(asked: DataFrame, own_cell: bool) -> DataFrame:
        blocks = _blocks(dealt(asked, "asking", QUERY_BLOCK), scratch)
        return scratch.written(trees.applyInArrow(_searcher(blocks, width, k, confidence, own_cell), FOUND), "found")

    own = found(queries.withColumn("floor", F.lit(-2.0)), True)
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))
    kth = own.withColumn("_n", place).where(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), "row", "score")
    bounded = queries.join(kth, ["vec_id", "row"], "left").withColumn("floor", F.coalesce("score", F.lit(-2.0))).drop("score")
    ranked = own.unionByName(found(bounded, False)).withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours")
    scratch.drop()
    return out


FOUND = "query_id long, row long, vec_id long, score double"


def _blocks(queries: DataFrame, scratch: Scratch) -> tuple[str, list[tuple[int, str]]]:
    """Writes queries(vec_id, v, row, floor, cell, salt) to the shared folder, a file for each cell and salt; the folder, and cell and path of each."""
    folder = shared_dir(queries.sparkSession, "query-blocks")
    scratch.paths.append(folder)

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        at, path = key[0].as_py(), f"{root}/{key[0].as_py():04d}-{key[1].as_py():08d}.queries"
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        with store.open_output_stream(path) as out:  # a task that runs again writes the same
            out.write(pickle.dumps([rows[c].combine_chunks() for c in ("vec_id", "v", "row", "floor")]))
        return pa.table({"cell": pa.array([at], pa.int32()), "path": [path]})

    made = queries.groupBy("cell", "salt").applyInArrow(write, "cell int, path string")
    return folder, sorted((r["cell"], r["path"]) for r in made.collect())  # a path for each block


def _searcher(blocks: tuple[str, list[tuple[int, str]]], width: int, k: int, confidence: float, own: bool):
    """Searches a tree for the queries of its own cell, or for those of all others."""
    folder, paths = blocks

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        store, _ = pafs.FileSystem.from_uri(folder)
        rows = rows.sort_by([("vec_id", "ascending")])
        tree, stop = Tree(Vectors.of(rows["vec_id"].to_numpy(), _padded(rows["v"], width))), quantile(confidence, M)
        out = [pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for cell, path in paths:
            if (cell == key[0].as_py()) != own:
                continue
            with store.open_input_stream(path) as stream:
                ids, v, row, floor = pickle.loads(stream.read())
            queries, row, floor = Vectors.of(ids.to_numpy(), _padded(v, width)), row.to_numpy(), floor.to_numpy()
            boxes = tree.boxes(queries.p)
            bound = np.where(floor > -2, stop * np.maximum(0, 2 - 2 * floor + 1e-12), np.inf)
            for i in np.nonzero(boxes.min(1) <= bound)[0]:
                one = Search(queries.take(slice(i, i + 1)), k, float(floor[i]), stop)
                one.run(tree, boxes[i])
                n = len(one.ids)
                out.append(pa.table({"query_id": np.repeat(queries.ids[i], n), "row": np.repeat(row[i], n), "vec_id": one.ids, "score": one.scores}))
        return pa.concat_tables(out)

    return run
