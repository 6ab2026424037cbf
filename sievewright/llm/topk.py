"""Exact top-k inner products by elimination with a pivot table.

|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a lower bound of the distance is an upper bound of the score. The table holds every
row's distances to the pivots, is written once, and lies in the order of the nearest pivot and the distance to it. Blocks
of rows have a range of distances to each pivot; the largest gap between a query's distances and these ranges bounds the
whole block. In blocks that are left, a row's distances fix its place in the pivots' span and how far it is from that
span, and the distance of these is the largest lower bound that the distances to all pivots allow. Candidates are
evaluated in the order of their bounds, until no bound left can reach the k-th best score so far; nothing is missed.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch, shared_dir, written

SCALE = 256
K = 5
#: Pivots for each 64 components of a vector. The bounds cost as many products of numbers a pair.
PIVOTS = 48
#: Queries lie in the shared folder in blocks of about this many; a task holds one block at a time.
QUERY_BLOCK = 1024
#: Rows that pivots and the first k-th best scores are taken from; only a head start, no row is left out.
SEED_ROWS = 2048
#: Candidates that a task holds; that one range of distances stands for; that are evaluated first for each query.
HELD = 65_536
BLOCK_ROWS = 128
STEP = 16
#: Queries that are bounded at a time; they lie in the table's order, so they leave much the same blocks.
TOGETHER = 32
#: Whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)
LOW = np.iinfo(np.int64).min


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) with v = floor(SCALE * x); rows with a null or non-finite component, or no vector, are left out."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(e, lambda x: F.floor((x * SCALE).cast("double")).cast("double")).alias("v"))


class Pivots:
    """Rows far from each other, each the farthest from the span of those before it, and that span."""

    def __init__(self, v: np.ndarray, n: int):
        rest, basis, points = v.copy(), [], []
        while len(basis) < min(n, *v.shape) and np.isfinite(rest).all() and (square := (rest * rest).sum(1)).max(initial=0) > 1e-6:
            axis = rest[square.argmax()] / math.sqrt(square.max())
            points.append(v[square.argmax()])
            basis.append(axis)
            rest = rest - np.outer(rest @ axis, axis)
        self.basis, self.points = (np.array(a).reshape(len(basis), v.shape[1]) for a in (basis, points))

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * (x @ self.points.T)
        return np.sqrt(np.maximum(square, 0))


class Rows(NamedTuple):
    """Rows of one length with distances to pivots, place in the pivots' span, distance from the span, length."""

    ids: np.ndarray
    v: np.ndarray
    far: np.ndarray
    place: np.ndarray
    off: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, v: np.ndarray, far: np.ndarray, pivots: Pivots) -> Rows:
        place, square = v @ pivots.basis.T, (v * v).sum(1)
        return Rows(ids, v, far, place, np.sqrt(np.maximum(square - (place * place).sum(1), 0)), np.sqrt(square))

    def part(self, some: slice) -> Rows:
        return Rows(*[a[some] for a in self])


def starts(x: Rows, most: int) -> np.ndarray:
    """Where runs of rows of one nearest pivot begin, and again after each `most` rows of a run."""
    cell = x.far.argmin(1) if x.far.shape[1] else np.zeros(len(x.ids), int)
    place = np.arange(len(cell))
    first = np.maximum.accumulate(np.where(np.diff(cell, prepend=-1) != 0, place, 0))
    return np.nonzero((place - first) % most == 0)[0]


class Ranges(NamedTuple):
    """Of blocks of rows: least and largest distance to each pivot, largest length."""

    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(x: Rows, starts: np.ndarray) -> Ranges:
        return Ranges(np.minimum.reduceat(x.far, starts), np.maximum.reduceat(x.far, starts), np.maximum.reduceat(x.norm, starts))


def block_bounds(q: Ranges, x: Ranges, reach: float) -> np.ndarray:
    """For each block of q and of x, what no score of their rows is above. reach is the largest length of a pivot."""
    gap = np.maximum(x.low[None] - q.high[:, None], q.low[:, None] - x.high[None]).max(axis=2, initial=0)
    # the slacks cover the rounding of distances and lengths
    gap = np.maximum(gap - 1e-6 * (q.norm[:, None] + x.norm + reach), 0)
    squares = q.norm[:, None] ** 2 + x.norm**2
    upper = (squares * (1 + 1e-9) - gap**2) / 2 + 1
    return np.where(np.isfinite(upper), upper, np.inf)


def score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, as int64; saturated where int64 can't hold them."""
    if len(q) == 0 or len(x) == 0 or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < EXACT:
        return np.rint(q @ x.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in x], object).reshape(x.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, vec_id) so far of each of a block of queries; scores below floor don't count."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)

    def limit(self, row: int) -> float:
        """What a score must reach to matter: the k-th best, or the head start; minus infinity where anything does."""
        least = max(self.scores[row][-1] if len(self.scores[row]) == self.k else LOW, self.floor[row])
        return -np.inf if least == LOW else float(least)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        real = (ids != self.ids[row]) & (scores >= self.floor[row])
        s, i = np.concatenate([self.scores[row], scores[real]]), np.concatenate([self.found[row], ids[real]])
        order = np.lexsort((i, ~s))[: self.k]
        self.scores[row], self.found[row] = s[order], i[order]


class Candidates(NamedTuple):
    """Rows in the table's order, the block of each, and the blocks' ranges."""

    x: Rows
    block: np.ndarray
    ranges: Ranges

    @staticmethod
    def of(x: Rows) -> Candidates:
        at = starts(x, BLOCK_ROWS)
        return Candidates(x, np.repeat(np.arange(len(at)), np.diff(at, append=len(x.ids))), Ranges.of(x, at))


def search(q: Rows, best: Best, candidates: Candidates, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Adds candidates to best; returns how many were bounded one by one, and how many inner products were taken, for each query."""
    x, block, ranges = candidates
    bounded, taken = np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), np.int64)
    at = starts(q, TOGETHER)
    for first, end in zip(at, np.append(at[1:], len(q.ids))):
        some = q.part(slice(first, end))
        limits = np.array([best.limit(row) for row in range(first, end)])
        live = block_bounds(Ranges(some.far, some.far, some.norm), ranges, reach) >= limits[:, None]
        rows = np.nonzero(live.any(0)[block])[0]
        if len(rows) == 0:
            continue
        upper = some.place @ x.place[rows].T + some.off[:, None] * x.off[rows] + 1e-6 * (some.norm[:, None] * x.norm[rows] + 1)
        upper[~np.isfinite(upper)] = np.inf  # squares beyond a double bound nothing
        upper[~live[:, block[rows]]] = -np.inf
        bounded[first:end] += len(rows)
        for row, u in zip(range(first, end), upper):
            left = np.nonzero(u >= best.limit(row))[0]
            order, done, width = left[np.argsort(-u[left], kind="stable")], 0, STEP
            while done < len(order) and u[order[done]] >= best.limit(row):
                chosen = rows[order[done : done + width]]
                best.add(row, score(q.v[row : row + 1], x.v[chosen])[0], x.ids[chosen])
                taken[row] += len(chosen)
                done, width = done + width, width * 2
    return bounded, taken


def _matrix(batch: pa.RecordBatch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, ids and vectors of a batch by their number of components."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    ids, flat = batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes):
        rows = np.nonzero(sizes == n)[0]
        out[int(n)] = rows, ids[rows], flat[(starts[rows][:, None] + np.arange(n)[None]).ravel()].reshape(len(rows), n)
    return out


TABLE = "vec_id long, v array<double>, far array<double>, dim int, cell int, near double"
BLOCK = "path string, row array<long>, bounded array<long>, evaluated array<long>"
FOUND = "query_id long, row long, vec_id long, score long, bounded long, evaluated long"


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), pa.float64()))


def pivot_table(vectors: DataFrame, pivots: dict[int, Pivots], scratch: Scratch) -> DataFrame:
    """vectors(vec_id, v) with distances to the pivots of its length, the nearest pivot (cell) and the distance to it, written in that order; equal distances are spread by id."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, v in _matrix(batch, 1).values():
                known = sent.value.get(v.shape[1])
                far = known.distances(v) if known else np.zeros((len(v), 0))
                cell = far.argmin(1) if far.shape[1] else np.full(len(v), -1)
                near = far.min(1, initial=np.inf) if far.shape[1] else np.zeros(len(v))
                columns = [pa.array(ids, pa.int64()), _lists(v), _lists(far), pa.array(np.full(len(v), v.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "far", "dim", "cell", "near"])

    order = ["dim", "cell", "near", F.xxhash64("vec_id")]
    rows = vectors.select("vec_id", "v").mapInArrow(run, TABLE)
    n = max(vectors.sparkSession.sparkContext.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch.written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), "pivot-table")


def _rows(batches: list[pa.RecordBatch], pivots: dict[int, Pivots]) -> dict[int, tuple[np.ndarray, Rows, float]]:
    """By number of components: the third column, the rows, and the largest length of a pivot."""
    out: dict[int, list] = {}
    for batch in batches:
        far = {n: (at, d) for n, (at, _, d) in _matrix(batch, 3).items()}
        place = {int(r): (n, k) for n, (at, _) in far.items() for k, r in enumerate(at)} if len(far) > 1 else None
        for dim, (at, ids, v) in _matrix(batch, 1).items():
            if place is None:
                d = next(iter(far.values()))[1][at]
            else:
                n = place[int(at[0])][0]  # rows of one length have equally many pivots
                d = far[n][1][[place[int(r)][1] for r in at]]
            out.setdefault(dim, []).append((batch.column(2).to_numpy(zero_copy_only=False)[at], ids, v, d))
    result = {}
    for dim, parts in out.items():
        third, ids, v, d = (np.concatenate([p[k] for p in parts]) for k in range(4))
        known = pivots.get(dim) or Pivots(v[:0], 0)
        result[dim] = third, Rows.of(ids, v, d, known), float(np.sqrt((known.points**2).sum(1)).max(initial=0))
    return result


def query_blocks(queries: DataFrame, seeds: dict[int, tuple[Rows, Pivots]], k: int, folder: str, scratch: Scratch) -> DataFrame:
    """Writes queries(vec_id, v, row, far) to the shared folder, a file for each partition, with the k-th best score among the seeds.

    A file begins with the ranges of its queries, so that a task can pass over the rest. Returns a written table of BLOCK.
    """
    sent = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, block, counts = {}, {}, []
        for dim, (rows, q, reach) in _rows(list(batches), {d: p for d, (_, p) in sent.value.items()}).items():
            floor, bounded, taken = np.full(len(rows), LOW), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            if dim in sent.value:
                x = sent.value[dim][0]
                start = Best(q.ids, k, floor)
                bounded, taken = search(q, start, Candidates.of(x), reach)
                floor = np.array([s[-1] if len(s) == k else LOW for s in start.scores])
            head[dim], block[dim] = (Ranges.of(q, starts(q, len(rows))), int(floor.min())), (rows, q, floor)
            counts.append((rows, bounded, taken))
        if block:
            store, root = pafs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            path = f"{root}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.queries"
            first = pickle.dumps(head)
            with store.open_output_stream(path) as out:
                out.write(struct.pack("<q", len(first)) + first)
                out.write(pickle.dumps(block))
            row, bounded, taken = (np.concatenate([c[i] for c in counts]).tolist() for i in range(3))
            yield pa.RecordBatch.from_pydict({"path": [path], "row": [row], "bounded": [bounded], "evaluated": [taken]})

    return scratch.written(queries.select("vec_id", "v", "row", "far").mapInArrow(run, BLOCK), "blocks")


def top_k(vectors: DataFrame, every: int = 50, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, row, rank, vec_id, score, bounded, evaluated): the k best of all other rows for each row whose vec_id is divisible by every.

    Ties go to the smaller vec_id. Rows with a null vec_id or vector, or a null or non-finite component, take no part.
    Vectors of another length than the query's are no candidates of it. Rows that share the query's id are its own;
    other repeated rows are candidates each. Scores beyond long are saturated. row tells repeated query rows apart.
    bounded, evaluated: candidates bounded one by one, and inner products taken, for the row in all, the seeds' too.
    A task passes over files of queries that none of its candidates can serve, and over blocks of candidates; it returns
    rows for a query only where they reach the k-th best score among the seeds. No query passes through the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    plain = scratch.written(scaled(vectors), "vectors")
    head: dict[int, list] = {}
    for r in plain.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SEED_ROWS).collect():
        head.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
    seeds = {}
    for dim, rows in head.items():
        v = np.array([x for _, x in rows], float).reshape(len(rows), dim)
        known = Pivots(v, math.ceil(pivots * dim / 64))
        far = known.distances(v)
        order = np.lexsort((far.min(1, initial=np.inf), far.argmin(1) if far.shape[1] else np.zeros(len(v))))  # that of the table
        seeds[dim] = Rows.of(np.array([i for i, _ in rows])[order], v[order], far[order], known), known
    known = {dim: p for dim, (_, p) in seeds.items()}
    table = pivot_table(plain, known, scratch)
    queries = scratch.written(table.where(F.col("vec_id") % every == 0).withColumn("row", F.monotonically_increasing_id()), "queries")
    n = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    order = ["dim", "cell", "near", "row"]
    folder = shared_dir(spark, "query-blocks")
    blocks = query_blocks(queries.repartitionByRange(n, *order).sortWithinPartitions(*order), seeds, k, folder, scratch)
    paths = sorted(r["path"] for r in blocks.select("path").collect())  # a path for each block
    sent = spark.sparkContext.broadcast((paths, known))
    found = scratch.written(table.select("vec_id", "v", F.lit(0).cast("long").alias("none"), "far").mapInArrow(_searcher(sent, k, folder), FOUND), "found")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    real = found.where("vec_id IS NOT NULL")
    ranked = real.select("query_id", "row", "vec_id", "score", F.row_number().over(best).cast("int").alias("rank")).where(F.col("rank") <= k)
    starts = blocks.select(F.inline(F.arrays_zip("row", "bounded", "evaluated")))
    counts = starts.unionByName(found.where("vec_id IS NULL").select("row", "bounded", "evaluated")).groupBy(F.col("row").alias("_row")).agg(F.sum("bounded").alias("bounded"), F.sum("evaluated").alias("evaluated"))
    result = written(ranked.join(counts, ranked["row"] == counts["_row"]).select("query_id", "row", "rank", "vec_id", "score", "bounded", "evaluated"), "nearest")
    scratch.paths.append(folder)
    scratch.drop()
    return result


def _searcher(sent, k: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, pivots = sent.value
        store, _ = pafs.FileSystem.from_uri(folder)
        names = [c.split(" ")[0] for c in FOUND.split(", ")]

        def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = {dim: (Candidates.of(x), reach) for dim, (_, x, reach) in _rows(held, pivots).items()}
            for path in paths:
                with store.open_input_stream(path) as stream:
                    head = pickle.loads(stream.read(struct.unpack("<q", stream.read(8))[0]))
                    open_dims = [d for d, (ranges, least) in head.items() if d in mine and (least == LOW or (block_bounds(ranges, mine[d][0].ranges, mine[d][1]) >= float(least)).any())]
                    if not open_dims:
                        continue
                    block = pickle.loads(stream.read())
                for dim in open_dims:
                    rows, q, floor = block[dim]
                    best = Best(q.ids, k, floor)
                    bounded, taken = search(q, best, *mine[dim])
                    sizes = [len(s) for s in best.scores]
                    nought = np.zeros(sum(sizes), np.int64)
                    each = [np.repeat(q.ids, sizes), np.repeat(rows, sizes), np.concatenate(best.found), np.concatenate(best.scores), nought, nought]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in each], names)
                    seen = np.nonzero(bounded)[0]
                    none = pa.nulls(len(seen), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[seen], pa.int64()), pa.array(rows[seen], pa.int64()), none, none, pa.array(bounded[seen]), pa.array(taken[seen])], names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield from against(held)
                held, size = [], 0
        if held:
            yield from against(held)

    return run


def top_k_sql(every: int = 50, k: int = K) -> str:
    """DuckDB SQL for the digest columns over the view embeddings."""
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM e q JOIN e x ON q.vec_id % {every} = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {k}"""
