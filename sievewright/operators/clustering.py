"""Recursive clustering of embeddings by cosine: every cluster of a level is tried with every number of parts in the same passes.

Rows are unit vectors. Centroids are a model of at most (clusters of the level) x (1 + 2 + ... + most) vectors, which the
driver holds as it would for one k-means; rows are only ever read in tasks, which give sums for each centroid. A pass over
the rows is one job, so jobs grow with depth and steps, not with clusters or numbers of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import written

#: Passes that move the centroids before parts are judged.
STEPS = 8
#: Rows of each cluster, by hash order, that its first centroids are chosen from.
SEEDS = 64


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def apart(v: np.ndarray, most: int) -> np.ndarray:
    """Rows far from each other: the one nearest to the mean, then each time the one farthest from all taken; different ones only."""
    taken = [int((v @ v.mean(0)).argmax())]
    near = v @ v[taken[0]]
    while len(taken) < most and near.min() < 1 - 1e-9:
        taken.append(int(near.argmin()))
        near = np.maximum(near, v @ v[taken[-1]])
    return v[taken]


def _assigned(v: np.ndarray, centroids: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each number of parts, the part of each row: that of the nearest centroid, the first one of equals."""
    return {k: (v @ c.T).argmax(1) for k, c in centroids.items()}


def _by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(path, places in the batch, unit vectors), batch by batch."""
    for batch in batches:
        paths, v = np.array(batch.column("path").to_pylist(), object), _matrix(batch.column("v"))
        for path in np.unique(paths):
            at = np.nonzero(paths == path)[0]
            yield path, at, v[at]


def _sums(rows: DataFrame, model: dict[str, dict[int, np.ndarray]]) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each path and number of parts: the sum and the count of the vectors of each part. One job."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for path, _, v in _by_path(batches):
            for k, part in _assigned(v, sent.value.get(path, {})).items():
                for j in np.unique(part):
                    own = v[part == j]
                    found[path, k, int(j)] = found.get((path, k, int(j)), 0) + np.append(own.sum(0), len(own))
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in keys], "k": pa.array([x[1] for x in keys], pa.int32()), "j": pa.array([x[2] for x in keys], pa.int32()), "s": [found[x] for x in keys]})

    parts = rows.select("path", "v").mapInArrow(run, "path string, k int, j int, s array<double>")
    each = parts.select("path", "k", "j", F.posexplode("s").alias("d", "x")).groupBy("path", "k", "j", "d").agg(F.sum("x").alias("x"))
    out: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for r in each.groupBy("path", "k", "j").agg(F.array_sort(F.collect_list(F.struct("d", "x")))["x"].alias("s")).collect():  # a row a centroid
        sums, counts = out.setdefault(r["path"], {}).setdefault(r["k"], (np.zeros_like(model[r["path"]][r["k"]]), np.zeros(r["k"])))
        sums[r["j"]], counts[r["j"]] = r["s"][:-1], r["s"][-1]
    return out


def silhouettes(v: np.ndarray, part: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cosine silhouette of rows, exactly: the mean distance to a part's rows is 1 less the product with the part's sum by its count."""
    own = counts[part]
    products = v @ sums.T
    mine = products[np.arange(len(v)), part]
    a = (own - mine) / np.maximum(own - 1, 1)  # its distance to itself is 0
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.where(counts > 0, 1 - products / counts, np.inf)
    other[np.arange(len(v)), part] = np.inf
    b = other.min(1)
    most = np.maximum(a, b)
    fine = (own > 1) & np.isfinite(b) & (most > 0)
    return np.where(fine, (b - a) / np.where(fine, most, 1), 0.0)


def _judged(rows: DataFrame, model: dict, sums: dict) -> dict[str, dict[int, float]]:
    """Mean silhouette of each path and number of parts. One job."""
    sent = rows.sparkSession.sparkContext.broadcast((model, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[float]] = {}
        for path, _, v in _by_path(batches):
            centroids, of = sent.value
            for k, part in _assigned(v, centroids.get(path, {})).items():
                s = silhouettes(v, part, *of[path][k])
                total = found.setdefault((path, k), [0.0, 0.0])
                total[0], total[1] = total[0] + float(s.sum()), total[1] + len(s)
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in keys], "k": pa.array([x[1] for x in keys], pa.int32()), "s": [found[x][0] for x in keys], "n": [found[x][1] for x in keys]})

    means = rows.select("path", "v").mapInArrow(run, "path string, k int, s double, n double").groupBy("path", "k").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    out: dict[str, dict[int, float]] = {}
    for r in means:
        out.setdefault(r["path"], {})[r["k"]] = r["mean"]
    return out


def recursive_clusters(vectors: DataFrame, item: str = "vec_id", column: str = "embedding", most: int = 8, least_rows: int = 20, depth: int = 2, seed: int = 7, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(item, cluster) and (cluster, k, silhouette, n) of every cluster that was split.

    A cluster is a path like 2.0. Of 2 to `most` parts, those with the best mean cosine silhouette are taken if it is
    positive, and each part of at least `least_rows` rows is tried again, down to `depth`. Centroids begin far from each
    other, at rows among SEEDS that a hash of item and seed chooses in each cluster. What can't be split at all is cluster 0, as are vectors without a
    direction (null, zero, empty, or with a null or non-finite component). Vectors of the most frequent length count; the
    others have no direction either.
    """
    spark = vectors.sparkSession
    e = F.col(column).cast("array<double>")
    fine = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda t, x: t + x * x))
    unit = vectors.select(F.col(item).alias("item"), F.when(fine, F.transform(e, lambda x: x / length)).alias("v"), F.lit("").alias("path"))
    sizes = unit.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    usable = F.coalesce(F.size("v") == (sizes["d"] if sizes else 0), F.lit(False))
    rows = written(spark, unit.where(usable), "vectors")
    rest = unit.where(~usable).select("item", F.lit("0").alias("cluster"))
    done, splits = rest, []
    for _ in range(depth):
        counts = {r["path"]: r["n"] for r in rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, least_rows)).collect()}  # clusters of the level
        if not counts:
            break
        place = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("item", F.lit(seed)), "v"))
        begin: dict[str, list] = {}
        for r in rows.withColumn("_n", place).where(F.col("_n") <= SEEDS).orderBy("path", "_n").collect():
            if r["path"] in counts:
                begin.setdefault(r["path"], []).append(r["v"])
        starts = {p: apart(np.array(v), most) for p, v in begin.items()}
        model = {p: {k: v[:k].copy() for k in range(2, len(v) + 1)} for p, v in starts.items()}
        for _ in range(steps):
            for path, by_k in _sums(rows, model).items():
                for k, (sums, n) in by_k.items():
                    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                    model[path][k] = np.where((n[:, None] > 0) & (norm > 0), sums / np.maximum(norm, 1e-300), model[path][k])
        judged = _judged(rows, model, _sums(rows, model))
        best = {p: max(by_k.items(), key=lambda x: (x[1], -x[0])) for p, by_k in judged.items()}
        chosen = {p: {k: model[p][k]} for p, (k, value) in best.items() if value > 0}
        splits += [(p or "all", k, float(value), counts[p]) for p, (k, value) in best.items() if value > 0]
        if not chosen:
            break
        now = written(spark, _split(rows, chosen), "vectors")
        done = done.unionByName(now.where("NOT split").select("item", F.when(F.col("path") == "", "0").otherwise(F.col("path")).alias("cluster")))
        rows = now.where("split").drop("split")
    out = done.unionByName(rows.select("item", F.when(F.col("path") == "", "0").otherwise(F.col("path")).alias("cluster")))
    return out.withColumnRenamed("item", item), spark.createDataFrame(splits, "cluster string, k int, silhouette double, n long")


def _split(rows: DataFrame, chosen: dict[str, dict[int, np.ndarray]]) -> DataFrame:
    """rows with the paths of their parts; split: whether their cluster was split."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)

    @F.arrow_udf("string")
    def part(path: pa.Array, v: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([path, v], ["path", "v"]), np.full(len(path), None, object)
        for p, at, own in _by_path(iter([batch])):
            for label in _assigned(own, sent.value.get(p, {})).values():
                out[at] = [f"{p}.{j}".lstrip(".") for j in label]
        return pa.array(out, pa.string())

    return rows.withColumn("_new", part("path", "v")).select("item", "v", F.coalesce("_new", "path").alias("path"), F.col("_new").isNotNull().alias("split"))
