"""Clusters by level against all pairs, and operators with nearly all rows on one key against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import clustering, evaluation, planning


def nested(seed=3):
    """Three far groups, the first of two nearer ones."""
    r = np.random.default_rng(seed)
    eye = np.eye(12)
    centres = [eye[0] + 0.6 * eye[5], eye[0] - 0.6 * eye[5], eye[1], eye[2]]
    return [(i, (centres[i % 4] * r.uniform(0.5, 4) + 0.05 * r.normal(size=12)).tolist()) for i in range(240)]


def test_levels_and_exact_silhouettes(spark, tmp_path):
    import duckdb

    rows = nested()
    df = spark.createDataFrame(rows + [(900, None), (901, [0.0] * 12), (902, [1.0]), (903, [float("nan")] * 12)], "vec_id long, embedding array<double>")
    first = {r["vec_id"]: r["cluster"] for r in clustering.recursive_clusters(df, most=5, least_rows=20, depth=1)[0].collect()}
    assert len(first) == 244 and {first[i] for i in range(900, 904)} == {"0"}
    assert len({first[i] for i in range(240)}) == 4 and all(first[i] == first[i % 4] for i in range(240))
    found, splits = clustering.recursive_clusters(df, most=5, least_rows=20, depth=2)
    got = {r["vec_id"]: r["cluster"] for r in found.collect()}
    assert all(got[i].split(".")[0] == first[i] for i in range(240))
    c = duckdb.connect()
    made = splits.collect()
    assert {r["cluster"] for r in made} > {"all"}
    for split in made:
        at = 0 if split["cluster"] == "all" else 1
        members = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), got[i].split(".")[at]) for i, v in rows if at == 0 or got[i].startswith(split["cluster"] + ".")]
        c.execute("CREATE OR REPLACE TABLE m (id INT, v DOUBLE[], c VARCHAR)")
        c.executemany("INSERT INTO m VALUES (?, ?, ?)", members)
        exact = c.execute("""WITH d AS (SELECT x.id, x.c, y.c AS o, 1 - list_inner_product(x.v, y.v) AS d FROM m x JOIN m y ON x.id <> y.id), a AS (SELECT id, c, o, avg(d) AS d FROM d GROUP BY ALL),
            s AS (SELECT id, max(d) FILTER (o = c) AS own, min(d) FILTER (o <> c) AS other FROM a GROUP BY id) SELECT avg(coalesce((other - own) / greatest(own, other), 0)) FROM s""").fetchall()[0][0]
        assert abs(exact - split["silhouette"]) < 1e-9 and split["n"] == len(members) and split["k"] == len({m[2] for m in members})


def test_clusters_that_cannot_be_split(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    found, splits = clustering.recursive_clusters(same)
    assert {r["cluster"] for r in found.collect()} == {"0"} and splits.count() == 0
    for df in (same.limit(0), same.limit(3)):
        out = evaluation.clusters_by_silhouette(df)
        assert out.count() == df.count() and out.where("cluster <> '0'").count() == 0


def test_jobs_do_not_grow_with_clusters(spark):
    """Twice the clusters of the second level take as many jobs."""
    def jobs(k):
        r = np.random.default_rng(k)
        rows = [(i, (np.eye(16)[i % k] + 0.3 * np.eye(16)[8 + i // k % 2] + 0.02 * r.normal(size=16)).tolist()) for i in range(60 * k)]
        group = f"clusters-{k}"
        spark.sparkContext.setJobGroup(group, group)
        clustering.recursive_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=4, steps=3)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert abs(jobs(2) - jobs(4)) <= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_ewma_of_a_hot_key(spark, seed):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), i, r.choice([0.0, 1.0, 5.5])) for i in range(3000)] + [("null", 1, None), ("null", 2, 1.0)]
    want = {}
    for k, _, x in rows:
        want[k] = None if x is None or want.get(k, 0) is None else 0.3 * x + 0.7 * want.get(k, 0.0)
    r.shuffle(rows)
    got = {x["k"]: x["ewma"] for x in planning.ewma(spark.createDataFrame(rows, "k string, at int, x double"), "k", "at", "x").collect()}
    assert got.keys() == want.keys() and all(got[k] is None if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lists_of_a_hot_key(spark):
    rows = [("hot" if i % 10 else None, i % 2 == 0 if i % 7 else None, i) for i in range(2000)]
    want = {}
    for by, ok, i in rows:
        want.setdefault((by, ok), []).append(i)
    out = evaluation.listed_by_outcome(spark.createDataFrame(rows, "by string, ok boolean, id int"), "by", "ok", "id", page=64).collect()
    got = {}
    for x in sorted(out, key=lambda x: x["page"]):
        ids = [int(i) for i in x["items"].split(",")]
        assert len(ids) <= 64 and (len(ids) == 64 or x["page"] == len(want[x["by"], x["ok"]]) // 64)
        got.setdefault((x["by"], x["ok"]), []).extend(ids)
    assert got == want
    assert spark.range(3).select(F.lit(1).alias("by"), F.lit(True).alias("ok"), "id").transform(lambda d: evaluation.listed_by_outcome(d, "by", "ok", "id")).first()["items"] == "0,1,2"
