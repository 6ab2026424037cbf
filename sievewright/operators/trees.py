"""Category trees of any depth: who is above whom, accuracy of whole subtrees, the lowest subtrees that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.evaluation import wilson
from sievewright.session import written


def closure(edges: DataFrame, node: str = "category", parent: str = "parent_category") -> DataFrame:
    """(node, ancestor, level): everything above each node, level 1 being its parents.

    A round a level: what the last one found is joined to the edges, and pairs that are known are left out, so a cycle ends by
    itself; its nodes are below each other, never below themselves. Where several ways lead up, level is that of the
    shortest. Nulls and loops make no edge. Rows are linear in nodes times depth.
    """
    spark = edges.sparkSession
    up = edges.select(F.col(node).alias("node"), F.col(parent).alias("above")).where("node IS NOT NULL AND above IS NOT NULL AND node <> above").distinct()
    up = written(spark, up, "edges")
    last = up.select("node", F.col("above").alias("ancestor"))
    known, level = written(spark, last.withColumn("level", F.lit(1)), "levels"), 1
    parts = [known]
    while True:
        level += 1
        reached = parts[-1].join(up.withColumnRenamed("node", "_n"), F.col("ancestor") == F.col("_n")).select("node", F.col("above").alias("ancestor")).where("node <> ancestor").distinct()
        fresh = written(spark, reached.join(known, ["node", "ancestor"], "left_anti").withColumn("level", F.lit(level)), "levels")
        if fresh.isEmpty():
            return known
        parts.append(fresh)
        known = known.unionByName(fresh)


def below(edges: DataFrame, root: str, node: str = "category", parent: str = "parent_category") -> DataFrame:
    """(category, level): all below a root, level 1 being its children. Only what lies below it is visited; the root isn't below itself."""
    spark = edges.sparkSession
    down = edges.select(F.col(node).alias("category"), F.col(parent).alias("above")).where(F.col("category").isNotNull() & (F.col("category") != root)).distinct()
    now = written(spark, down.where(F.col("above") == root).select("category").distinct().withColumn("level", F.lit(1)), "below")
    known, level = now, 1
    while not now.isEmpty():
        level += 1
        children = down.join(now.select(F.col("category").alias("above")), "above", "left_semi").select("category").distinct()
        now = written(spark, children.join(known, "category", "left_anti").withColumn("level", F.lit(level)), "below")
        known = known.unionByName(now)
    return known


def rolled_up(edges: DataFrame, results: DataFrame, node: str = "category", parent: str = "parent_category", correct: str = "is_correct") -> DataFrame:
    """(node, n, correct, accuracy, low, high) of every node of edges and of results(node, correct): all results of its subtree, with Wilson's bounds.

    Results are counted a node first; what is joined to the closure are counts. A result counts once in a node, however many
    ways lead up to it. A node without results below has n 0 and no shares; null nodes are left out, null outcomes count as wrong.
    """
    own = results.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0)).alias("correct"))
    above = closure(edges, node, parent).select("node", "ancestor")
    nodes = edges.select(F.col(node).alias("node")).union(edges.select(F.col(parent))).union(own.select("node")).where("node IS NOT NULL").distinct()
    pairs = above.unionByName(nodes.select("node", F.col("node").alias("ancestor")))
    sums = pairs.join(own, "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    some = F.col("n") > 0
    return sums.withColumns({"accuracy": F.when(some, F.col("correct") / F.col("n")), "low": F.when(some, low), "high": F.when(some, high)})


def lowest_failing(edges: DataFrame, scores: DataFrame, threshold: float, node: str = "category", parent: str = "parent_category") -> DataFrame:
    """Rows of rolled_up() whose upper bound is below the threshold and that have no such node below them: where the weakness lies, and not what it drags down.
    Nodes of a cycle are below each other: of failing ones the least counts."""
    failing = written(scores.sparkSession, scores.where(F.col("high") < threshold), "failing")
    pairs = closure(edges, node, parent).select("node", "ancestor")
    mutual = pairs.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"), F.lit(True).alias("_both"))
    inner = pairs.join(failing.select("node"), "node", "left_semi").join(mutual, ["node", "ancestor"], "left").where(F.col("_both").isNull() | (F.col("node") < F.col("ancestor")))
    return failing.join(inner.select(F.col("ancestor").alias("node")).distinct(), "node", "left_anti")
