"""Selections by other tables: seen and unseen, cited and dangling, done and to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import word_set


def selected_units(units: DataFrame, batch: DataFrame, unit: str = "unit_id") -> DataFrame:
    return units.join(batch.select(unit), unit, "left_semi")


def unseen_first(candidates: DataFrame, history: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Candidates whose key isn't in the history; of each group the first one."""
    new = candidates.join(history.select(key).distinct(), key, "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("_n = 1").drop("_n")


def to_do(calls: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Calls that the ledger doesn't have: what a resumed run still has to do."""
    return calls.join(ledger.select(key).distinct(), key, "left_anti")


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def citation_grounding(citations: DataFrame, chunks: DataFrame, least: float = 0.0) -> DataFrame:
    """citations(item, chunk_id, text) with overlap, the share of the citation's words that the chunk has, if at least `least`."""
    c = chunks.select("chunk_id", word_set(F.col("text")).alias("_chunk"))
    own = word_set(F.col("text"))
    share = F.size(F.array_intersect("_own", "_chunk")).cast("double") / F.size("_own")
    out = citations.withColumn("_own", own).join(c, "chunk_id").withColumn("overlap", F.when(F.size("_own") > 0, share).otherwise(0.0))
    return out.where(F.col("overlap") >= least).drop("_own", "_chunk")


def dangling_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    return citations.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def backlinks(keys: DataFrame, edges: DataFrame, key: str, target: str) -> DataFrame:
    """keys with the number of edges to them, 0 if none."""
    n = edges.groupBy(F.col(target).alias(key)).agg(F.count("*").alias("n"))
    return keys.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def subcategories(spark, edges: DataFrame, root: str) -> DataFrame:
    """All categories below root in edges(category, parent_category), by level; cycles end."""
    from sievewright.operators.trees import below

    return below(edges, root)
