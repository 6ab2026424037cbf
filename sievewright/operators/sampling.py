"""Samples that are the same whatever the partitioning: order by hashes, or by exponential races for weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import hash32, race_key

SEED = 42


def sample_per_group(df: DataFrame, group: str, item: str, kind: str, value: float, seed: int = SEED) -> DataFrame:
    """kind 'percentage': int(n * value) rows of each group; 'count': int(value) at most; else all."""
    if kind not in ("percentage", "count"):
        return df
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash32(F.lit(seed), F.col(item)), item))
    n = F.count("*").over(Window.partitionBy(group))
    k = F.floor(n * F.lit(float(value))).cast("long") if kind == "percentage" else F.lit(int(value))
    return df.withColumns({"_place": place, "_k": k}).where("_place <= _k").drop("_place", "_k")


def mode_score(mode: str) -> Column:
    return F.col("mcq_score" if mode == "multiple_choice" else "qa_score")


def broad_weight(mode: str, difficulty: str) -> Column:
    """The mode's score, for hard 0.7 of it and 0.3 of the hard score, over one plus earlier uses."""
    s = mode_score(mode)
    s = s * 0.7 + F.col("hard_score") * 0.3 if difficulty == "hard" else s
    return s / (F.col("usage_count") + 1)


def gap_weight(mode: str, difficulty: str) -> Column:
    """1.3 times the mode's score; hard: half of that and 1.5 of the hard score, and for multi units 1.4 and 1.5 times; easy: 0.8 times."""
    s = mode_score(mode) * 1.3
    if difficulty == "hard":
        s = s * 0.5 + F.col("hard_score") * 1.5
        s = F.when(F.col("unit_type") == "multi", s * 1.4 * 1.5).otherwise(s)
    elif difficulty == "easy":
        s = s * 0.8
    return s / (F.col("usage_count") + 1)


def weighted_sample(units: DataFrame, weight: Column, k: int, group: str = "topic", item: str = "unit_id", seed: int = SEED) -> DataFrame:
    """min(k, n) units of each group without replacement, as successive draws by weight; weight 0 comes last, by equal draws.

    One window with a limit: of each group only the k best rows of every task are shuffled.
    """
    w = F.round(weight, 9)
    draw = hash32(F.lit(seed), F.col(item))
    best = Window.partitionBy(group).orderBy(race_key(w, F.lit(seed), F.col(item)), draw.desc(), item)
    return units.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_multi_share(selected: DataFrame, units: DataFrame, score: str = "hard_score", share: float = 0.6, group: str = "topic") -> DataFrame:
    """selected(group, unit_id, unit_type, rank), of which the last singles make room for the best multi units not chosen, until multi units have the share."""
    n = selected.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(F.col("unit_type") == "multi").alias("_m"))
    want = n.withColumn("_want", F.greatest(F.lit(0), F.floor((F.lit(share) - F.col("_m") / F.col("_n")) * F.col("_n") + F.lit(1e-9)).cast("int")))
    spare = units.where("unit_type = 'multi'").join(selected.select(group, "unit_id"), [group, "unit_id"], "left_anti")
    # no group takes more; with a limit, only the best rows of every task are shuffled
    most = want.agg(F.max("_want")).first()[0] or 0
    spare = spare.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(F.round(score, 9).desc(), "unit_id"))).where(F.col("_place") <= most)
    have = spare.groupBy(group).agg(F.count("*").alias("_spare"))
    singles = n.select(group, (F.col("_n") - F.col("_m")).alias("_singles"))
    moves = want.join(have, group, "left").join(singles, group).select(group, F.least("_want", F.coalesce("_spare", F.lit(0)), "_singles").cast("int").alias("_moves"))
    tail = F.when(F.col("unit_type") == "single", F.row_number().over(Window.partitionBy(group, "unit_type").orderBy(F.col("rank").desc()))).otherwise(1 << 30)
    kept = selected.withColumn("_tail", tail).join(moves, group).where("_tail > _moves").select(group, "unit_id", "unit_type")
    return kept.unionByName(spare.join(moves, group).where("_place <= _moves").select(group, "unit_id", "unit_type"))


def usage_counts(ledger: DataFrame, unit: str = "unit_id") -> DataFrame:
    return ledger.groupBy(unit).agg(F.count("*").alias("usage"))


def with_usage(units: DataFrame, ledger: DataFrame, unit: str = "unit_id") -> DataFrame:
    return units.drop("usage_count").join(usage_counts(ledger, unit).withColumnRenamed("usage", "usage_count"), unit, "left").fillna(0, ["usage_count"])


def saliency_top(items: DataFrame, views: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k items with the most views; missing views are 0, ties go to the smaller key."""
    joined = items.join(views, key, "left").withColumn("views", F.coalesce("views", F.lit(0)))
    return joined.orderBy(F.col("views").desc(), key).limit(k)


STRATEGIES: dict[str, Callable[[str, str], Column]] = {"broad_exploration": broad_weight, "gap_driven": gap_weight}


def strategy(name: str) -> Callable[[str, str], Column]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown sampling strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]
