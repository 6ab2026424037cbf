"""From answers to accuracy: joins of gold and predicted answers, and aggregates over categories, iterations, capabilities and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import exact_match
from sievewright.session import written


def matched_answers(gold: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """gold(key, gold_answer) with predicted(key, test_answer) and match; rows without a partner have a null match, so that missing answers show."""
    return gold.join(predicted, key, "full_outer").withColumn("match", F.when(F.col("gold_answer").isNotNull() & F.col("test_answer").isNotNull(), exact_match(F.col("gold_answer"), F.col("test_answer"))))


def accuracy(df: DataFrame, *by: str, correct: str = "is_correct") -> DataFrame:
    c = F.col(correct).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("correct"), F.round(F.avg(c), 3).alias("accuracy"))


def accuracy_over_history(iterations: list[DataFrame], *by: str, correct: str = "is_correct") -> DataFrame:
    tagged = [df.withColumn("iteration", F.lit(i)) for i, df in enumerate(iterations)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    return accuracy(rows, "iteration", *by, correct=correct)


#: Items of a page of listed_by_outcome().
PAGE = 1000


def listed_by_outcome(df: DataFrame, by: str, correct: str, item: str, page: int = PAGE) -> DataFrame:
    """(by, correct, page, items): the items of each value of `by` and outcome in order, in lists of at most `page`, so that no row grows with the table.

    An item's place follows from counts of ranges of items: ranges come from a sort of all rows, places within a range from that range alone.
    """
    rows = written(df.sparkSession, df.select(by, correct, F.col(item).alias("_item")).repartitionByRange(F.col(by), F.col(correct), F.col("_item")).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(by, correct, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by, correct).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("_range", by, correct).orderBy("_item")
    names = before.select(F.col(by).alias("_by"), F.col(correct).alias("_correct"), F.col("_range").alias("_r"), "_before")
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col(correct).eqNullSafe(F.col("_correct")) & (F.col("_range") == F.col("_r"))
    placed = rows.withColumn("_k", F.row_number().over(within)).join(names, same).withColumn("page", F.floor((F.col("_before") + F.col("_k") - 1) / page).cast("int"))
    return placed.groupBy(by, correct, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x.cast("string")), ",").alias("items"))


def capability_accuracy(df: DataFrame, labels: str, correct: str = "is_correct") -> DataFrame:
    """Accuracy of each label, lowest first; rows without labels are 'uncategorized'."""
    some = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.col(labels)).otherwise(F.array(F.lit("uncategorized")))
    return accuracy(df.withColumn("label", F.explode(some)), "label", correct=correct).orderBy("accuracy", "label")


def model_metrics(answers: DataFrame) -> DataFrame:
    """answers(question_id, model, verdict, refused, judge_score): accuracy, refusals, mean score, and the share of questions models disagree on."""
    differ = answers.groupBy("question_id").agg((F.count_distinct("verdict") > 1).alias("_differ"))
    return answers.join(differ, "question_id").groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("verdict") == "true").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"),
        F.round(F.avg("judge_score"), 6).alias("mean_judge_score"), F.round(F.avg(F.col("_differ").cast("int")), 6).alias("disagreement_rate"),
    )


def wilson(correct: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's bounds of a share."""
    p, nn = correct.cast("double") / n, n.cast("double")
    middle, half, all_ = p + z * z / (2 * nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)), 1 + z * z / nn
    return (middle - half) / all_, (middle + half) / all_


def weaknesses(results: DataFrame, parent: str, category: str, threshold: float, correct: str = "is_correct") -> DataFrame:
    """Nodes of a two-level tree (parents have a null category) whose upper Wilson bound is below the threshold."""
    c = F.col(correct).cast("int")
    nodes = results.rollup(parent, category).agg(F.count("*").alias("n"), F.sum(c).alias("correct")).where(F.col(parent).isNotNull())
    low, high = wilson(F.col("correct"), F.col("n"))
    return nodes.withColumns({"low": low, "high": high}).where(F.col("high") < threshold)


def distribution(df: DataFrame, by: str) -> DataFrame:
    """n and share of each value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(by, "n", (F.col("n") / F.col("_all")).alias("share"))


def report_counts(df: DataFrame, by: str, validated: Column, failed: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("generated"), F.count_if(validated).alias("validated"), F.count_if(~validated).alias("rejected"), F.count_if(failed).alias("failures"))


def score_auto(mode: Column, answer: Column, gold: Column, judged: Column) -> Column:
    """Exact match for multiple choice, the judge's verdict otherwise."""
    return F.when(mode == "multiple_choice", exact_match(answer, gold)).otherwise(F.coalesce((F.lower(F.trim(judged)) == "true").cast("int"), F.lit(0)))


def batch_counts(questions: DataFrame) -> DataFrame:
    """questions(mode, difficulty, chunk_ids): counts, split by whether several chunks were used."""
    kind = F.when(F.coalesce(F.size("chunk_ids"), F.lit(0)) > 1, "multi").otherwise("single")
    return questions.withColumn("unit_type", kind).groupBy("mode", "difficulty").pivot("unit_type", ["single", "multi"]).agg(F.count(F.lit(1))).fillna(0, ["single", "multi"])


def length_stats(df: DataFrame, by: str, length: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(length).alias("avg_len"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.sum(length).cast("long").alias("total_len"))


def valid_rate(passed: Column, raw: Column) -> Column:
    return F.coalesce(F.try_divide(passed, raw), F.lit(0.0))


def capability_clusters(vectors: DataFrame, k: int, column: str = "embedding", seed: int = 7, keep: str | None = None) -> DataFrame:
    """vectors with the cluster of each, by bisecting k-means on cosine distance."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
    return BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", distanceMeasure="cosine").fit(rows).transform(rows).drop(*({"_features"} - {keep}))


def clusters_by_silhouette(vectors: DataFrame, most: int = 8, least_rows: int = 20, depth: int = 2, column: str = "embedding", seed: int = 7) -> DataFrame:
    """vectors with cluster, a path like 2.0, as recursive_clusters() finds it."""
    from sievewright.operators.clustering import recursive_clusters

    rows = vectors.select(F.struct("*").alias("_row"), F.col(column).alias("_vector"))
    return recursive_clusters(rows, "_row", "_vector", most, least_rows, depth, seed)[0].select("_row.*", "cluster")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
