"""Targets, gaps and next steps. Targets are long rows (topic, mode, difficulty, target); what is completed is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import written

HARDNESS = {"hard": 1, "medium": 2, "easy": 3}


def apportioned(plan: DataFrame) -> DataFrame:
    """plan(mode, count, difficulty, ratio, pos) with target: floor(count * ratio), and one more for the largest fractions until the count is dealt."""
    exact = F.round(F.col("count") * F.col("ratio"), 9)
    out = plan.withColumn("_floor", F.floor(exact)).withColumn("_part", F.round(exact - F.col("_floor"), 9))
    left = F.max("count").over(Window.partitionBy("mode")) - F.sum("_floor").over(Window.partitionBy("mode"))
    place = F.row_number().over(Window.partitionBy("mode").orderBy(F.col("_part").desc(), "pos"))
    return out.withColumns({"_left": left, "_place": place}).withColumn("target", (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")).cast("int")).drop("_floor", "_part", "_left", "_place")


#: Up to so many targets a plan is broadcast; longer ones are joined in blocks of so many.
BROADCAST_TARGETS = 10_000


def numbered(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the order of a column, whose values are different. Ranges are sorted by themselves, and the numbers of rows
    in the ranges before say where each begins, so no task sees all rows."""
    spread = written(rows.sparkSession, rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row for each range
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return spread.withColumn("_k", within).join(before, "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_k", "_before")


def topic_targets(targets: DataFrame, topics: DataFrame) -> DataFrame:
    """Each target split evenly over topics(topic, pos from 0): the first ones take the remainder. A row for each topic and target, however many there are of either."""
    n = F.lit(topics.count())
    dealt = F.floor(F.col("target") / n) + (F.col("topic_pos") < F.col("target") % n).cast("int")
    blocks = -(-targets.count() // BROADCAST_TARGETS)
    names = topics.select("topic", F.col("pos").alias("topic_pos"))
    if blocks <= 1:
        pairs = names.crossJoin(F.broadcast(targets))
    else:
        parts = F.pmod(F.xxhash64(*targets.columns), F.lit(blocks)).cast("int")
        pairs = names.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(targets.withColumn("_block", parts), "_block")
    return pairs.select("topic", "mode", "difficulty", dealt.cast("int").alias("target"))


def remaining(targets: DataFrame, completed: DataFrame) -> DataFrame:
    """targets(topic, key, target) with completed(topic, key, n) counts and what remains."""
    done = completed.groupBy("topic", "key").agg(F.sum("n").alias("completed"))
    out = targets.join(done, ["topic", "key"], "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("target") - F.col("completed")))


def report_totals(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("key").agg(F.sum("completed").alias("completed"), F.sum("remaining").alias("remaining")).withColumn("status", F.when(F.col("remaining") > 0, "partial").otherwise("completed"))


def coverage(gaps: DataFrame) -> DataFrame:
    """For each topic, the mean of completed over target (at least 1)."""
    return gaps.groupBy("topic").agg(F.avg(F.col("completed") / F.greatest(F.col("target"), F.lit(1))).alias("coverage"))


def coverage_by_key(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("progress", F.when(F.col("target") > 0, F.col("completed") / F.col("target")).otherwise(1.0))


def coverage_summary(gaps: DataFrame) -> DataFrame:
    """Total completed over total target, and the key with the largest gap."""
    rows = gaps.groupBy("topic").agg(F.sum("completed").alias("c"), F.sum("target").alias("t"), F.max_by("key", F.struct("remaining", F.col("target") * 0)).alias("gap"))
    share = F.when(F.col("t") > 0, F.col("c") * 100.0 / F.col("t")).otherwise(0.0)
    return rows.select("topic", F.format_string("%d/%d (%.1f%%), largest gap %s", "c", "t", share, "gap").alias("summary"))


def hardness(key: Column) -> Column:
    out = F.lit(4)
    for name, rank in reversed(HARDNESS.items()):
        out = F.when(key.contains(name), rank).otherwise(out)
    return out


def main_gap(gaps: DataFrame, position: str = "pos") -> DataFrame:
    """Of each topic, the key to work on: hard before medium before easy, then the largest remainder, then plan order."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy(hardness(F.col("key")), F.col("remaining").desc(), position, "key"))
    return gaps.where("remaining > 0").withColumn("_place", place).where("_place = 1").select("topic", "key", "remaining")


def global_gap(gaps: DataFrame, deferred: DataFrame | None = None) -> DataFrame:
    """Over the deferred topics, the key with the most remaining, and its topics in order."""
    rows = gaps if deferred is None else gaps.join(deferred.select("topic").distinct(), "topic", "left_semi")
    rows = rows.where("remaining > 0").groupBy("key").agg(F.sum("remaining").alias("remaining"), F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics"))
    return rows.orderBy(F.col("remaining").desc(), hardness(F.col("key")), "key").limit(1)


def completion(gaps: DataFrame) -> DataFrame:
    """For each topic, whether all keys are complete and whether anything remains."""
    return gaps.groupBy("topic").agg(F.bool_and(F.col("completed") >= F.col("target")).alias("is_complete"), F.bool_or(F.col("remaining") > 0).alias("has_gap"))


def request_size(left: Column) -> tuple[Column, Column]:
    """Questions to ask for at least and at best."""
    few, some = left <= 2, left <= 5
    return F.when(few | some, left + 1).otherwise(left + 2), F.when(few, left + 2).when(some, left + 3).otherwise(left + 4)


def allowed_actions(hard_gap: Column, round_number: Column, max_rounds: Column) -> Column:
    more = F.when(hard_gap, F.array(*map(F.lit, ("expand_retrieval", "increase_multi_chunk", "hardening")))).otherwise(F.array().cast("array<string>"))
    late = F.when(round_number + 1 >= max_rounds, F.array(F.lit("defer_topic"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("continue_generation")), more, late)


def next_step(hard_gap: Column, prefer_multi: Column) -> Column:
    """expand_retrieval for a hard gap while multi units aren't preferred, then increase_multi_chunk; continue_generation otherwise."""
    return F.when(hard_gap & ~prefer_multi, "expand_retrieval").when(hard_gap, "increase_multi_chunk").otherwise("continue_generation")


def rule_policy(observations: DataFrame) -> DataFrame:
    """observations(topic, round, max_rounds, gap_remaining, primary_gap, multi_efficiency, single_efficiency) with the rule-based decision."""
    done = (F.col("gap_remaining") == 0) | (F.col("round") >= F.col("max_rounds"))
    mode, difficulty = F.split_part("primary_gap", F.lit(":"), F.lit(1)), F.split_part("primary_gap", F.lit(":"), F.lit(2))
    keep = lambda c: F.when(~done, c)
    return observations.select(
        "topic", F.when(done, "finish_topic").otherwise("generate_questions").alias("next_action"), keep(mode).alias("target_mode"), keep(difficulty).alias("target_difficulty"),
        keep(request_size(F.col("gap_remaining"))[1]).alias("requested_questions"), keep(F.when(F.col("round") > 0, "gap_driven").otherwise("broad_exploration")).alias("strategy"),
        keep(F.least(F.lit(5), F.col("gap_remaining") + 2)).alias("num_evidence"), keep((difficulty == "hard") & (F.col("multi_efficiency") > F.col("single_efficiency"))).alias("prefer_multi_chunk"),
    )


KNOWN_ACTIONS = ["generate_questions", "finish_topic", "expand_retrieval", "increase_multi_chunk", "hardening", "continue_generation", "defer_topic", "backfill"]


def decision_issues(decisions: DataFrame) -> DataFrame:
    """decisions(topic, next_action, target_gap, requested_questions) with issues: errors for unknown actions and missing topics, warnings for odd gaps and numbers."""
    found = F.array(
        F.when(~F.coalesce(F.col("next_action").isin(KNOWN_ACTIONS), F.lit(False)), F.lit("error:unknown_action")),
        F.when(F.coalesce(F.col("topic"), F.lit("")) == "", F.lit("error:missing_topic")),
        F.when(~F.coalesce(F.col("target_gap").contains(":"), F.lit(True)), F.lit("warning:gap_format")),
        F.when(F.col("requested_questions") > 20, F.lit("warning:too_many")),
        F.when(F.col("requested_questions") <= 0, F.lit("warning:too_few")),
    )
    return decisions.withColumn("issues", F.array_compact(found))


def check_parameters(parameters: dict, required: dict[str, str]) -> list[str]:
    """Problems of a call's parameters: missing ones, and ones of another type. A bool passes as an integer."""
    kinds = {"string": str, "integer": int, "number": (int, float), "array": list, "object": dict, "boolean": bool}
    out = [f"missing: {k}" for k in required if k not in parameters]
    return out + [f"not {kind}: {k}" for k, kind in required.items() if k in parameters and not isinstance(parameters[k], kinds[kind])]


def ewma(df: DataFrame, key: str | list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """alpha * value + (1 - alpha) * before, from 0, in order: a sum in which a row weighs alpha * (1 - alpha) ** (rows after it). A null value makes null.

    The sum composes: a range of a key's rows is its count and its own weighted sum, and counts of the ranges after it say what that
    weighs. Ranges of key and order are dealt over all tasks, so a key with most rows is in many of them; rows of one order stay together.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_x")).repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    after = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(F.col(order).desc())) - 1
    parts = rows.withColumn("_w", F.col("_x") * F.lit(alpha) * F.pow(F.lit(1 - alpha), after)).groupBy("_range", *keys).agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"), F.count("_x").alias("_known"))
    # a few rows a key: one for each range it reaches into
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a sum leaves nulls out, the rule doesn't
    whole = F.sum("_known") == F.sum("_n")
    return parts.withColumn("_later", later).groupBy(*keys).agg(F.when(whole, F.sum(F.col("_w") * F.pow(F.lit(1 - alpha), F.col("_later")))).alias("ewma"))


def evidence_stats(batches: DataFrame, topic: str = "topic", order: str = "round", alpha: float = 0.3) -> DataFrame:
    """(topic, kind, measure, label, value): the moving averages that describe how single and multi units have served a topic.

    batches(topic, round, used_single_chunks, used_multi_chunks, candidate_count, valid_count, and for both kinds a map
    <kind>_mode_counts and <kind>_difficulty_counts). Candidates and valid questions are divided by single units for
    'single' and by units of both kinds for 'multi'; counts of a map by the valid questions. A round without units of a
    kind leaves that kind's rows as they are, one without valid questions the shares, one without a label that label's.
    Null counts are 0, null maps are empty.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    single, multi, valid = n("used_single_chunks"), n("used_multi_chunks"), n("valid_count")
    parts = []
    for kind, used, by in (("single", single, single), ("multi", multi, single + multi)):
        row = lambda measure, label, value: F.struct(F.lit(kind).alias("kind"), F.lit(measure).alias("measure"), label.alias("label"), value.alias("x"))  # noqa: B023, E731
        parts += [F.when(used > 0, F.array(row(f"{measure}_rate", F.lit(""), F.try_divide(n(f"{measure}_count"), by)))) for measure in ("candidate", "valid")]
        for measure in ("mode", "difficulty"):
            entries = F.map_entries(f"{kind}_{measure}_counts")
            shares = F.transform(entries, lambda e: row(measure, e["key"].cast("string"), F.try_divide(F.coalesce(e["value"], F.lit(0)).cast("double"), valid)))  # noqa: B023
            parts.append(F.when((used > 0) & (valid > 0), shares))
    rows = batches.select(topic, order, F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("r")).select(topic, order, "r.*")
    return ewma(rows, [topic, "kind", "measure", "label"], order, "x", alpha).withColumnRenamed("ewma", "value")


def loop_guard(rounds: DataFrame, key: str, order: str, gap: str, cover: str) -> DataFrame:
    """rounds with is_stuck (over three rounds, the gap fell by less than 1 and coverage grew by less than 0.05) and last_progress (the last round whose gap fell by at least 1, else 0)."""
    w = Window.partitionBy(key).orderBy(order)
    stuck = (F.lag(gap, 2).over(w) - F.col(gap) < 1) & (F.col(cover) - F.lag(cover, 2).over(w) < 0.05)
    out = rounds.withColumns({"is_stuck": F.coalesce(stuck, F.lit(False)), "_i": F.row_number().over(w), "_fell": F.lag(gap).over(w) - F.col(gap) >= 1})
    progress = F.max(F.when(F.col("_fell"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("last_progress", F.coalesce(progress, F.lit(0))).drop("_i", "_fell")


def failure_streak(rounds: DataFrame, key: str, order: str, failed: Column, last: int = 5) -> DataFrame:
    """For each key, how many of its last rounds (of at most `last`) failed in a row up to the end."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    tail = rounds.withColumns({"_n": F.row_number().over(w), "_ok": ~failed}).where(F.col("_n") <= last)
    return tail.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("_n"))) - 1, F.count("*")).cast("long").alias("streak"))


def history_tail(rounds: DataFrame, key: str, order: str, last: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rounds.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")


def success_by_kind(rounds: DataFrame, key: str, order: str, last: int = 5, ratio: float = 1.5) -> DataFrame:
    """Valid questions of the last rounds with and without multi units, and whether multi units do `ratio` times as well."""
    out = history_tail(rounds, key, order, last).groupBy(key).agg(F.sum(F.when(F.col("prefer_multi"), F.col("valid_count")).otherwise(0)).alias("multi"), F.sum(F.when(~F.col("prefer_multi"), F.col("valid_count")).otherwise(0)).alias("single"))
    return out.withColumn("multi_better", F.col("multi") > F.col("single") * ratio)


def sufficiency(total: Column) -> Column:
    return F.when(total >= 10, "sufficient").when(total >= 5, "partial").otherwise("insufficient")
