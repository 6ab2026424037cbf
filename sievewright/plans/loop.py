"""The generation loop: targets, gaps, sampled evidence, prompts, answers, checks, until the targets are met.

A round is one plan over all topics and keys: gaps, uses and accepted questions are tables and are joined. What a round
writes lies in folders of its number, so a round that runs again replaces its own rows and nothing else; its last act is to
say that it is done. Everything else is computed from these tables, so a run goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.models.clients import Client, responses
from sievewright.operators import planning, questions, sampling
from sievewright.operators.prompts import DIFFICULTY_TEXT, filled, lookup
from sievewright.schemas import DIFFICULTIES, MODES

PROMPT = "Write {n} {mode} questions of difficulty {difficulty}. {instruction}\n\n{evidence}"
ITEM = "question string, answer string, question_type string, estimated_difficulty string, choices array<string>, citations array<struct<chunk_id: string, text: string>>"
TABLES = {"accepted": "topic string, key string, question string, answer string, round int", "used": "unit_id string, round int", "done": "topics long, round int"}
#: Units that are drawn for a topic in a round.
DRAWN = 7


def weight_of(strategy: str) -> Column:
    """The strategy's weight of a unit for the row's own mode and difficulty."""
    weigh, out = sampling.strategy(strategy), F.lit(0.0)
    for m in sorted(MODES):
        for x in sorted(DIFFICULTIES):
            out = F.when((F.col("mode") == m) & (F.col("difficulty") == x), weigh(m, x)).otherwise(out)
    return out


def stored(spark, folder: str, name: str) -> DataFrame:
    """A table of the run, with all rounds."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def gaps(targets: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """targets with what is completed and remains, from the questions accepted (in rounds before a number)."""
    accepted = stored(targets.sparkSession, folder, "accepted")
    accepted = accepted if before is None else accepted.where(F.col("round") < before)
    return planning.remaining(targets, accepted.groupBy("topic", "key").agg(F.count("*").alias("n")))


def opened(spark, folder: str) -> int:
    """Makes the tables of a new run, with an empty round 0; the number of the next round."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).drop("round").write.mode("overwrite").parquet(f"{folder}/{name}/round=0")
    return (stored(spark, folder, "done").agg(F.max("round")).first()[0] or 0) + 1


def play(units: DataFrame, targets: DataFrame, client: Client, folder: str, number: int) -> bool:
    """One round for all topics; False if no gap is left. The same round again replaces what it wrote, and nothing else."""
    spark = units.sparkSession
    place = f"round={number}"
    todo = planning.main_gap(gaps(targets, folder, number))
    todo = todo.select("topic", "key", "remaining", F.split_part("key", F.lit(":"), F.lit(1)).alias("mode"), F.split_part("key", F.lit(":"), F.lit(2)).alias("difficulty"))
    used = stored(spark, folder, "used").where(F.col("round") < number)
    pool = sampling.with_usage(units, used).join(todo, "topic")
    drawn = sampling.weighted_sample(pool, weight_of("gap_driven" if number > 1 else "broad_exploration"), DRAWN, seed=number).where(F.col("rank") <= F.least(F.lit(5), F.col("remaining") + 2))
    prompt = filled(PROMPT, n=planning.request_size(F.col("remaining"))[1], mode=F.col("mode"), difficulty=F.col("difficulty"), instruction=lookup(F.col("difficulty"), DIFFICULTY_TEXT), evidence=F.col("text"))
    prompts = drawn.select("topic", "key", "mode", "remaining", "unit_id", prompt.alias("prompt"))
    # answers may differ when computed again, so they are written before they are read
    responses(prompts, client).write.mode("overwrite").parquet(f"{folder}/responses/{place}")
    answers = spark.read.parquet(f"{folder}/responses/{place}")
    if answers.isEmpty():
        return False
    answers.select("unit_id").write.mode("overwrite").parquet(f"{folder}/used/{place}")
    found = questions.parsed(answers.where("text IS NOT NULL").select("call_id", "text").distinct(), "call_id", "text").withColumn("q", F.from_json("question_json", ITEM))
    asked = answers.select("call_id", "unit_id", "topic", "key", "mode", "remaining")
    rows = found.select("call_id", "pos", "q.*").join(asked, "call_id").withColumn("question_mode", F.col("mode")).withColumn("citations", F.transform("citations", lambda c: c["text"]))
    wanted = F.row_number().over(Window.partitionBy("topic", "key").orderBy("call_id", "unit_id", "pos"))
    good = rows.where(questions.reject_reason().isNull()).withColumn("_n", wanted).where(F.col("_n") <= F.col("remaining"))
    good.select("topic", "key", "question", "answer").write.mode("overwrite").parquet(f"{folder}/accepted/{place}")
    asked.agg(F.count_distinct("topic").alias("topics")).write.mode("overwrite").parquet(f"{folder}/done/{place}")
    return True


def run(units: DataFrame, targets: DataFrame, client: Client, folder: str, max_rounds: int = 3) -> DataFrame:
    """Gaps after the last round. units(topic, unit_id, unit_type, text, mcq_score, qa_score, hard_score); targets(topic, key, target, pos).

    A topic works on one key a round and is given at most what remains of it. A topic without units stays open; the run
    ends when no topic with units has a gap, or after max_rounds.
    """
    start = opened(units.sparkSession, folder)
    for number in range(start, start + max_rounds):
        if not play(units, targets, client, folder, number):
            break
    return gaps(targets, folder)
