"""What models are asked for: prompts are columns, calls go through models.clients.responses(), answers come back as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import verdict
from sievewright.models.clients import Client, responses
from sievewright.operators.chunking import paragraph_batches
from sievewright.operators.prompts import filled
from sievewright.operators.questions import parsed

#: The prompts with which a model takes a test, without and with choices.
ANSWER = "Answer the following question.\n\nQuestion:\n{question}\n\nReturn only the answer. Do not include explanation unless necessary."
CHOOSE = "Question:\n{question}\n\nChoices:\n{choices}\n\nReturn the best option letter and answer text."
#: A judge gives its reasons, two number signs, and true or false.
JUDGE = "Say whether a prediction answers the question as the gold answer does. Another form of the same answer counts, and so does one of several right answers. Give a short reason, then ## and true or false.\nQuestion: {question}\npred={answer} || gold={gold}\nreason:"
PARAGRAPHS = "Write questions with answers that these paragraphs give, as a JSON list of objects with question and answer.\n\n{paragraphs}"
CATEGORIES = "Name subcategories of {topic} that a test should cover, as a JSON list of objects with category and parent_category.{context}"


def evaluation_prompt(question: Column, choices: Column) -> Column:
    """What a test taker is asked: the question, with a line for each choice if there are any."""
    listed = F.array_join(choices, "\n")
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, filled(CHOOSE, question=question, choices=listed)).otherwise(filled(ANSWER, question=question))


def mapped(rows: DataFrame, answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """rows with the answer of the same key; a row without one, or with a failed one, has an empty text."""
    return rows.join(answers.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def answered(questions: DataFrame, client: Client, question: str = "question", choices: str = "choices") -> DataFrame:
    """questions with test_answer, what the client says to evaluation_prompt(), and error."""
    asked = questions.withColumn("prompt", evaluation_prompt(F.col(question), F.col(choices)))
    return responses(asked, client).select(*questions.columns, F.coalesce(F.trim("text"), F.lit("")).alias("test_answer"), "error")


def judged(pairs: DataFrame, client: Client, question: str = "question", answer: str = "test_answer", gold: str = "gold_answer") -> DataFrame:
    """pairs with reasons, the judge's whole answer, and is_correct, whether its verdict is true; a failed call is no true verdict."""
    asked = pairs.withColumn("prompt", filled(JUDGE, question=F.col(question), answer=F.col(answer), gold=F.col(gold)))
    return responses(asked, client).select(*pairs.columns, F.col("text").alias("reasons"), F.coalesce(F.lower(verdict(F.col("text"))) == "true", F.lit(False)).alias("is_correct"))


def paragraph_questions(paragraphs: DataFrame, client: Client, per: int = 20, document: str = "doc_id", position: str = "pos", text: str = "text") -> DataFrame:
    """(document, batch, pos, question_json): questions from batches of a document's paragraphs in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n")
    batches = paragraph_batches(paragraphs, per, document, position).groupBy(document, "batch").agg(lines.alias("_lines"))
    asked = batches.select(F.struct(document, "batch").alias("_item"), filled(PARAGRAPHS, paragraphs=F.col("_lines")).alias("prompt"))
    answers = responses(asked, client).select(F.to_json("_item").alias("_key"), "text")
    kind = batches.select(document, "batch").schema.simpleString()
    return parsed(answers, "_key", "text").withColumn("_item", F.from_json("_key", kind)).select(f"_item.{document}", "_item.batch", "pos", "question_json")


def brainstormed(topics: DataFrame, client: Client, topic: str = "topic", context: str | None = None) -> DataFrame:
    """(topic, category, parent_category) that the client names for each topic; context: a column of related pages. Repeated categories count once."""
    near = F.concat(F.lit("\nRelated pages: "), F.col(context)) if context else F.lit("")
    asked = topics.select(topic, filled(CATEGORIES, topic=F.col(topic), context=near).alias("prompt"))
    said = parsed(responses(asked, client).select(topic, "text"), topic, "text")
    item = F.from_json("question_json", "category string, parent_category string")
    return said.select(topic, item.alias("_c")).select(topic, F.trim("_c.category").alias("category"), F.coalesce("_c.parent_category", F.col(topic)).alias("parent_category")).where("category <> ''").distinct()


def prompt_performance(prompts: DataFrame, *by: str, prompt: str = "prompt", seconds: str | None = None) -> DataFrame:
    """Number of prompts and their mean, least and largest length in characters, and prompts a second if a column has their seconds."""
    n = F.length(F.coalesce(prompt, F.lit("")))
    rate = [F.try_divide(F.count("*"), F.sum(seconds)).alias("prompts_per_second")] if seconds else []
    return prompts.groupBy(*by).agg(F.count("*").alias("n"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), *rate)
