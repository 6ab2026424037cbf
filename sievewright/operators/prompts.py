"""Prompts and renderings: templates filled from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markup of each chat format: before and after a turn of the user and of the assistant, and the end of a prompt.
CHAT = {
    "chatglm": (("[Round 0]\n问：", "\n答："), ("", "\n"), ""),
    "qwen": (("<|im_start|>user\n", "<|im_end|>\n"), ("<|im_start|>assistant\n", "<|im_end|>\n"), "<|im_start|>assistant\n"),
    "default": (("User: ", "\n"), ("Assistant: ", "\n"), "Assistant:"),
}
#: What a difficulty asks of a question, and the template of a mode.
DIFFICULTY_TEXT = {"easy": "Ask for one fact that the text states.", "medium": "Ask for a link between two statements of the text.", "hard": "Ask for a conclusion that needs several statements of the text."}
TEMPLATES = {"multiple_choice": "mcq_system_prompt.md", "qa": "qa_system_prompt.md"}


def filled(template: str, **columns: Column) -> Column:
    """The template with every {name} replaced by its column; nulls are empty."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def lookup(key: Column, values: dict[str, str], default: str = "") -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def tagged_chunks(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("<text_chunk_"), i.cast("string"), F.lit(">"), t, F.lit("</text_chunk_"), i.cast("string"), F.lit(">"))), "\n")


def evidence_text(units: DataFrame, group: str, position: str) -> DataFrame:
    """units(group, position, unit_type, unit_id, texts): one text a group, single units first, each kind numbered by position."""
    number = F.row_number().over(Window.partitionBy(group, "unit_type").orderBy(position))
    lines = F.array_join(F.transform("texts", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    single = F.concat(F.lit("### Single evidence "), "_n", F.lit("\nID: "), "unit_id", F.lit("\n"), F.get("texts", F.lit(0)), F.lit("\n"))
    multi = F.concat(F.lit("### Multiple evidence "), "_n", F.lit("\nID: "), "unit_id", F.lit("\nContains:\n"), lines, F.lit("\n"))
    rows = units.withColumn("_i", number).withColumn("_n", F.col("_i").cast("string")).withColumn("_t", F.when(F.col("unit_type") == "multi", multi).otherwise(single))
    order = F.array_sort(F.collect_list(F.struct((F.col("unit_type") == "multi").alias("m"), F.col("_i"), F.col("_t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(order, lambda x: x["_t"]), "\n").alias("evidence"))


def chat_rendered(turns: DataFrame, fmt: str = "default", group: str = "conv_id", order: str = "turn") -> DataFrame:
    """(group, rendered): a conversation's turns in order as one prompt. Its turns meet in one row, as a prompt must."""
    user, assistant, end = CHAT.get(fmt, CHAT["default"])
    only_known = fmt in ("chatglm", "qwen")
    t = F.coalesce("text", F.lit(""))
    other = F.lit("") if only_known else F.concat(F.lit(assistant[0]), t, F.lit(assistant[1]))
    piece = F.when(F.col("role") == "user", F.concat(F.lit(user[0]), t, F.lit(user[1]))).when(F.col("role") == "assistant", F.concat(F.lit(assistant[0]), t, F.lit(assistant[1]))).otherwise(other)
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("p"))))
    return turns.groupBy(group).agg(F.concat(F.array_join(F.transform(pieces, lambda x: x["p"]), ""), F.lit(end)).alias("rendered"))
