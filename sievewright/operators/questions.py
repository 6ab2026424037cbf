"""Parsing, checking and normalising generated questions."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import normalized_question
from sievewright.operators.rows import found_rows
from sievewright.schemas import DIFFICULTIES, MODES, QUESTION_TYPES, difficulty_band


def _present(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def reject_reason(strict_compat: bool = False) -> Column:
    """The first failed check of a question row, null if it passes.

    Columns: question, answer, question_mode, estimated_difficulty (text), choices, citations (array of texts), question_type.
    A single letter is a good answer to a multiple-choice question unless strict_compat.
    """
    number = F.col("estimated_difficulty").try_cast("int")
    hard_enough = F.when(number.isNotNull(), number.between(1, 10)).otherwise(F.lower("estimated_difficulty").isin(DIFFICULTIES))
    letter = F.upper("answer").isin(list("ABCDEF"))
    index = F.ascii(F.upper("answer")) - 65
    choice = F.coalesce(F.col("question_mode") == "multiple_choice", F.lit(False))
    short_ok = F.lit(False) if strict_compat else choice
    n = F.coalesce(F.size("choices"), F.lit(0))
    return (
        F.when(~_present("question"), "missing_question")
        .when(~_present("answer"), "missing_answer")
        .when(_present("question_mode") & ~F.col("question_mode").isin(MODES), "bad_mode")
        .when(_present("estimated_difficulty") & ~hard_enough, "bad_difficulty")
        .when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "no_citations")
        .when(F.exists("citations", lambda c: F.coalesce(c, F.lit("")) == ""), "empty_citation")
        .when(choice & (n != 4), "bad_choices")
        .when(choice & letter & (index >= n), "bad_choice_answer")
        .when(F.length(F.trim("question")) < 10, "short_question")
        .when((F.length(F.trim("answer")) < 5) & ~short_ok, "short_answer")
        .when(_present("question_type") & ~F.lower("question_type").isin(QUESTION_TYPES), "bad_type")
    )


def partitioned(questions: DataFrame, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Questions that pass, and the others with reject_reason."""
    rows = questions.withColumn("reject_reason", reject_reason(strict_compat))
    return rows.where("reject_reason IS NULL").drop("reject_reason"), rows.where("reject_reason IS NOT NULL")


def normalized(questions: DataFrame) -> DataFrame:
    """Mode qa by default; numbers become difficulty bands; four choices become "(A) ..."; a number as answer becomes its letter, letters upper case."""
    number = F.col("estimated_difficulty").try_cast("int")
    bare = F.transform(F.slice("choices", 1, 4), lambda c: F.regexp_replace(c, r"^\([A-F]\)\s*", ""))
    lettered = F.transform(bare, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), c))
    choice = F.coalesce(F.col("question_mode"), F.lit("qa")) == "multiple_choice"
    digit = F.col("answer").try_cast("int")
    answer = F.when(choice & digit.isNotNull(), F.char(digit + 65)).when(choice & (F.length("answer") == 1), F.upper("answer")).otherwise(F.col("answer"))
    return questions.withColumns({
        "question_mode": F.coalesce("question_mode", F.lit("qa")), "estimated_difficulty": F.coalesce(difficulty_band(number), F.lower("estimated_difficulty"), F.lit("medium")),
        "choices": F.when(choice, lettered).otherwise(F.col("choices")), "answer": answer,
    })


def validator_reasons(questions: DataFrame, chunk_ids: DataFrame, item: str = "question_id") -> DataFrame:
    """All reasons against each question (empty texts, a duplicate of an earlier one, no evidence), and accepted, repairable or rejected.

    questions(item, question, answer, chunk_id); chunk_ids(chunk_id)."""
    # texts are only digests and marks from here on, so they needn't be shuffled unless the caller wants them
    rows = questions.withColumns({"_question": F.md5(normalized_question(F.col("question")).cast("binary")), "_asked": _present("question"), "_told": _present("answer")})
    # the least item of a question is combined before the shuffle and joined back on question and item, so copies of one are spread
    first = rows.groupBy("_question").agg(F.min(item).alias("_least")).where("_least IS NOT NULL").withColumn("_first", F.lit(True))
    same = rows["_question"].eqNullSafe(first["_question"]) & (rows[item] == first["_least"])
    # evidence is looked up for narrow rows and joined back on item and chunk, so a chunk that very many questions name is spread
    cited = rows.select(F.col(item).alias("_item"), F.col("chunk_id").alias("_cited")).distinct().join(chunk_ids.select(F.col("chunk_id").alias("_cited")), "_cited", "left_semi").withColumn("_there", F.lit(True))
    rows = rows.join(first, same, "left").drop(first["_question"]).withColumn("_dup", F.col("_first").isNull() & F.col(item).isNotNull()).drop("_question", "_least", "_first")
    rows = rows.join(cited, rows[item].eqNullSafe(cited["_item"]) & (rows["chunk_id"] == cited["_cited"]), "left").drop("_item", "_cited")
    reasons = F.array_compact(F.array(
        F.when(~F.col("_asked"), F.lit("empty_question")), F.when(~F.col("_told"), F.lit("empty_answer")),
        F.when(F.col("_asked") & F.col("_dup"), F.lit("duplicate")), F.when(F.col("_there").isNull(), F.lit("missing_evidence")),
    ))
    rows = rows.withColumn("reasons", reasons)
    fixable = F.forall("reasons", lambda r: r.isin("missing_evidence", "empty_answer"))
    return rows.withColumn("status", F.when(F.size("reasons") == 0, "accepted").when(fixable, "repairable").otherwise("rejected")).drop("_dup", "_there", "_asked", "_told")


#: Where a model puts what it was asked for. Every match is a candidate, tags before fences.
TAGGED, FENCED = r"(?s)<output_json>(.*?)</output_json>", r"(?s)```(?:json)?(.*?)```"
#: The fields that an object may keep its questions in.
LIST_FIELDS = ("questions", "items", "results", "data")


END = "<end of the answer>"


def whole_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value from beginning to end, else null (so is one with a repeated key)."""
    # the parser stops after a value and doesn't see what follows; a mark behind the text must be where the value ends
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    values = F.try_variant_get(marked, "$", "array<variant>")
    whole = (F.size(values) == 2) & (F.try_variant_get(marked, "$[1]", "string") == END)
    return F.when(whole & ~F.contains(text, F.lit(END)), F.get(values, F.lit(0)))


def variant_list(value: Column, path: str = "$") -> Column:
    """The elements of the array at the path, null if there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def question_objects(candidate: Column) -> Column:
    """The objects of a JSON text: those of an array, of the first list among an object's LIST_FIELDS, or the object itself; null if there is none."""
    def found(v: Column) -> Column:
        listed = F.coalesce(variant_list(v), *(variant_list(v, f"$.{f}") for f in LIST_FIELDS), F.when(_is_object(v), F.array(v)))
        return F.filter(listed, _is_object)

    # the value is bound to a variable, so that a text is parsed once
    objects = F.get(F.transform(F.array(whole_json(candidate)), found), F.lit(0))
    return F.when(F.size(objects) > 0, objects)


def _first(candidates: Column, f) -> Column:
    return F.get(F.filter(F.transform(candidates, f), lambda x: x.isNotNull()), F.lit(0))


def well_formed_questions(text: Column) -> Column:
    """array<variant> of the question objects of an answer that is JSON as a whole, in a tag or in a fenced block; else null."""
    return F.coalesce(question_objects(text), *(_first(F.regexp_extract_all(text, F.lit(p), F.lit(1)), question_objects) for p in (TAGGED, FENCED)))


def extracted_json(text: Column) -> Column:
    """The JSON array of an output_json tag (or of a fenced block in it) or of a fenced block, as text; else null."""
    def listed(candidate: Column) -> Column:
        return F.when(variant_list(whole_json(candidate)).isNotNull(), candidate)

    return F.coalesce(*(_first(F.regexp_extract_all(text, F.lit(p), F.lit(1)), listed) for p in (TAGGED, FENCED)))


CLOSING = {"[": "]", "{": "}"}


def outermost(text: str) -> list[str]:
    """Balanced stretches of brackets or braces that lie in no other one, in order; quotes count inside them.

    A bracket that is never closed is skipped, so what a cut-off list still holds is found; what lies in a brace that is
    never closed is part of a broken object and counts only where there is nothing else. One pass, whatever the text.
    """
    stack: list[tuple[int, str]] = []
    pairs: list[tuple[int, int]] = []
    quoted = False
    for m in re.finditer(r'\\.|["\[\]{}]', text, re.DOTALL):
        c = m[0]
        if c == '"' and stack:
            quoted = not quoted
        elif quoted or len(c) > 1 or c == '"':
            continue
        elif c in CLOSING:
            stack.append((m.start(), c))
        elif stack and CLOSING[stack[-1][1]] == c:
            start, _ = stack.pop()
            while pairs and pairs[-1][0] > start:
                pairs.pop()
            pairs.append((start, m.end()))
    broken = min((at for at, c in stack if c == "{"), default=len(text))
    return [text[a:b] for a, b in ([x for x in pairs if x[0] < broken] or pairs)]


def loaded(candidates) -> Iterator:
    """Those of the texts that are JSON, as values."""
    for text in candidates:
        try:
            yield json.loads(text)
        except (ValueError, RecursionError):
            continue


def parse_response(text: str | None) -> list[dict]:
    """Question objects of a model's answer: the whole as JSON (a list, or a dict that holds one or is one), a tagged or fenced block,
    the first array within that holds objects, or else all objects that parse."""
    text = text or ""
    for found in loaded([text, *(m for p in (TAGGED, FENCED) for m in re.findall(p, text))]):
        if isinstance(found, dict):
            lists = [found[k] for k in LIST_FIELDS if isinstance(found.get(k), list)]
            found = lists[0] if lists else [found]
        if isinstance(found, list) and (rows := [x for x in found if isinstance(x, dict)]):
            return rows
    values = list(loaded(outermost(text)))
    lists = ([x for x in v if isinstance(x, dict)] for v in values if isinstance(v, list))
    return next((rows for rows in lists if rows), None) or [v for v in values if isinstance(v, dict)]


def python_blocks(text: str | None) -> list:
    """Lists written as Python literals in fenced blocks, one after the other; dots and a cut-off last line are repaired."""
    text = (text or "").replace("TERMINATE", "")

    def read(t: str) -> list:
        blocks = re.findall(r"```\w*\n?(.*?)```", t, re.DOTALL)
        return [x for b in blocks for x in ast.literal_eval(b.strip())]

    for attempt in (text, text.replace("...", ""), "\n".join(text.split("\n")[:-1]).rstrip().rstrip(",") + "]\n```"):
        try:
            if found := read(attempt):
                return found
        except (ValueError, SyntaxError):
            continue
    return []


def _in_python(rows: DataFrame, item: str, text: str, found) -> DataFrame:
    """(item, pos, question_json) of found(text)."""
    return found_rows(rows, item, text, lambda t: (json.dumps(q, ensure_ascii=False) for q in found(t)), "pos", "question_json")


def parsed(responses: DataFrame, item: str, text: str) -> DataFrame:
    """(item, pos, question_json) for every question object in the answers; a null or empty answer has none.

    Well-formed answers are parsed as VARIANT in the JVM. Only answers that aren't, and that have a brace at all, go to
    Python, where a scan of brackets by depth finds the first array that holds objects, or else all objects that parse.
    """
    rows = responses.select(item, text).withColumn("_found", well_formed_questions(F.col(text)))
    # null lists are dropped once they are exploded: a filter on them would parse every answer once more
    good = rows.select(item, F.posexplode_outer("_found").alias("pos", "_q")).where("pos IS NOT NULL").select(item, "pos", F.to_json("_q").alias("question_json"))
    rest = rows.where(F.col("_found").isNull() & F.contains(F.col(text), F.lit("{")))
    return good.unionByName(_in_python(rest, item, text, parse_response))


def first_array(text: str | None) -> list:
    """A list of one: the first outermost JSON array of the text, if there is one."""
    return [v for v in loaded(outermost(text or "")) if isinstance(v, list)][:1]


def extracted_arrays(responses: DataFrame, item: str, text: str) -> DataFrame:
    """(item, array_json, arm): the JSON array of an answer in a tag or fenced block ("marked"), or else the first balanced one outside objects ("brackets"). Answers without an array have no row."""
    rows = responses.select(item, text).withColumn("_found", extracted_json(F.col(text)))
    marked = rows.where("_found IS NOT NULL").select(item, F.to_json(F.parse_json(F.trim("_found", F.lit(" \t\r\n")))).alias("array_json"), F.lit("marked").alias("arm"))
    rest = rows.where(F.col("_found").isNull() & F.contains(F.col(text), F.lit("[")))
    return marked.unionByName(_in_python(rest, item, text, first_array).select(item, F.col("question_json").alias("array_json"), F.lit("brackets").alias("arm")))
