"""Answers of models, whole and broken: VARIANT columns against the parser of one text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import questions as Q

ITEM = {"question": "Why is \"[x]\" {odd}?", "answer": "Because\nof é", "citations": [{"chunk_id": "a", "text": "}]{["}, {"text": None}], "n": [1, 2.5, {"z": []}]}
ONE, TWO = json.dumps(ITEM), json.dumps({"question": "b", "a": {"b": {"c": "d"}}})
TEXTS = [
    None, "", "nothing", "{", "[", "[]", "{}", "[1, 2]", ONE, f"[{ONE}, {TWO}]", f"[{ONE}, {TWO}", f"[{ONE}, {TWO[:-4]}", f"say [{ONE}] and [{TWO}]", f"{ONE} {TWO}", f"[1] [2] {TWO}",
    f"<output_json>[{ONE}]</output_json>", f"<output_json>nope</output_json><output_json>[{TWO}]</output_json>", f"```json\n[{ONE}]\n```", f"```\n{TWO}\n```", f"<output_json>```json\n[{TWO}]```</output_json>", f"```json\n[{ONE}",
    f'{{"questions": [{ONE}], "items": [1]}}', f'{{"questions": "x", "data": [{TWO}, 7]}}', '{"questions": [1]}', f'{{"questions": [3]}} then {TWO}', '{"a": 1, "a": 2}', "[{'a': 1}]", '[{"a": 1},]', '{"a": NaN}', '["s", null, [{"deep": 1}]]',
    f'{{"broken": [{ONE}', f"a {{stray [{TWO}] ", f"}} ] {ONE}", "[" * 500, '{"x": "' + "y" * 50_000 + '"}', f'"quoted [" {TWO}', '{"a": "\\"}"}', f"﻿{TWO}", f"  \n[{TWO}]\n\n",
]


def plain(rows):
    return sorted((r["i"], r["pos"], json.dumps(json.loads(r["question_json"]), sort_keys=True)) for r in rows)


def test_variant_and_python_agree(spark):
    r = random.Random(7)
    parts = [ONE, TWO, "[", "]", "{", "}", ", ", '"', "text ", "```", "```json", "<output_json>", "</output_json>", "[1]", "\\", "\n", '{"questions": ']
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = sorted((i, k, json.dumps(q, sort_keys=True)) for i, t in enumerate(texts) for k, q in enumerate(Q.parse_response(t)))
    assert plain(Q.parsed(df, "i", "t").collect()) == want and len(want) > 100


def test_well_formed_answers_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(0, ONE), (1, f"[{ONE}, {TWO}]"), (2, f"```json\n[{ONE}]\n```"), (3, f"<output_json>{TWO}</output_json>"), (4, "no json at all"), (5, None)], "i int, t string")
    rest = df.where(Q.well_formed_questions(F.col("t")).isNull() & F.contains("t", F.lit("{")))
    assert rest.count() == 0 and Q.parsed(df, "i", "t").count() == 5
    assert Q.parsed(df.limit(0), "i", "t").count() == 0


def test_a_value_must_end_where_the_text_ends(spark):
    df = spark.createDataFrame([("[1]",), ("[1] x",), ("[1],[2]",), (' {"a": 1} ',), ('{"a": 1} {"b": 2}',), ("null",), ("",)], "t string")
    got = [r[0] for r in df.select(F.to_json(Q.whole_json(F.col("t")))).collect()]
    assert got == ["[1]", None, None, '{"a":1}', None, "null", None]


@pytest.mark.parametrize("text, want", [("a [b] [1, 2] [3]", [1, 2]), ("x [[1], [2]] y", [[1], [2]]), ("[1, [2, 3]", [2, 3]), ('{"a": [1]}', None), ("none", None), (f"```json\n[{TWO}]\n``` [9]", [json.loads(TWO)]), ("<output_json> [5] </output_json>", [5])])
def test_first_arrays(spark, text, want):
    rows = Q.extracted_arrays(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").collect()
    assert [json.loads(r["array_json"]) for r in rows] == ([] if want is None else [want])


def test_scan_is_linear():
    import time

    began = time.time()
    assert Q.outermost("[{" * 200_000) == [] and Q.outermost("[" * 200_000 + "]" * 200_000) == ["[" * 200_000 + "]" * 200_000]
    assert Q.parse_response("[" * 100_000 + "]" * 100_000) == []
    assert time.time() - began < 10


def test_answers_are_not_parsed_for_a_filter_on_what_is_found(spark):
    """Only answers that aren't well formed are told by a filter; those that are get their questions in the same pass."""
    from sievewright.operators import questions

    df = spark.range(3).selectExpr("id", """CASE id WHEN 0 THEN '[{"question": "q"}, 3, {"question": "r"}]' WHEN 1 THEN 'x {"question": "s"} y' END AS said""")
    out = questions.parsed(df, "id", "said")
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert sum("Filter" in line and "parsejson" in line.lower().replace("_", "") for line in plan.splitlines()) == 1, [x for x in plan.splitlines() if "Filter" in x]
    assert sorted((r["id"], r["pos"], r["question_json"].replace(" ", "")) for r in out.collect()) == [(0, 0, '{"question":"q"}'), (0, 1, '{"question":"r"}'), (1, 0, '{"question":"s"}')]


def test_responses_go_back_in_large_parts_whatever_a_call_takes():
    from sievewright.models import clients

    sizes = []

    class Counted(clients.OfflineClient):
        def complete(self, prompts):
            sizes.append(len(prompts))
            return super().complete(prompts)

    prompts = [f"Text {k}. More." for k in range(3_000)]
    parts = list(clients.said(Counted(), prompts))
    assert len(parts) == 3 and [p for asked, _, _ in parts for p in asked] == prompts
    assert set(sizes) == {16, 3_000 % 16} and all("Text" in t for _, texts, _ in parts for t in texts)
    assert len(list(clients.said(Counted(), ["x" * 1_000_000] * 32))) == 2


def test_a_client_with_too_few_responses_gives_errors(spark):
    from sievewright.models import clients

    class Short(clients.OfflineClient):
        def complete(self, prompts):
            return super().complete(prompts)[: 16 - 1]

    rows = clients.responses(spark.range(20).selectExpr("id", "array(id) AS a", "if(id = 3, null, 'One. Two.') AS prompt").coalesce(1), Short()).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(20)) and rows[3]["prompt"] == "" and rows[5]["a"] == [5] and rows[5]["input_tokens"] == 2
    assert [r["error"] is None for r in rows] == [False] * 16 + [True] * 4 and rows[0]["text"] is None and "15 responses to 16" in rows[0]["error"]
