"""Trees with cycles, windows of real tokens, metrics of writes and streams, copies of questions."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievewright.functions import tokenizer as T
from sievewright.operators import joins, observed, questions, trees
from tests.conftest import SF

EDGES = "category string, parent_category string"
FILE = public_tokenizers.path("word_bpe_49k.json")


def test_closure_of_deep_and_cyclic_edges(spark):
    chain = [(f"n{k + 1:02}", f"n{k:02}") for k in range(12)]
    rows = {(r["node"], r["ancestor"]): r["level"] for r in trees.closure(spark.createDataFrame(chain, EDGES)).collect()}
    assert rows == {(f"n{b:02}", f"n{a:02}"): b - a for b in range(13) for a in range(b)}
    cyclic = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d"), (None, "a"), ("e", None), ("d", "a"), ("d", "c")], EDGES)
    assert {(r["node"], r["ancestor"], r["level"]) for r in trees.closure(cyclic).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "c", 1), ("d", "b", 2)}
    assert {tuple(r) for r in joins.subcategories(spark, cyclic, "b").collect()} == {("a", 1), ("c", 2), ("d", 2)}
    assert trees.closure(cyclic.limit(0)).count() == 0 and joins.subcategories(spark, cyclic, "nowhere").count() == 0


def test_roll_up_counts_a_result_once(spark):
    diamond = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "a")], EDGES)
    results = spark.createDataFrame([("d", True), ("d", False), ("b", True), ("x", False), (None, True), ("c", None)], "category string, is_correct boolean")
    got = {r["node"]: (r["n"], r["correct"]) for r in trees.rolled_up(diamond, results).collect()}
    assert got == {"a": (4, 2), "b": (3, 2), "c": (3, 1), "d": (2, 1), "e": (0, 0), "x": (1, 0)}


def test_lowest_failing(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("p", "q"), ("q", "p"), ("q", "a")], EDGES)
    rows = [("c", False)] * 40 + [("d", True)] * 5 + [("p", False)] * 30
    scores = trees.rolled_up(edges, spark.createDataFrame(rows, "category string, is_correct boolean"))
    assert {r["node"] for r in scores.where("high < 0.5").collect()} == {"a", "b", "c", "p", "q"}
    assert {r["node"] for r in trees.lowest_failing(edges, scores, 0.5).collect()} == {"c", "p"}


def test_windows_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    library = T.loaded(FILE)
    want = set()
    for r in docs.collect():
        e = library.encode(r["text"], add_special_tokens=False)
        for k, start in enumerate(range(0, len(e.ids), 150)):
            span = e.offsets[start : start + 200]
            want.add((r["doc_id"], k, len(span), hashlib.md5(r["text"][span[0][0] : span[-1][1]].encode()).hexdigest()))
    got = T.token_windows(docs, FILE, 200, 50).select("doc_id", "chunk_index", "n_tokens", F.md5(F.col("text").cast("binary")))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    counts = docs.select("text", T.token_counts(F.col("text"), FILE).alias("n")).collect()
    assert all(r["n"] == len(library.encode(r["text"], add_special_tokens=False).ids) for r in counts)


def test_windows_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "😀 é́ naïve"), (5, "a" * 3000), (6, "one two three")], "doc_id long, text string")
    rows = T.token_windows(docs, FILE, 2, 0).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {4, 5, 6} and "".join(r["text"] for r in rows if r["doc_id"] == 5) == "a" * 3000
    assert [r["text"] for r in rows if r["doc_id"] == 6][0].startswith("one") and rows[0]["chunk_id"] == "4::chunk_0000"
    assert T.repaired_windows(docs, FILE).count() == 3
    with pytest.raises(ValueError):
        T.token_windows(docs, FILE, 5, 5)


def test_metrics_of_a_write(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    measures = observed.builder_measures(F.col("x").isNull(), F.col("x") % 4 == 0, F.col("x") > 989)
    got = observed.write_observed(df, str(tmp_path / "t"), measures)
    assert {k: got[k] for k in ("total", "skipped", "errors", "warnings")} == {"total": 1000, "skipped": 100, "errors": 200, "warnings": 9}
    assert got["skipped_rate"] == 0.1 and got["rows_per_second"] > 0 and spark.read.parquet(str(tmp_path / "t")).count() == 1000
    none = observed.write_observed(df.limit(0), str(tmp_path / "none"), measures)
    assert none["total"] == 0 and none["skipped_rate"] == 0.0


def test_metrics_of_a_stream(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "id % 3 AS k")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    progress = observed.Progress()
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watched = stream.observe("build", F.count(F.lit(1)).alias("total"), F.count_if(F.col("k") == 0).alias("skipped"))
        watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        import time

        for _ in range(100):
            if progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.totals("build") == {"total": 300, "skipped": 100} and len(progress.batches) == 3


def test_copies_of_a_question_are_spread(spark):
    """Nine rows of ten ask the same; the answers are those of all pairs."""
    rows = [(k, "Why?" if k % 10 else f"What is {k}?", "answer", "c1") for k in range(500)] + [(500, " why? ", "a", "c1"), (501, None, "a", "c2"), (502, "", "", "c1"), (None, "Why?", "a", "c1"), (1, "Why?", "again", "c1")]
    df = spark.createDataFrame(rows, "question_id long, question string, answer string, chunk_id string")
    out = questions.validator_reasons(df, spark.createDataFrame([("c1",), ("c1",)], "chunk_id string")).collect()
    assert len(out) == len(rows)
    duplicate = {(r["question_id"], r["answer"]) for r in out if "duplicate" in r["reasons"]}
    assert duplicate == {(k, "answer") for k in range(500) if k % 10 and k > 1} | {(500, "a")}


def test_evidence_that_many_questions_name_is_spread(spark):
    """Texts aren't shuffled for the reasons, nor are rows by the chunk they name; null items and missing chunks are kept."""
    rows = [(k, f"question {k % 50}", "an answer " * 20, "none" if k % 2 else f"c{k % 7}") for k in range(400)] + [(None, "alone", "", "c1"), (500, None, "x", None)]
    df = spark.createDataFrame(rows, "question_id long, question string, answer string, chunk_id string")
    out = questions.validator_reasons(df, spark.createDataFrame([(f"c{k}",) for k in range(6)], "chunk_id string"))
    got = {r["question_id"]: (r["reasons"], r["status"]) for r in out.collect()}
    assert len(got) == out.count() == 402 and {"question", "answer", "chunk_id"} <= set(out.columns)
    for k in range(400):
        want = (["duplicate"] if k >= 50 else []) + (["missing_evidence"] if k % 2 or k % 7 == 6 else [])
        assert got[k] == (want, "accepted" if not want else "repairable" if want == ["missing_evidence"] else "rejected")
    assert got[None] == (["empty_answer"], "repairable") and got[500] == (["empty_question", "missing_evidence"], "rejected")
    narrow = out.select("question_id", "reasons", "status")
    plan = narrow._sc._jvm.PythonSQLUtils.explainString(narrow._jdf.queryExecution(), "simple")
    assert "hashpartitioning(chunk_id" not in plan and "hashpartitioning(_question" in plan


def _plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_texts_are_encoded_once_for_their_windows(spark):
    import public_tokenizers

    from sievewright.functions import tokenizer

    df = spark.createDataFrame([(1, "some words here"), (2, None), (3, "")], "doc_id long, text string")
    out = tokenizer.token_windows(df, public_tokenizers.path("word_bpe_49k.json"), 2, 1)
    assert _plan(out).count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in out.collect()} == {1}
