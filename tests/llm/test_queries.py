"""The queries on the smallest tables, against SQL or held-out labels, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewright.llm import decontaminate, queries, rules, simhash
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_reruns_agree(spark):
    a, b = (sorted(map(tuple, queries.op10_quality(spark, SF).collect())) for _ in range(2))
    assert a == b
    a, b = (sorted(map(tuple, queries.op3_toxicity(spark, SF).collect())) for _ in range(2))
    assert a == b


def auc(rows, label):
    good, bad = ([r["score"] for r in rows if r[label] == v] for v in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    big = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    quality = queries.op10_quality(spark, big).where("held_out").join(labels, "doc_id").collect()
    assert auc(quality, "quality") > 0.98 and sum(r["predicted"] == r["quality"] for r in quality) / len(quality) > 0.97
    toxic = queries.op3_toxicity(spark, big).where("held_out").join(labels, "doc_id").collect()
    assert auc(toxic, "toxic") > 0.9
    assert sum(r["predicted"] for r in toxic if r["toxic"] == 0) <= 2
    assert sum(r["predicted"] for r in toxic if r["toxic"] == 1) / sum(r["toxic"] for r in toxic) > 0.85


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, SF), f"test-{name}")
        if name != "tokens":
            assert docs.columns == columns
            ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
            old = before.collect()
        if name == "quality":
            scores = rules.scored(before, rules.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert ids == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        elif name == "near_duplicates":
            from tests.llm.test_edges import union_find

            sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], corpus_pipeline.SHINGLE).tolist()) for r in old}
            order = sorted(sets)
            alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert ids == set(union_find([(a, b) for a in order for b in order if a < b and alike(a, b)], order).values()) and docs.count() == len(ids)
        elif name == "decontaminate":
            found = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()
            assert ids == {r["doc_id"] for r in old} - {r["doc_id"] for r in found}
        elif name == "mix":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        else:
            assert docs.count() == before.count() and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def words_of(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_near_duplicates_against_all_pairs(spark):
    import random

    from tests.llm.test_edges import union_find

    r = random.Random(8)
    texts = []
    for i in range(12):
        text = [f"w{r.randint(0, 2000)}" for _ in range(r.randint(60, 200))]
        for _ in range(12):  # a chain of edits
            texts.append(" ".join(text))
            at = r.randrange(len(text))
            text = text[:at] + words_of(f"n{i}_{len(texts)}_", r.randint(0, len(text) // 12)) + text[at + len(text) // 20 :]
    r.shuffle(texts)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF)
    want = set(union_find(pairs, range(len(texts))).values())
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want) and len(want) < len(texts) / 2


def test_repeated_lines_do_not_make_near_duplicates(spark):
    line = " ".join(words_of("line", 7)) + "\n"
    texts = [line * 600 + " ".join(words_of(f"d{i}_", 200)) for i in range(6)]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    assert max((a ^ b).bit_count() for a in fps for b in fps) <= 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, df, SF).count() == 6


def test_null_and_shared_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    text = {k: " ".join(words_of(k, 40)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (None, item), (7, text["c"]), (7, text["d"]), (7, text["d"]), (7, f"x {item} y"), (8, text["d"]), (None, text["c"]), (9, None), (None, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = corpus_pipeline.near_duplicates(spark, df, SF)
    as_set = lambda d: sorted(map(str, map(tuple, d.collect())))
    left = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (9, None)]
    assert once.columns == df.columns
    assert [r for r in as_set(once) if item not in r] == sorted(map(str, left))
    clean = corpus_pipeline.decontaminated(spark, df, SF)
    assert clean.columns == df.columns and as_set(clean) == sorted(str(r) for r in rows if item not in (r[1] or ""))


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    others = [p for p in (root / "sievewright").rglob("*.py") if "llm" not in p.parts]
    assert others and not any("sievewright.llm" in p.read_text() for p in others)
