"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, edit_counts, license_scan, mixing, queries, rules, simhash, similar, token_files, topk, toxicity, warc
from sievewright.llm.common import Scratch, shared_dir

LONG = "word " * 200_000 + "all rights reserved"
DOCS = [
    (1, "All rights reserved. Licensed under CC BY-NC 4.0.", "a"), (1, "All rights reserved. Licensed under CC BY-NC 4.0.", "a"), (2, None, None), (3, "", "b"), (4, "   \n", "b"), (None, "GNU General Public License " * 3, None),
    (5, LONG, "c"), (6, "KK İı ſ É 日本 \U0001f642", "a"), (7, "cc by", ""),
]
SCHEMA = "doc_id long, text string, source string"
#: Names that the operators use inside or return.
CLASH = {"label": "x", "size": "x", "score": "x", "_words": 1, "fp": "x", "target": "x", "copies": "x", "_s": 1, "n_words": "x", "_row": 1, "taken": 2, "w": 1, "_label": "q", "held_out": 3}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def arrow(df):
    return pa.Table.from_pylist([r.asDict() for r in df.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))


def test_license_scan(spark, docs, empty, same):
    same(license_scan.scan(docs), license_scan.scan_sql(), documents=arrow(docs.select("doc_id", "text", "source")))
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert got[1]["base_labels"] == "cc-by,reserved" and got[1]["labels"] == "cc-by,cc-by-nc,reserved" and got[1]["score"] == 1.0
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", 0.0)
    assert got[None]["n_base"] == 3 and got[5]["last_word"] == 200_000 and got[5]["n_words"] == 200_003
    assert license_scan.scan(docs).count() == len(DOCS) and license_scan.scan(empty).count() == 0
    assert license_scan.scan(docs, {}, []).where("n_base = 0 AND score = 0").count() == len(DOCS)


def test_licenses_are_told_apart_by_single_words(spark):
    cases = {
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "Licensed under the GNU General Public License version 2.0": "gpl", "This work is licensed under the GNU General Public License version 2": "gpl",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0", "Released under the BSD license": "", "Released under the MIT license.": "mit", "Creative Commons Attribution License": "", "Creative Commons Attribution-ShareAlike License": "cc-by-sa",
        "the license was released under pressure": "", "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and the documentation files": "mit",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_license_phrases_that_repeat_words_or_leave_ascii(spark, same):
    phrases, notices = {"no yes no": "x", "Droits Réservés": "fr", "X11 License": "x11"}, [("mit-x", "The X11 License Égale")]
    texts = ["yes yes yes no yes no yes yes yes", "no yes no yes no", "DROITS RéSERVéS. Droits Réservés; droits RÉSERVÉS", "x11 LICENSE", "the x11 license Égale", "the x11 license égale", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    same(license_scan.scan(df, phrases, notices), license_scan.scan_sql(phrases, notices), documents=arrow(df))
    got = {r["doc_id"]: r for r in license_scan.scan(df, phrases, notices).collect()}
    assert [got[i]["n_base"] for i in range(7)] == [1, 2, 2, 1, 1, 1, 0] and [got[i]["score"] for i in (4, 5)] == [1.0, 1.0]
    # places are many and the text is long: each place keeps only the words around it
    long = spark.createDataFrame([(1, "all rights reserved " * 60_000, "s")], SCHEMA)
    assert license_scan.scan(long).first()["n_base"] == 60_000


def test_license_containment_against_brute_force(spark):
    import math
    import random
    import re

    r = random.Random(3)
    words = "licensed under the apache license version 2 0 mit released x y z of all".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["labels"], round(x["score"], 9), x["n_base"]) for x in license_scan.scan(df, {"of all": "o"}).collect()}
    for i, t in enumerate(texts):
        w, labels, best = re.findall(r"[0-9a-z]+", t), set(), 0.0
        base = sum(w[k : k + 2] == ["of", "all"] for k in range(len(w)))
        if base:
            labels, best = {"o"}, 1.0
        for label, notice in license_scan.NOTICES:
            n = notice.split()
            for b in range(0, len(w), len(n)):
                share = len(set(n) & set(w[b : b + 2 * len(n)])) / len(set(n))
                need = len(set(n)) if len(set(n)) < 15 else math.ceil(0.8 * len(set(n)) - 1e-9)  # of short notices, every word tells
                if share * len(set(n)) >= need:
                    labels.add(label)
                    best = max(best, share)
        assert got[i] == (",".join(sorted(labels)), round(best, 9), base), t


def test_topk(spark, same):
    v = [(0, [0.1, -0.2]), (0, [0.3, 0.4]), (50, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (8, []), (100, []), (-50, [-0.1, 0.1]), (9, [3.0, -1.0]), (150, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))
    table = pa.table({"vec_id": pa.array([a for a, _ in v], pa.int64()), "embedding": pa.array([b for _, b in v], pa.list_(pa.float32()))})
    got = topk.top_k(df).select("query_id", "rank", "vec_id", "score")
    same(got, topk.top_k_sql(), embeddings=table)
    assert topk.top_k(df.where("false")).count() == 0
    big = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(big).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_topk_with_many_blocks_and_ties(spark, same, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    v = np.random.default_rng(0).integers(-2, 3, (900, 4)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    table = pa.table({"vec_id": pa.array(range(900), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float64()))})
    same(topk.top_k(df).select("query_id", "rank", "vec_id", "score"), topk.top_k_sql(), embeddings=table)


@pytest.mark.parametrize("clusters, share, bounds", [(0, 0.75, 1.0), (20, 0.2, 0.1)])
def test_topk_eliminates(spark, same, clusters, share, bounds):
    """Fewer inner products than pairs, the head start included, even for vectors without any structure; blocks of clusters are passed over without a bound of their rows."""
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(4000, 64))
    if clusters:
        v = 3 * r.normal(size=(clusters, 64))[r.integers(0, clusters, 4000)] + v / 3
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3).withColumn("row", F.lit("x"))
    got = topk.top_k(df).cache()
    same(got.select("query_id", "rank", "vec_id", "score"), topk.top_k_sql(), embeddings=pa.table({"vec_id": pa.array(range(4000), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32()))}))
    each = got.select("row", "bounded", "evaluated").distinct().collect()
    assert len(each) == 80 and sum(x["evaluated"] for x in each) < share * 80 * 4000
    assert all(x["evaluated"] <= x["bounded"] for x in each)
    head = 80 * topk.SEED_ROWS  # the head start bounds all its rows
    assert head < sum(x["bounded"] for x in each) <= head + bounds * 80 * 4000


def test_topk_leaves_no_tables(spark, tmp_path):
    """Of a search only its written result stays in the shared folder."""
    import os

    df = spark.createDataFrame([(i, [i / 7, 1.0, -i / 3]) for i in range(300)], "vec_id long, embedding array<double>")
    root = shared_dir(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    root = "/" + root.lstrip("/")
    before = set(os.listdir(root))
    assert topk.top_k(df).count() == 30
    assert [x.split("-")[0] for x in set(os.listdir(root)) - before] == ["nearest"]


def test_topk_of_one_vector_many_times(spark, same):
    """A third of all rows share a vector, more than a block of them."""
    v = [(i, [1.0, 2.0, 0.5] if i % 3 else [i / 100, -i / 50, 3.0]) for i in range(1200)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4)
    same(topk.top_k(df).select("query_id", "rank", "vec_id", "score"), topk.top_k_sql(), embeddings=pa.table({"vec_id": pa.array([a for a, _ in v], pa.int64()), "embedding": pa.array([b for _, b in v], pa.list_(pa.float64()))}))


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, f"plain w{i} words here " + (f"scum x{i} scum" if i % 2 else "fine")) for i in range(40)], "doc_id long, text string")
    field = toxicity.train(texts, labels)
    assert b"w:scum" in field.features
    got = {r["doc_id"]: r for r in toxicity.scored(texts, field).collect()}
    assert all((r["predicted"] == 1) == (i % 2 == 1) for i, r in got.items())
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(20, 24), (28, 32)]
    assert toxicity.scored(docs, field).count() == len(DOCS) and toxicity.scored(empty, field).count() == 0
    none = toxicity.train(empty, labels.where("false"))
    assert toxicity.scored(docs, none).where("score BETWEEN 0 AND 1 AND predicted = 0").count() == len(DOCS)
    assert toxicity.scored(docs, field).where("doc_id IS NULL AND NOT held_out").count() == 1


def toxic_texts():
    """1600 texts; every second one is toxic, by one of many words that share a beginning, or by any word behind a marker."""
    import numpy as np

    r, texts, labels = np.random.default_rng(4), [], []
    word = lambda k: "w" + "".join(chr(97 + int(c)) for c in str(k))
    for i in range(1600):
        plain = [word(k) for k in r.integers(0, 400, 30)]
        at = int(r.integers(1, 29))
        if i % 2 and i % 4 == 1:
            plain[at] = "scum" + word(r.integers(0, 10**6))
        elif i % 2:
            plain[at : at + 2] = ["youfilthy", word(r.integers(0, 400))]
        texts.append(" ".join(plain))
        labels.append(i % 2)
    return texts, np.array(labels)


def test_toxic_tokens_beyond_any_listed_word():
    import numpy as np

    texts, labels = toxic_texts()
    field = toxicity.fit(texts, labels)
    tagger = toxicity.Tagger(field)

    def p(text):
        return tagger.run([tagger.ids(text)])[0][0]

    # a word that no text of the sample has, by its beginning
    assert b"w:scumlike" not in field.features and p("wb wc scumlike wd")[2] >= toxicity.SPAN > p("wb wc other wd").max()
    # a word that plain texts have as well, by the word before it; and not without that word
    assert b"w:wh" not in field.features and p("wb youfilthy wh wd")[2] > 2 * p("wb wc wh wd")[2]
    # a token's marginal depends on marginals beside it, over transitions
    alone, beside = p("wb wc wd we"), p("wb wc scumlike we")
    assert alone[3] != beside[3]
    # held-out texts
    more, truth = toxic_texts()
    scores = tagger.run([tagger.ids(t.replace("scum", "scumx")) for t in more])[1]
    assert np.mean((scores >= 0.5) == (truth == 1)) > 0.97


def test_marks_of_late_texts_are_fitted():
    import numpy as np

    texts, labels = [], []
    for i in range(1600):
        bad = i % 2
        word = "scum" if i < 1300 else "filth"
        texts.append(f"plain w{i} words here " + (f"{word} x{i} {word}" if bad else "fine"))
        labels.append(bad)
    field = toxicity.fit(texts, np.array(labels))
    tagger = toxicity.Tagger(field)
    early, late = (tagger.run([tagger.ids(f"a {w} b")])[0][0] for w in ("scum", "filth"))
    assert min(early[1], late[1]) >= toxicity.SPAN


def test_marginals_against_enumeration():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    f = toxicity.Field({}, np.zeros(1), np.array([[0.0, -0.2], [-0.7, 0.9]]), -0.4, np.zeros(5))
    z = [rng.normal(size=n) for n in (1, 0, 2, 5, 9, 8, 0)]
    piece, toxicity.PIECE = toxicity.PIECE, 3
    try:
        p, both, none = toxicity.marginals(f, np.concatenate(z), np.array([len(x) for x in z]))
    finally:
        toxicity.PIECE = piece
    at = 0
    for k, x in enumerate(z):
        if not len(x):
            assert none[k] == 0
            continue
        total, marked, pair, clean = 0.0, np.zeros(len(x)), np.zeros((2, 2, len(x))), 0.0
        for states in product((0, 1), repeat=len(x)):
            w = np.exp(f.first * states[0] + sum(s * x[i] + (f.move[states[i - 1], s] if i else 0) for i, s in enumerate(states)))
            total += w
            clean += w * (not any(states))
            marked += w * np.array(states)
            for i, s in enumerate(states):
                pair[states[i - 1] if i else 0, s, i] += w
        assert abs(marked / total - p[at : at + len(x)]).max() < 1e-12 and abs(pair / total - both[:, :, at : at + len(x)]).max() < 1e-12
        assert abs(np.log(clean / total) - none[k]) < 1e-12
        at += len(x)
    long = rng.normal(size=500)
    whole = toxicity.marginals(f, long, np.array([500]))
    piece, toxicity.PIECE = toxicity.PIECE, 501
    try:
        again = toxicity.marginals(f, long, np.array([500]))
    finally:
        toxicity.PIECE = piece
    assert all(abs(a - b).max() < 1e-12 for a, b in zip(whole, again))


def test_toxicity_query_against_brute_force(spark):
    """Scores and spans of the whole table by plain recursions, one text at a time."""
    import math

    from tests.conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, field).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    weight = lambda f: field.weights[field.features[f]] if f in field.features else 0.0
    move = [[math.exp(field.move[a][b]) for b in (0, 1)] for a in (0, 1)]
    for i, text in texts.items():
        found = toxicity.tokens(text)
        e = []
        for k, t in enumerate(found):
            z = field.weights[-1] + sum(map(weight, toxicity.own_features(t)))
            z += weight(toxicity.after(found[k - 1])) if k else 0.0
            z += weight(toxicity.before(found[k + 1])) if k + 1 < len(found) else 0.0
            e.append((1.0, math.exp(z)))
        ahead, behind = [], [(1.0, 1.0)]
        for k, w in enumerate(e):
            now = (1.0, math.exp(field.first) * w[1]) if not k else tuple(sum(ahead[-1][a] * move[a][b] for a in (0, 1)) * w[b] for b in (0, 1))
            ahead.append((now[0] / sum(now), now[1] / sum(now)))
        for w in reversed(e[1:]):
            now = tuple(sum(move[a][b] * w[b] * behind[-1][b] for b in (0, 1)) for a in (0, 1))
            behind.append((now[0] / sum(now), now[1] / sum(now)))
        p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, reversed(behind))]
        none = 0.0
        for k, b in enumerate(list(reversed(behind))[: len(e)]):
            to = math.exp(field.first) if not k else move[0][1]
            none -= math.log1p(to * e[k][1] * b[1] / b[0])
        x = [1 - math.exp(none), max(p, default=0.0), math.log1p(sum(p)), sum(p) / len(p) if p else 0.0, 1.0]
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, field.head))))))
        assert abs(score - got[i]["score"]) < 1e-9 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
        marked = [k for k, v in enumerate(p) if v >= toxicity.SPAN]
        places = [m.span() for m in __import__("re").finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
        runs = [k for k in marked if k - 1 not in marked]
        ends = [k for k in marked if k + 1 not in marked]
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == [(places[a][0], places[b][1]) for a, b in zip(runs, ends)]


def test_warc(spark, same):
    big, other = "<p>é" + "x" * 200, "y" * 100
    pages = [(3, "u", big), (1, "u\r\nX-Evil: 1", big), (2, None, big), (2, "u", big), (4, "u", "short"), (5, "v", "short"), (6, "w", None), (7, "w", ""), (None, "n", big), (None, "n", "z" * 150), (8, "a: b", other), (9, "", other), (1, "u", big), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"record_type": F.lit(1), "payload_bytes": F.lit("x"), "_n": F.lit(1)})
    table = pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "html": pa.array([p[2] for p in pages], pa.string())})
    folder = shared_dir(spark, "warc")
    import os

    root = "/" + folder.removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    before = set(os.listdir(root))
    archives = warc.archive(df.repartition(3), folder)
    assert {x.split("-")[0] for x in set(os.listdir(root)) - before} == {"warc"}
    got = warc.read_archives(spark, folder, archives)
    same(got.drop("url"), warc.archive_sql(), pages=table)
    assert {r["payload_digest"] for r in got.where("page_id = 10").collect()} == {hashlib.sha256(pages[-1][2].encode()).hexdigest()}
    assert warc.archive(df.where("false"), folder) == [] and warc.read_archives(spark, folder, []).count() == 0


def test_warc_record_ids_tell_payloads_apart():
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, "b")]
    assert len({warc.record_id(*r) for r in rows}) == 4
    import re

    revisit = warc.record(2, "u", "d1", 3, None, 1).decode()
    assert re.search("WARC-Refers-To: (.*)\r", revisit)[1] == warc.record_id(1, "d1") != warc.record_id(1, "d2")


def test_warc_damage_is_found(spark, tmp_path):
    raw = warc.record(1, "u", "0" * 64, 3, b"abc", None)
    import gzip

    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"file://{tmp_path}", [{"path": str(tmp_path / "x.warc.gz")}]).collect()


def test_mixing(spark, docs, empty, same):
    got = mixing.plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    same(got, mixing.mix_sql(), documents=arrow(docs.select("doc_id", "text", "source")))
    assert mixing.plan(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_mixing_stays_near_the_targets(spark):
    """Within the largest document, and five standard deviations of the sizes of a class, on whole tables."""
    from tests.conftest import SF

    for sf in (SF, SF.replace("0.001", "0.01")):
        got = mixing.plan(spark.read.parquet(f"{sf}/documents.parquet"))
        for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"), F.max("size").alias("m"), F.sum(F.col("size") * F.col("size")).alias("q")).collect():
            assert abs(r["k"] - r["t"]) <= r["m"] + 5 / 32 * r["q"] ** 0.5


def test_mixing_of_hot_sources_classes_and_ids(spark, same, monkeypatch):
    """Most rows of one source and one size, many of them without an id; ranges so few that each has many rows."""
    monkeypatch.setattr(mixing, "RANGES", 2)
    rows = [(i if i % 5 else None, "w " * (40 if i % 10 else 1 + i % 700), "hot" if i % 20 else ("x", "null", None)[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("whole", "bar", "class", "u", "_source", "_class", "need")})
    got = mixing.plan(df)
    assert set(df.columns) | {"size", "source_size", "target", "copies"} == set(got.columns)
    digest = got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    same(digest, mixing.mix_sql().replace("documents", "(SELECT doc_id, text, source FROM documents)"), documents=arrow(df.select("doc_id", "text", "source")))
    assert sorted(digest.collect(), key=str) == sorted(mixing.plan(df.repartition(7)).select(*digest.columns[:-1], (F.col("size") * F.col("copies")).alias("taken")).collect(), key=str)


def test_mixing_many_sources_by_shuffle(spark, same, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_CLASSES", 3)
    rows = [(i, "w " * (1 + i * i % 37), f"s{i % 23}" if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(df).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    same(got.drop("source"), mixing.mix_sql(), documents=arrow(df))
    totals = got.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("n"), F.sum("taken").alias("k")).collect()
    assert abs(sum(r["t"] for r in totals) / sum(r["n"] for r in totals) - 1.5) < 1e-9
    assert all(r["t"] <= 2 * r["n"] + 1e-6 for r in totals)
    assert abs(sum(r["k"] for r in totals) / sum(r["t"] for r in totals) - 1) < 0.1


def test_token_files(spark, docs, empty):
    import zlib

    import numpy as np
    import pyarrow.fs as pafs
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["ÉTÉ Œuvre ẞ İstanbul K ﬁ", "don't I'LL can't 'S", "a<|endoftext|>b <|ENDOFTEXT|>", "áb é", "日本語 ٣", "x y　", "\x00\x01 ab\x1fcd", "ΑΣ ς", "ª º ² ½ ÷ 10²"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    folder = shared_dir(spark, "tokens")
    shards = token_files.write_token_files(more, folder, path, sequence=64, partitions=3)
    got = token_files.read_token_files(spark, folder, shards).collect()
    texts = {r["doc_id"]: r["text"] for r in more.collect()}
    assert len(got) == more.count()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    store, _ = pafs.FileSystem.from_uri(folder)
    last = max(shards, key=lambda s: s["n_ids"])
    k = -(-last["n_ids"] // 64) - 1
    ids, mask = token_files.sequence_at(store, last["ids"], k)
    assert mask.sum() == last["n_ids"] - 64 * k and not ids[~mask].any() and ids[mask][-1] == 2
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty, folder, path)).count() == 0


def test_other_tokenizers_encode_too(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    folder = shared_dir(spark, "tokens")
    df = spark.createDataFrame([(1, "Hello, world"), (2, None)], "doc_id long, text string")
    got = token_files.read_token_files(spark, folder, token_files.write_token_files(df, folder, path, end_id=50256)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [4, 1]


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("chunk", [1, 10**6])
def test_components(spark, monkeypatch, chunk):
    import random

    from sievewright.llm import components

    monkeypatch.setattr(components, "CHUNK", chunk)  # 1: nothing but single batches is contracted
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(-30, 40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 2)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(r.sample(pairs, len(pairs)), "a long, b long").repartition(7)).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    want = union_find(pairs, {n for p in pairs for n in p})
    assert got == {n: want[n] for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_fingerprint_is_the_contracts():
    import xxhash

    words = [f"w{i % 7}" for i in range(30)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(28)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 28)
    assert simhash.fingerprint("\x0b" + " \n".join(words).upper() + "\t") == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0 and simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b".encode(), 42)


def test_golay_keys_miss_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    near = []
    for n in range(1, 6):
        for fp in fps[:80]:
            for b in rng.choice(64, n, replace=False):
                fp = np.bitwise_xor(fp, np.uint64(1 << int(b)).view(np.int64))
            near.append(int(fp))
    every = sorted({*map(int, fps), *near, 0})
    u = np.array(every).view(np.uint64)
    want = {(every[i], every[j]) for i in range(len(every)) for j in np.nonzero(np.bitwise_count(u ^ u[i]) <= 3)[0].tolist() if every[i] < every[j]}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in every], "fp long")).collect()}
    assert got == want and len(want) >= 240


def test_simhash_groups(spark, docs, empty):
    import random

    r = random.Random(2)
    texts = []
    for i in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base), " ".join([*base[:200], f"z{i}", *base[201:]]), " ".join(base[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = df.collect()
    fps = [simhash.fingerprint(x["text"]) for x in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = union_find(pairs, range(len(fps)))
    least = {}
    for i, c in comp.items():
        if (d := rows[i]["doc_id"]) is not None:
            least[c] = min(least.get(c, d), d)
    want = sorted(str((rows[i]["doc_id"], f"{fps[i]:016x}", least.get(comp[i]))) for i in comp)
    assert sorted(str(tuple(x)) for x in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(docs).count() == len(DOCS) and simhash.near_duplicates(empty).count() == 0


def similar_groups(spark, texts):
    """The groups of similar_edges(), and those of all pairs of texts."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("most", F.size(F.split("text", " ")))
    edges = [tuple(x) for x in similar.similar_edges(df, Scratch(spark)).collect()]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and share(i, j) >= 0.8 - 1e-12]
    assert {(min(e), max(e)) for e in edges} <= set(want)
    return union_find(edges, range(len(texts))), union_find(want, range(len(texts))), want, share


def test_similar_edges_misses_no_word_edit(spark):
    import random

    r = random.Random(4)
    texts = ["", " a ", "a b c d e", "A  b c d\te", "a b c d e f"]
    for i in range(120):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(60, 500))]
        near = list(base)
        for _ in range(max(1, len(base) // 60)):
            near[r.randrange(len(near))] = f"z{i}"
        texts += [" ".join(base), " ".join(near)]
    got, all_pairs, want, _ = similar_groups(spark, texts)
    assert got == all_pairs and len(want) > 80


def test_similar_edges_misses_no_block_edit(spark):
    import random

    r = random.Random(6)
    texts = []
    for i in range(150):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(100, 400))]
        n = len(base) - 4
        new = [f"z{r.randint(0, 3000)}" for _ in range(int(n * r.uniform(0.205, 0.25)))]
        texts += [" ".join(base), " ".join(base + new)]
    got, all_pairs, want, share = similar_groups(spark, texts)
    assert got == all_pairs and len(want) > 80 and all(share(*p) < 0.84 for p in want)


def test_similar_edges_of_texts_made_of_common_passages(spark):
    import random

    r = random.Random(9)
    passages = [" ".join(f"p{k}_{i}" for i in range(r.randint(8, 40))) for k in range(8)]
    texts = [" ".join([*sorted(r.sample(passages, r.randint(3, 7))), *(f"own{i}_{j}" for j in range(r.randint(0, 25)))]) for i in range(250)]
    got, all_pairs, want, _ = similar_groups(spark, texts)
    assert got == all_pairs and len(want) > 20


def test_decontaminate(spark, docs, empty, same, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    b = [(1, item), (2, "all rights Reserved"), (3, None), (4, ""), (5, "..."), (None, "word word"), (6, item), (6, item), (10, "a b a b a b a b a b a b"), (7, "cc")]
    texts = [(20, item), (21, "x " + item.replace(" ", ", ").upper() + " y"), (22, " ".join(item.split()[1:11])), (23, " ".join(item.split()[:9])), (24, "a b " * 9), (25, item + " " + item), (26, "one " + item)]
    # the SQL is quadratic in a text's words, so the very long one is looked at by itself
    long = decontaminate.contamination(docs.where("doc_id = 5"), spark.createDataFrame([(2, "all rights reserved")], "item_id long, text string")).first()
    assert (long["n_words"], long["n_hit"]) == (200_003, 3)
    df = docs.where("doc_id <=> 5 = false").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(i, t, "s") for i, t in texts], SCHEMA))
    bench = spark.createDataFrame(b, "item_id long, text string").withColumn("doc_id", F.lit(1))
    sql = dict(documents=arrow(df), benchmark=pa.table({"item_id": pa.array([x[0] for x in b], pa.int64()), "text": pa.array([x[1] for x in b], pa.string())}))
    same(decontaminate.contamination(df.withColumns({"places": F.lit(1), "n_words": F.lit("x")}), bench), decontaminate.contamination_sql(), **sql)
    # ids that are no numbers
    named = {**sql, "benchmark": pa.table({"item_id": pa.array([x[0] and f"é{x[0]}-q" for x in b], pa.string()), "text": sql["benchmark"]["text"]})}
    same(decontaminate.contamination(df, bench.withColumn("item_id", F.concat(F.lit("é"), F.col("item_id").cast("string"), F.lit("-q")))), decontaminate.contamination_sql(), **named)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)  # some thirty blocks
    monkeypatch.setattr(decontaminate, "HELD_ROWS", 2)
    same(decontaminate.contamination(df, bench), decontaminate.contamination_sql(), **sql)
    assert decontaminate.contamination(df, bench.where("false")).where("NOT contaminated").count() == df.count()
    assert decontaminate.contamination(empty, bench).count() == 0


def test_edit_counts(spark, docs, empty):
    import random

    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    known = edit_counts.counts(path, P.PATTERN)
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(["a", " ", "\n", "B", "1", "'s", "é", "  ", " x", "日", ".", " ", "\x1c"]) for _ in range(r.randint(0, 300)))
        tree = edit_counts.build_tree(t, known)
        assert tree.total == len(known.encoding.encode_ordinary(t))
        for _ in range(4):
            a = r.randint(-1, len(t) + 2)
            t, n = edit_counts.edit(t, tree, a, a + r.randint(-2, 9), "".join(r.choice(["a", " ", "\n", "x y"]) for _ in range(r.randint(0, 5))), known)
            assert tree.total == len(known.encoding.encode_ordinary(t)) and sum(tree.sizes) == len(t) and n <= len(t)
            w = tree.width
            assert all(tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1] for k in range(1, w))
    state = edit_counts.build(docs, path, P.PATTERN)
    edits = spark.createDataFrame([(1, 1, 0, 3, "Some"), (1, 0, 5, 5, None), (5, 0, 1000, 1010, " new "), (99, 0, 0, 0, "x")], "doc_id long, position int, start long, end long, new string")
    out = {x["doc_id"]: x for x in edit_counts.apply_edits(edit_counts.with_edits(state, edits), path, P.PATTERN).collect()}
    assert out[1]["text"].startswith("Some rights") and out[5]["encoded"] < 2000
    assert all(x["n_tokens"] == len(known.encoding.encode_ordinary(x["text"])) for x in out.values())
    assert out[2]["n_tokens"] == 0 and edit_counts.build(empty, path, P.PATTERN).count() == 0


def test_edited_leaves_are_split():
    import public_tokenizers as P

    known = edit_counts.counts(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = " ".join(f"word{i % 97}" for i in range(30_000))
    tree = edit_counts.build_tree(text, known)
    before = sum(tree.sizes) / len(tree.sizes)
    for i in range(60):
        text, n = edit_counts.edit(text, tree, 90_000, 90_000, f" some {i} " * 500, known)
        assert n < 20 * before + 8_000
    assert max(tree.sizes) < 4 * before and sum(tree.sizes) == len(text)
    assert tree.total == len(known.encoding.encode_ordinary(text))
    assert all(tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1] for k in range(1, tree.width))


def test_edit_counts_query_against_whole_encoding(spark):
    import public_tokenizers as P

    from tests.conftest import SF

    known = edit_counts.counts(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: r for r in queries.op9_edit_counts(spark, SF).collect()}
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("edits", edit_counts.sample_edits(F.col("doc_id"), F.col("text")))
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        t = r["text"]
        assert got[r["doc_id"]]["n_tokens_before"] == len(known.encoding.encode_ordinary(t))
        for e in r["edits"]:
            a, b = min(e["start"], len(t)), min(e["end"], len(t))
            t = t[:a] + e["new"] + t[b:]
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_chars"]) == (len(known.encoding.encode_ordinary(t)), len(t))


def test_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, f"A plain text number {i}, with words. " * 3 if i % 2 else f"BUY!! NOW!! {i} $$$ ### " * 3) for i in range(60)], "doc_id long, text string")
    model = rules.train(texts, labels)
    got = {r["doc_id"]: r for r in rules.scored(texts, model).collect()}
    assert all((r["predicted"] == 1) == (i % 2 == 1) for i, r in got.items())
    x = rules.with_statistics(texts, [F.col("doc_id")]).select("doc_id", "_s.*").toPandas()
    s = model.score(x[rules.NAMES].to_numpy(float), rules.NAMES)
    assert max(abs(got[i]["score"] - v) for i, v in zip(x["doc_id"], s)) < 1e-12
    clash = texts.withColumns({k: F.lit(v) for k, v in CLASH.items()})
    again = {r["doc_id"]: r["score"] for r in rules.scored(clash, rules.train(clash, labels)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert rules.accepted(clash, model).columns == clash.columns
    assert rules.scored(docs, model).where("score BETWEEN 0 AND 1").count() == len(DOCS) and rules.scored(empty, model).count() == 0
    assert rules.accepted(docs, model).columns == docs.columns
    none = rules.train(empty, labels.where("false"))
    assert rules.scored(docs, none).where("score = 0.5").count() == len(DOCS)


def test_training_rows_are_bounded_by_ids(spark, monkeypatch):
    """Rows that share a labelled id count once, however many there are."""
    texts = spark.range(5000).selectExpr("id % 20 AS doc_id", "concat('text ', id % 3, ' of ', id % 20) AS text").unionByName(spark.createDataFrame([(4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    from sievewright.llm import common

    sample = common.label_sample(labels, "quality", 100)
    rows = common.one_each(texts.join(sample, "doc_id").select("doc_id", "text", "_label")).collect()
    assert len(rows) == sample.count() == len({r["doc_id"] for r in rows}) and all(r["text"].startswith("text 0 ") for r in rows)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda t, *_: seen.append(len(t)))
    monkeypatch.setattr(rules, "fit", lambda x, *_: seen.append(len(x)))
    toxicity.train(texts, labels)
    rules.train(texts, labels)
    assert seen == [len(rows)] * 2
