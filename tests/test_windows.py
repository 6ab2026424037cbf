"""Windows are scored from counts of their chunks: the same as from their joined texts, which aren't read."""

import itertools
import random

from pyspark.sql import functions as F

from sievewright.functions import signals as S
from sievewright.operators import units

WORDS = ["is", "a", "defined", "to", "be", "refers", "means", "mean", "in", "the", "event", "of", "as", "result", "because", "Anna", "Bob", "Carl-Dora", "x.Eve", "9", "2001", "it", "he", "plain", "stop.", "no!", "?", ".", "a.b", "such", "like,", "example", "for", "depends", "on"]


def texts(seed, n):
    r = random.Random(seed)
    gap = lambda: r.choice([" "] * 12 + ["  ", "\n", "\t", "\x0b"])
    for _ in range(n):
        k = r.choice([0, 1, 1, 2, 3, 5, 9, 10, 11, 12, 30])
        yield r.choice(["", "", " "]) + "".join(r.choice(WORDS) + gap() for _ in range(k)).removesuffix(" ") if r.random() < 0.97 else None


def test_scores_of_windows_are_those_of_their_texts(spark):
    rows = [(d, i, f"{d}:{i}", "t", x) for d in range(300) for i, x in enumerate(texts(d, 7))]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, topic string, text string")
    whole = S.with_scores(S.with_signals(units.windows(chunks).withColumn("text", F.array_join("texts", " "))))
    columns = ["doc_id", "first_index", "size", "tokens", *S.PHRASES, "numeric", "entity", "length", "ambiguity", "years", "mcq_score", "qa_score", "hard_score"]
    want = {tuple(r) for r in whole.select(*columns).collect()}
    assert len(want) == 300 * 11
    assert {tuple(r) for r in units.scored_windows(chunks).select(*columns).collect()} == want
    counted = S.with_counts(chunks).drop("text")
    assert {tuple(r) for r in units.scored_windows(counted).select(*columns).collect()} == want
    of = lambda df: {tuple(r) for r in df.select("chunk_id", *columns[3:-3]).collect()}
    assert of(S.signals_of_counted(counted)) == of(S.with_signals(chunks))
    top = units.top_multi_units(chunks, 5)
    best = whole.withColumn("score", units.multi_score()).orderBy(F.round("score", 9).desc(), "doc_id", "first_index", "size").limit(5)
    row = ["doc_id", "first_index", "size", "score", "text"]
    assert {tuple(r) for r in top.select(*row).collect()} == {tuple(r) for r in best.select(*row).collect()}


def test_phrases_of_a_group_do_not_overlap():
    forms = lambda p: itertools.product(*[S._words(w) for w in p.split(" ")])
    for groups in (*(g for _, g in S.PHRASES.values()), [S.PRONOUNS]):
        for g in groups:
            made = [f for p in g for f in forms(p)]
            assert max(map(len, made)) <= 4
            for p, q in itertools.product(made, made):
                assert not any(p[k:][: len(q)] == q[: len(p) - k] for k in range(1, len(p))), (p, q)


def test_a_window_does_not_carry_its_chunks_texts(spark):
    long = "plain words go on and on. " * 40
    chunks = spark.createDataFrame([(1, i, str(i), "t", long) for i in range(4)], "doc_id long, chunk_index int, chunk_id string, topic string, text string")
    assert S.with_counts(chunks).agg(F.max(F.length("ends"))).first()[0] < 60
