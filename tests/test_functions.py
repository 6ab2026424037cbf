"""Rows that hit each rule, worked out by hand."""

from pyspark.sql import functions as F

from sievewright.functions import signals as S
from sievewright.functions import text as T


def rows(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_phrases_and_near_misses(spark):
    count = lambda name: S.phrase_count(F.col("text"), S.PHRASES[name][1])
    df = rows(spark, "It is a means. A meaning.", "First, such as this. Likely.", "Unlike x, better than y.", "because of this, as", "The process works by", "if under", "étéas for2")
    got = one(df, *map(count, ("definition", "enumeration", "comparison", "causal", "mechanism", "conditional")))
    assert got[0][0] == 2 and got[1][1] == 2 and got[2][2] == 2
    assert got[3][3] == 3  # because, as, and because of
    assert got[4][4] == 2 and got[5][5] == 2 and got[6][3] == 0


def test_numbers(spark):
    df = rows(spark, "12,345.67", "12345", "1,234567", "10-20", "5–9", "3.5%a", "5% of", "1999 2000 2001")
    got = one(df, *[F.regexp_count("text", F.lit(p)) for p in S.NUMBERS])
    assert [g[0] for g in got][:3] == [1, 0, 1]
    assert got[3][3] == 1 and got[4][3] == 1 and got[5][2] == 1 and got[6][2] == 0 and got[7][1] == 3
    assert one(S.with_tags(S.with_signals(rows(spark, "in 1999 and 2000 and 2001"))), "tags")[0][0] == ["timeline", "numeric_dense"]


def test_length_signal(spark):
    df = spark.createDataFrame([(n,) for n in (0, 199, 200, 600, 601, 1200, 1300)], "n int")
    got = [r[0] for r in df.select(S.length(F.col("n"))).collect()]
    assert got[:4] == [0.0, 0.995, 1.0, 1.0] and abs(got[4] - (1 - 1 / 600)) < 1e-12 and got[5:] == [0.0, 0.0]


def test_ambiguity_counts_every_sentence_as_incomplete(spark):
    got = one(S.with_signals(rows(spark, "", "   ", "...", "one two three four five six.", "he")), "tokens", "ambiguity")
    assert got[0] == (0, 1.0) and got[1] == (0, 1.0)
    assert abs(got[2][1] - 0.2) < 1e-12  # two empty pieces
    assert abs(got[3][1] - 0.3) < 1e-12
    assert got[4][1] == 1.0


def test_extraction(spark):
    df = rows(spark, "x <a> in </a> <a>two</a>", "<a> open", "none", "r ## no ## true ")
    assert [r[0] for r in one(df, T.xml_tag(F.col("text"), "a"))] == ["in", "open", "", ""]
    assert one(df, T.verdict(F.col("text")))[3][0] == "true"
    ids = rows(spark, "d::chunk_0012", "d_7", "none")
    assert [r[0] for r in one(ids, T.chunk_number(F.col("text")))] == [12, 7, 0]
    assert one(rows(spark, "low start. Good one. cut off"), T.trim_partial_sentences(F.col("text")))[0][0] == "Good one."
    assert one(rows(spark, "cut, one two three four five. Good"), T.salvage_clauses(F.col("text")))[0][0] == "one two three four five."
    assert one(rows(spark, " a[12] \n\n 1x1 "), T.paragraphs(F.col("text")))[0][0] == ["a", "1x1"]
    assert one(rows(spark, "x <FINAL_SUMMARY> s </final_summary>", "y" * 300), F.length(T.summary(F.col("text")))) == [(1,), (200,)]


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), ("a", None)], "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b")))).collect()]
    assert abs(got[0] - 1 / 3) < 1e-12 and got[1:] == [0.0, 0.0]


def test_phrases_are_counted_in_the_runs_of_their_words(spark):
    """said() keeps every phrase of a text and makes none: counts of each group are those of the whole text."""
    import random
    import re

    from pyspark.sql import functions as F

    from sievewright.functions import signals as S

    groups = [g for _, gs in S.PHRASES.values() for g in gs] + [S.PRONOUNS]
    words = sorted({w for g in groups for p in g for x in p.split(" ") for w in (x.rstrip("?"), x.rstrip("?")[:-1]) if w}) + ["x", "Zed", "été", "12"]
    r = random.Random(1)
    glue = [" "] * 12 + ["  ", "\n", ", ", ". ", "-", "", "_", "'"]
    texts = ["".join(w if r.random() < 0.8 else w.upper() for w in (r.choice(words) + r.choice(glue) for _ in range(120))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "As a result because of this, as for it"]], "text string")
    counts = [S.phrase_count(t, [g]) for g in groups for t in (S.said(F.col("text")), F.regexp_replace("text", "$", ""))]
    for row in rows.select("text", *[c.alias(f"c{k}") for k, c in enumerate(counts)]).collect():
        for k, g in enumerate(groups):
            want = len(re.findall(rf"(?ia:\b)(?i:{'|'.join(g)})\b", row.text)) if row.text.isascii() else row[2 * k + 2]
            assert row[2 * k + 1] == row[2 * k + 2] == want, (g, row.text)
    assert rows.where(F.length(S.said(F.col("text"))) > F.length("text")).count() == 0
