"""License scan as an exact set-similarity join, in DataFrame functions only.

Every template is a set of words ordered by how rare each word is in the whole corpus. A text block can only contain
the share of a template that is needed if it holds one of the template's first |T| - need + 1 words (prefix filter), so
only places of those words become candidates. Length and positional bounds drop more of them before the containment is
counted. Phrases are the case threshold = 1 whose candidate blocks are as long as the phrase; an exact check of the
word order follows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import WORD_BREAK, ascii_words

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that the method looks for by containment, and their labels.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
]
#: Of a notice of at least WHOLE_BELOW different words, a block must hold this share; of a shorter one, all: there a single
#: word (nc, sharealike, apache, mit, a version) tells licenses apart, and the others stand in any of them.
THRESHOLD, WHOLE_BELOW = 0.8, 15
#: Words and lower case as in texts: only A-Z is changed, and every character beyond ASCII belongs to a word.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Templates are a parameter, not data; beyond this many words in all, their index is joined by a shuffle instead of a broadcast.
BROADCAST_WORDS = 20_000


def templates(phrases: dict[str, str], notices: list[tuple[str, str]], threshold: float) -> list[dict]:
    rows = []
    for exact, items in ((True, [(label, text) for text, label in phrases.items()]), (False, notices)):
        for label, text in items:
            words = WORD.findall(text.translate(LOWER))
            if words:
                rows.append({"label": label, "exact": exact, "words": words, "set": sorted(set(words)), "need": len(set(words)) if exact or len(set(words)) < WHOLE_BELOW else math.ceil(threshold * len(set(words)) - 1e-9)})
    return rows


def exact_words(text: Column) -> Column:
    """Words of a text in which only A-Z is lower-cased, for templates with other letters than those of ASCII."""
    upper = "".join(map(chr, LOWER))
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), WORD_BREAK), "")


def word_counts(docs: DataFrame, vocabulary: list[str], words_of: Callable[[Column], Column]) -> dict[str, int]:
    """How often each template word occurs in all texts; other words make no rows."""
    found = docs.select(F.explode(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs, with the license phrases and notices found in its whole text.

    docs needs doc_id and text; other columns don't matter. A text block of a notice with m words is a run of 2m words
    that begins at a multiple of m, so that any m consecutive words lie in one. Null and empty texts have no words, no
    labels and score 0. Repeated rows each give a row. score is the largest containment found (1 for a phrase), else 0.
    """
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    rows = templates(phrases, notices, threshold)
    vocabulary = sorted({w for t in rows for w in t["set"]})
    words_of = ascii_words if all(w.isascii() for w in vocabulary) else exact_words
    counts = word_counts(docs, vocabulary, words_of) if vocabulary else {}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for k, t in enumerate(rows):
        ordered = sorted(t["set"], key=rank.__getitem__)
        for i, w in enumerate(ordered[: len(ordered) - t["need"] + 1]):
            # a phrase stands at a place of its rarest word in one way: that word's first place in it is looked at
            index.append((w, k, t["label"], t["exact"], t["words"], ordered, i, t["words"].index(w) if t["exact"] else 0, len(t["words"]), t["need"]))
    schema = "w string, template int, label string, exact boolean, words array<string>, ordered array<string>, i int, at int, span int, need int"
    prefix = spark.createDataFrame(index, schema)
    if sum(len(t["words"]) for t in rows) <= BROADCAST_WORDS:
        prefix = F.broadcast(prefix)
    keys = sorted({x[0] for x in index})
    by_rarity = F.array(*[F.lit(w) for w in sorted(vocabulary, key=rank.__getitem__)]) if vocabulary else F.array().cast("array<string>")
    labels = {False: sorted({t["label"] for t in rows}), True: sorted({t["label"] for t in rows if t["exact"]})}

    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), words_of(F.col("text")).alias("_words"))
    # a place keeps the words around it that any of its blocks can have, not the text
    reach = 2 * max((len(t["words"]) for t in rows), default=1)
    around = lambda i: F.struct(i.alias("pos"), F.greatest(i - reach, F.lit(0)).alias("off"), F.slice("_words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near"))
    found = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(keys), i)), lambda i: i.isNotNull())
    places = texts.select("_row", "doc_id", F.size("_words").alias("_n"), F.explode_outer(F.transform(found, around)).alias("_p")).select("_row", "doc_id", "_n", "_p.*")
    places = places.withColumn("w", F.get("near", F.col("pos") - F.col("off")))
    joined = places.join(prefix, "w", "left")
    # a phrase has one block for a place of its word, a notice has the two that cover the place
    start = F.when(F.col("exact"), F.array(F.col("pos") - F.col("at"))).otherwise(F.array(F.floor(F.col("pos") / F.col("span")) * F.col("span"), (F.floor(F.col("pos") / F.col("span")) - 1) * F.col("span")))
    blocks = joined.withColumn("_start", F.explode_outer(start.cast("array<int>")))
    inside = (F.col("_start") >= 0) & F.when(F.col("exact"), F.col("_start") + F.col("span") <= F.col("_n")).otherwise(True)
    block = F.when(inside, F.slice("near", F.col("_start") - F.col("off") + 1, F.col("span") * F.when(F.col("exact"), 1).otherwise(2)))
    blocks = blocks.select("_row", "doc_id", "_n", "label", "exact", "words", "ordered", "w", "i", "need", "_start", block.alias("_block"))
    # the block's template words, rarest first: its length and the place of w in it bound the overlap
    blocks = blocks.withColumn("_set", F.array_intersect(by_rarity, F.col("_block")))
    bound = F.least(F.size("ordered") - F.col("i"), F.size("_set") - F.array_position("_set", F.col("w")) + 1) >= F.col("need")
    overlap = F.when(bound, F.size(F.array_intersect("ordered", "_set")))
    share = overlap / F.size("ordered")
    hit = F.coalesce((overlap >= F.col("need")) & (~F.col("exact") | (F.col("_block") == F.col("words"))), F.lit(False))
    blocks = blocks.select("_row", "doc_id", "_n", "label", "_start", F.when(hit, share).alias("_share"), (hit & F.col("exact")).alias("_base"))
    aggregates = [
        F.sum(F.col("_base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("_base"), F.col("_start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("_base"), F.col("_start"))).cast("long").alias("last_word"),
        F.coalesce(F.max("_share"), F.lit(0.0)).alias("score"),
        *[F.max(F.when(F.col("_base") & (F.col("label") == x), 1)).alias(f"_base_{k}") for k, x in enumerate(labels[True])],
        *[F.max(F.when(F.col("_share").isNotNull() & (F.col("label") == x), 1)).alias(f"_any_{k}") for k, x in enumerate(labels[False])],
    ]
    found = blocks.groupBy("_row", "doc_id", "_n").agg(*aggregates)
    named = lambda kind, of: F.concat_ws(",", *[F.when(F.col(f"_{kind}_{k}") == 1, F.lit(x)) for k, x in enumerate(of)])
    return found.select(
        "doc_id", F.col("_n").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
        named("base", labels[True]).alias("base_labels"), named("any", labels[False]).alias("labels"), "score",
    )


def scan_sql(phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() over the view documents."""
    rows = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, threshold)
    values = ",\n".join(f"({k}, '{t['label']}', {t['exact']}, {len(t['words'])}, {t['need']}, {len(t['set'])}, [{', '.join(repr(w) for w in t['words'])}])" for k, t in enumerate(rows))
    return rf"""
WITH t(k, label, exact, span, need, size, words) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM texts),
tw AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS o FROM t),
base AS (SELECT r, k, pos - o AS st FROM w JOIN tw USING (w) JOIN t USING (k) WHERE exact AND pos - o >= 0 GROUP BY r, k, st, span HAVING count(*) = span),
near AS (SELECT r, k, b, count(DISTINCT w) AS overlap FROM (SELECT r, k, w, need, unnest([pos // span, pos // span - 1]) AS b FROM w JOIN (SELECT DISTINCT k, w FROM tw) USING (w) JOIN t USING (k) WHERE NOT exact) WHERE b >= 0 GROUP BY r, k, b, need HAVING count(DISTINCT w) >= need),
hits AS (SELECT r, label, true AS is_base, st, 1.0::DOUBLE AS share FROM base JOIN t USING (k) UNION ALL SELECT r, label, false, NULL, overlap::DOUBLE / size FROM near JOIN t USING (k)),
agg AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(st) FILTER (is_base) AS first_word, max(st) FILTER (is_base) AS last_word,
 array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN agg USING (r)"""
