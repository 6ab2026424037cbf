"""What each filter of a chain takes, in every order of the chain, from one pass over the documents.

A document's filters give a mask of those it fails. What a step removes depends on the set of filters before it and on the
step's own filter alone, that is on an edge of the lattice of subsets: five filters have 80 edges, and each of the 120
orders is a path of five of them. Documents are counted by mask first, so the 80 edges of a mask cost the same however many
documents share it, and the 600 steps of all orders are joined to sums of edges, never to documents.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import SPACE_BREAK, Scratch, written

FILTERS = "ABCDE"
REPEATED = "E"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone; null is an empty text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE_BREAK), "")
    n, chars = F.size(words), F.length(whole)
    capitals = chars - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * chars, "D": whole.rlike(SYMBOLS),
    }


def masked(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters they fail (bit i: FILTERS[i]) and by their labels.

    A text is known by its SHA-256. The first document of a text is found by a pre-aggregated minimum and joined back on
    digest and id together, so copies of one text are spread over all tasks. A null id is smaller than none and has none
    smaller. Rows that share an id are all first or all repeated; an id is good or toxic if any of its labels says so.
    """
    checks = failures(F.col("text"))
    mask = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in checks.items()), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), digest.alias("digest"), mask.alias("mask"))
    rows = scratch.written(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("_first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    repeated = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index(REPEATED)).otherwise(0)
    no = F.lit(False)
    return (
        rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
        .groupBy("part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))
    )


def lattice(filters: str = FILTERS) -> list[tuple[int, int]]:
    """All (mask of the filters before, index of the next filter)."""
    return [(before, i) for before in range(1 << len(filters)) for i in range(len(filters)) if not before >> i & 1]


def steps(filters: str = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, mask of the filters before, index) of every step of every order: its path through the lattice."""
    out = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(order), k, f, before, filters.index(f)))
            before |= 1 << filters.index(f)
    return out


def edge_sums(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, before, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, paths): sums over the masks for every
    edge; paths is the number of orders that pass it."""
    n = len(filters)
    size = lambda before: bin(before).count("1")
    edge = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(i).alias("filter"), F.lit(1 << i).alias("_own"), F.lit(math.factorial(size(b)) * math.factorial(n - 1 - size(b))).alias("paths")) for b, i in lattice(filters)))
    rows = masks.withColumn("_edge", F.explode(edge)).select("part", "mask", "good", "toxic", "n", "_edge.*")
    own = F.col("_own")
    fails, gone = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    removed = fails & ~gone
    return rows.groupBy("part", "before", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(removed).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == own).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"), F.first("paths").alias("paths"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part of docs
    and every step of the 120 orders.

    A part is a value of source, null counting as an empty one. shapley: what the step's filter removes, summed over all
    orders at whatever step. An empty table has no parts and so no rows; a part always has all 600 rows, zeros included.
    Rows grow with the number of parts only. labels(doc_id, quality, toxic) may be null, repeated or lacking.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    edges = written(edge_sums(masked(docs, labels, scratch)), "edges")  # 80 rows a part, which the result is read from
    scratch.drop()
    total = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    path = spark.createDataFrame(steps(), "filter_order string, step int, letter string, before int, filter int").drop("letter")
    # 600 rows, whatever the data
    return (
        edges.join(total, ["part", "filter"]).join(F.broadcast(path), ["before", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit_sql() -> str:
    """DuckDB SQL that walks every document through every order, without the lattice."""
    space = r"[^\x20\x09-\x0D]+"
    order = " UNION ALL ".join(f"SELECT '{''.join(p)}' AS filter_order" for p in permutations(FILTERS))
    failed = "CASE substr(o.filter_order, {0}, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
    places = " UNION ALL ".join(
        f"SELECT part, o.filter_order, {k} AS step, n, good, toxic, {failed.format(k)} AS fails, ({' OR '.join([failed.format(j) for j in range(1, k)] or ['false'])}) AS gone, a::INT + b::INT + c::INT + d::INT + e::INT AS n_failed FROM facts, orders o"
        for k in range(1, 6)
    )
    return rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{space}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT part, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > {CAPITAL_PERCENT} * length(text) AS c,
 regexp_matches(text, '{SYMBOLS}') AS d, coalesce(doc_id > first, false) AS e, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
facts AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM f GROUP BY ALL),
orders AS ({order}),
places AS ({places}),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
 coalesce(sum(n) FILTER (fails AND n_failed = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost FROM places GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s"""
