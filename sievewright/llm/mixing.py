"""Mixing sources to target weights: words per source give repetition rates, and each document is emitted
floor(rate) times plus one more time with the fraction's probability, decided by a hash of seed and id.

Draws of documents alone would let a source of few, unequal documents miss its target. So a source's documents are
put into classes of like size, each class gets its part of the extra copies by one hash-seeded offset a source, and
these go to the documents with the class's smallest hashes. Each document still has the fraction's probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import SPACE_BREAK, Scratch, written

#: Fixed values of the mix: weights by turns, share of all words to take, most repetitions of a source.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MOST = 2
SEED = "mix-1"
#: Up to so many classes of size of all sources, their table (five numbers and a name each) is broadcast; beyond that it is joined by a shuffle.
BROADCAST_CLASSES = 100_000
#: Sizes of a class differ by an eighth at most; hashes are counted in so many ranges before those of one range are put in order.
EIGHTHS = 8
RANGES = 4096


def size_of(text: Column) -> Column:
    """The number of runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE_BREAK), "")), F.lit(0)).cast("long")


def running(rows: DataFrame, by: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """rows with, for each name, the sum of a column over all rows before this one in the order `by`, and _all_<name>, the sum of all.

    Rows are sorted by ranges, and the sums of the ranges are added to those inside, so no task holds all rows. by must leave no ties.
    """
    parts = scratch.written(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordered")
    each = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    # as many rows as there are partitions
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_sum_{n}").over(every).alias(f"_all_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(each), "_part")
    return out.select(*rows.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n, c in sums.items()], *[f"_all_{n}" for n in sums])


def targets(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of docs(source, size).

    Weights are dealt by turns to the sources in code-point order. A target is weight times a common level, at most
    `most` times the source's size; what a source can't take goes to the others by weight, until none is above. Sources
    fill up in the order of size over weight, so the level follows from one pass over the sums before each.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    turns = running(sizes, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}, scratch).drop("_all_turn").withColumn("w", w)
    order = [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    table = scratch.written(running(turns, order, {"n_before": F.col("source_size"), "w_before": F.col("w")}, scratch), "turns")
    a, b = share
    left = F.lit(a) * whole("_all_n_before") - F.lit(b * most) * whole("n_before")
    weight = F.lit(b) * (whole("_all_w_before") - whole("w_before"))
    # the level is left over weight, seen from the first source that isn't full
    first = table.where(F.col("w") * left < F.lit(most) * whole("source_size") * weight).select(left.alias("left"), weight.alias("weight")).orderBy(F.col("left").desc(), F.col("weight").desc()).first()
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    if first is None:
        return table.select("source", "source_size", cap.alias("target"))
    level, over = int(first["left"]), int(first["weight"])
    full = F.col("w") * F.lit(level).cast("decimal(38,0)") >= F.lit(most) * whole("source_size") * F.lit(over).cast("decimal(38,0)")
    return table.select("source", "source_size", F.when(full, cap).otherwise((F.col("w") * F.lit(level).cast("decimal(38,0)")).cast("double") / F.lit(float(over))).alias("target"))


def unit(seed: str, name: Column) -> Column:
    """A number of [0, 1) from the seed and a name; the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def size_class(size: Column) -> Column:
    """Eight classes for each power of two, in the order of size; words beyond 2**59 would overflow."""
    bits = F.length(F.bin(size))
    return F.when(size > 0, bits * EIGHTHS + F.call_function("shiftright", size * EIGHTHS, bits - 1)).otherwise(0).cast("int")


def bars(rows: DataFrame, sources: DataFrame, seed: str, scratch: Scratch) -> DataFrame:
    """(source, class, source_size, target, whole, bar): documents of the class with a hash up to bar have one copy more than whole.

    rows(source, size, class, u) is a written table, sources is that of targets(). A class's extra copies are counted from
    the running number of documents in the smaller classes, at most 520 rows a source. The hash that the last of them has
    is found by counts in RANGES ranges; only rows of the range that holds it are put in order, equal hashes as one row.
    """
    cell = [F.col("source"), F.col("class")]
    spread = rows.groupBy(*cell, F.floor(F.col("u") * RANGES).cast("int").alias("part")).agg(F.count("*").alias("n"))
    spread = scratch.written(spread, "ranges")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target")
    classes = spread.groupBy(*cell).agg(F.sum("n").alias("n"))
    classes = classes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(seed, F.coalesce(F.concat(F.lit("source:"), F.col("source").cast("string")), F.lit("source")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.withColumn("whole", F.floor(rate).cast("int")).withColumn("_part", rate - F.floor(rate)).withColumn("_at", offset).withColumn("_before", before)
    dealt = lambda n: F.floor(F.col("_at") + F.col("_part") * n)
    extra = F.least(F.col("n"), dealt(F.col("_before") + F.col("n")) - dealt(F.col("_before")))
    classes = scratch.written(classes.select("source", "class", "source_size", "target", "whole", extra.alias("extra")), "classes")
    of = lambda x, y: x["source"].eqNullSafe(y["source"]) & (x["class"] == y["class"])
    up_to = F.sum("n").over(Window.partitionBy("source", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    spread = spread.withColumn("_to", up_to)
    last = spread.join(classes, of(spread, classes)).where((F.col("_to") >= F.col("extra")) & (F.col("_to") - F.col("n") < F.col("extra")))
    last = scratch.written(last.select(spread["source"], spread["class"], "part", (F.col("extra") - F.col("_to") + F.col("n")).alias("need")), "last")
    inside = rows.withColumn("_part", F.floor(F.col("u") * RANGES).cast("int"))
    inside = inside.join(last, of(inside, last) & (F.col("_part") == F.col("part"))).groupBy(last["source"], last["class"], "need", "u").agg(F.count("*").alias("n"))
    in_order = F.sum("n").over(Window.partitionBy("source", "class").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    bar = inside.withColumn("_to", in_order).where("_to >= need").groupBy("source", "class").agg(F.min("u").alias("bar"))
    return classes.join(bar, of(classes, bar), "left").select(classes["source"], classes["class"], "source_size", "target", "whole", "bar")


def planned(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target (of the source), and copies: how often the mix has the document.

    A null source is a source of its own, the last. Rows of one source and class of size that share an id share their
    draw. A source without words isn't taken. The words that a source's documents take differ from its target by about
    the size of its largest document at most, and by what sizes of a class differ; no document has over ceil(rate) copies.
    Columns of docs named like the new ones are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = unit(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    docs = docs.drop("source_size", "target", "copies")
    rows = scratch.written(docs.select("source", "size", size_class(F.col("size")).alias("class"), hashed.alias("u")), "sizes")
    sources = scratch.written(targets(rows, scratch, **how), "targets")
    table = written(bars(rows, sources, seed, scratch), "bars").withColumnRenamed("source", "_source").withColumnRenamed("class", "_class")
    scratch.drop()
    if table.count() <= BROADCAST_CLASSES:
        table = F.broadcast(table)
    joined = docs.join(table, docs["source"].eqNullSafe(table["_source"]) & (size_class(docs["size"]) == table["_class"]))
    copies = table["whole"] + F.coalesce(hashed <= table["bar"], F.lit(False)).cast("int")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], table["source_size"], table["target"], copies.alias("copies"))


def plan(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """planned() of docs(doc_id, text, source, ...), whose size is the number of words in the text, 0 for null."""
    return planned(docs.withColumn("size", size_of(F.col("text"))), seed, **how)


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The documents of the mix with the columns of docs, each as often as plan() says."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    rows = plan(docs.select("doc_id", "text", "source", whole), seed, **how)
    return rows.select("_whole", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*[F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


def mix_sql(seed: str = SEED) -> str:
    """DuckDB SQL for the query over the view documents: the level is found from the sources in order of size over weight, extra copies from all documents of a class in order of their hashes."""
    unit_of = lambda name: f"('0x' || substr(md5('{seed}:' || {name}), 1, 12))::BIGINT::DOUBLE / {1 << 48}::DOUBLE"
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    a, b = SHARE
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(n) OVER before, 0) AS n_before, sum(w) OVER rest AS w_rest, sum(n) OVER () AS total FROM s
 WINDOW before AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
first AS (SELECT {a} * total - {b} * {MOST} * n_before AS l, {b} * w_rest AS m, n_before FROM o WHERE w * ({a} * total - {b} * {MOST} * n_before) < {MOST} * n * {b} * w_rest ORDER BY n_before LIMIT 1),
t AS (SELECT source, n AS source_size, CASE WHEN l IS NULL OR w * l >= {MOST} * n * m THEN ({MOST} * n)::DOUBLE ELSE (w * l)::DOUBLE / m::DOUBLE END AS target FROM s LEFT JOIN first ON true),
r AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
 CASE WHEN size > 0 THEN length(bin(size)) * {EIGHTHS} + ((size * {EIGHTHS}) >> (length(bin(size)) - 1)::BIGINT) ELSE 0 END AS class,
 {unit_of("coalesce(doc_id::VARCHAR, 'null')")} AS u, {unit_of("coalesce('source:' || d.source, 'source')")} AS o FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY u) AS place, count(*) OVER (PARTITION BY source, class) AS here, count(*) OVER (PARTITION BY source ORDER BY class RANGE UNBOUNDED PRECEDING) AS upto FROM r),
k AS (SELECT *, least(here, floor(o + (rate - floor(rate)) * upto)::BIGINT - floor(o + (rate - floor(rate)) * (upto - here))::BIGINT) AS extra FROM n),
b AS (SELECT *, max(CASE WHEN place = extra THEN u END) OVER (PARTITION BY source, class) AS bar FROM k)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (floor(rate)::BIGINT + coalesce(u <= bar, false)::BIGINT))::BIGINT AS taken FROM b"""
