"""Exact and near duplicates of questions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import WORD, jaccard, normalized_question
from sievewright.operators.components import components
from sievewright.session import written


def exact_duplicates(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, dup_of): the first item with the same normalised text, null for the first itself. The first is found by a
    pre-aggregated group and joined back, so that a text with very many copies can be split."""
    rows = df.select(item, F.xxhash64(normalized_question(F.col(text))).alias("_h"), F.md5(normalized_question(F.col(text)).cast("binary")).alias("_k"))
    first = rows.groupBy("_h", "_k").agg(F.min(item).alias("_first"))
    return rows.join(first, ["_h", "_k"]).select(item, F.when(F.col("_first") != F.col(item), F.col("_first")).alias("dup_of"))


def shingle_hashes(text, size: int):
    """64-bit hashes of the shingles, ordered, each once; of the words, so that no shingle is put together."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    made = F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), runs))
    return F.array_sort(F.array_distinct(made))


def near_duplicates(df: DataFrame, item: str, text: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(a, b, similarity): all pairs of different texts with at least the threshold's Jaccard similarity of shingles; exact.

    Equal shingle sets are one, with the least item, so copies don't multiply pairs. Two sets that are similar enough share one
    of their n - ceil(threshold * n) + 1 rarest shingles, so only those are joined; sizes and places bound the rest.
    """
    sets = shingle_sets(df, item, text, size, threshold)[0]
    prefix = prefixes(sets, threshold)
    x, y = (prefix.select("h", *(F.col(c).alias(c + k) for c in ("id", "n", "rem"))) for k in "xy")
    pairs = x.join(y, "h").where((F.col("idx") < F.col("idy")) & may_be_near("x", "y", threshold)).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
    return verified(pairs.distinct(), sets, threshold)


#: Sets are ruled out by the shingles whose hash is below PART modulo PARTS: any part is right, and one larger than 1 - threshold
#: leaves few sets that are like no other one.
PART, PARTS = 3, 8
#: Up to so many sets (16 MB of keys) are picked by a broadcast.
BROADCAST_SETS = 1_000_000


def shingle_sets(df: DataFrame, item: str, text: str, size: int, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """sets(id, n, s): the different sets of shingle hashes, each with its least item; membership(item, id): the set of each item that has
    words. Both are tables, so texts are cut once.

    With a threshold, sets that can't be so similar to another one are left out: those that are alone with more than
    n - ceil(threshold * n) of their shingles, counted over a part of all shingles. Only what stays is shuffled whole.
    """
    spark = df.sparkSession
    # texts without words are told by their words: a filter on the shingles would be pushed down and make them twice
    rows = df.where(F.lower(F.col(text)).rlike(WORD)).select(F.col(item).alias("item"), shingle_hashes(F.col(text), size).alias("s"))
    rows = written(spark, rows.select("item", F.xxhash64("s").alias("_k"), F.hash("s").alias("_m"), F.size("s").alias("n"), "s"), "shingles")
    firsts = rows.groupBy("_k", "_m", "n").agg(F.min("item").alias("id"))
    picked = rows
    if threshold is not None:
        part = rows.select("_k", F.explode(F.filter("s", lambda h: F.pmod(h, F.lit(PARTS)) < PART)).alias("h"))
        alone = part.groupBy("h").agg(F.min("_k").alias("_k"), F.max("_k").alias("_l")).where("_k = _l").groupBy("_k").agg(F.count("*").alias("_alone"))
        few = F.coalesce("_alone", F.lit(0)) <= F.col("n") - needed(F.col("n"), threshold)
        alive = written(spark, firsts.join(alone, "_k", "left").where(few).select("_k").distinct(), "alive")
        picked = rows.join(F.broadcast(alive) if alive.count() <= BROADCAST_SETS else alive, "_k", "left_semi")
    # equal sets are combined before the shuffle
    sets = picked.groupBy("_k", "_m", "n").agg(F.min("item").alias("id"), F.first("s").alias("s")).where("id IS NOT NULL").select("id", "n", "s").dropDuplicates(["id"])
    return written(spark, sets, "sets"), rows.join(firsts, ["_k", "_m", "n"]).select("item", "id")


def needed(n: Column, threshold: float) -> Column:
    """How many of n shingles a similar set has at least."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, h, rem) of sets(id, n, s): the rarest shingles of each, one of which a similar set has too, and how many of the set's shingles come from h on.
    Sets are ordered by how many sets have a shingle; those that no other set has come first and make no rows."""
    spark = sets.sparkSession
    each = sets.select("id", "n", F.explode("s").alias("h"))
    rare = each.join(each.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "h")
    own = rare.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("o"))
    # of n - needed + 1 in front, n - size(o) are alone
    taken = (F.size("o") - needed(F.col("n"), threshold) + 1).cast("int")
    prefix = own.withColumn("_take", taken).where("_take > 0").select("id", "n", F.size("o").alias("_o"), F.posexplode(F.slice("o", F.lit(1), F.col("_take"))["h"]).alias("_at", "h"))
    return written(spark, prefix.select("id", "n", "h", (F.col("_o") - F.col("_at")).alias("rem")), "prefixes")


def may_be_near(x: str, y: str, threshold: float) -> Column:
    """Whether sets of n... shingles, rem... of which come from a common one on, can be similar enough; true for similar sets at the first one they share."""
    one, two = F.col("n" + x), F.col("n" + y)
    sized = F.least(one, two) >= F.greatest(one, two) * F.lit(threshold) - F.lit(1e-9)
    return sized & (F.least("rem" + x, "rem" + y) >= F.ceil((one + two) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets are similar enough."""
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("_sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("_sb"))
    return pairs.join(one, "a").join(two, "b").withColumn("similarity", jaccard(F.col("_sa"), F.col("_sb"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


#: Bands of the signature and minima of a band: two sets of similarity 0.8 share no band once in 5,000 times.
BANDS, BAND_ROWS, ROUNDS = 12, 3, 3


def near_duplicate_groups(df: DataFrame, item: str, text: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(item, representative): the group of each item, named by its least item; items that are like no other one are their own.

    Equal sets of shingles are one. The others get a MinHash signature; sets with an equal band are compared exactly, each with
    one of them (chosen by a hash of the band, so that every band has another one), and those unlike it once more among
    themselves, ROUNDS times in all: rows are linear in a band's members. What the bands miss, the rarest shingles find (see
    left_out()), so groups are the components of all similar pairs. A null or wordless text is its own; null items count as one.
    """
    spark = df.sparkSession
    sets, membership = shingle_sets(df, item, text, size, threshold)
    least = lambda k: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(k))))
    keys = [F.xxhash64(F.lit(b), *(least(b * BAND_ROWS + r) for r in range(BAND_ROWS))) for b in range(BANDS)]
    bands = written(spark, sets.select("id", F.posexplode(F.array(*keys)).alias("band", "key")), "bands")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("_n")).where("_n > 1").select("band", "key")
    open_, links = written(spark, bands.join(shared, ["band", "key"]), "open"), None
    for k in range(ROUNDS):
        chosen = open_.groupBy("band", "key").agg(F.min_by("id", F.xxhash64("id", "band", F.lit(k))).alias("chosen"))
        stars = open_.join(chosen, ["band", "key"]).where("id <> chosen")
        pairs = stars.select(F.least("id", "chosen").alias("a"), F.greatest("id", "chosen").alias("b")).distinct()
        found = written(spark, verified(pairs, sets, threshold).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        near = stars.join(found, (F.least("id", "chosen") == F.col("a")) & (F.greatest("id", "chosen") == F.col("b")), "left_anti").select("id", "band", "key")
        open_ = written(spark, near, "open")
        if open_.isEmpty():
            break
    groups = components(left_out(sets, links, threshold)).select(F.col("node").alias("id"), "component")
    named = membership.join(groups, "id", "left").select("item", F.coalesce("component", "id").alias("representative"))
    all_items = df.select(F.col(item).alias("item"))
    rest = all_items.join(named, all_items["item"].eqNullSafe(named["item"]), "left_anti").select("item", F.col("item").alias("representative"))
    return named.unionByName(rest).select(F.col("item").alias(item), "representative")


def left_out(sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """links(a, b) and those that join their components as all similar pairs of sets do; exact.

    Sets with one of their rarest shingles in common are compared with one of them, and after that only where they still are
    in different components, so that a large group makes no pairs by its square.
    """
    spark = sets.sparkSession
    prefix = prefixes(sets, threshold)

    def apart(rows: DataFrame) -> DataFrame:
        """rows(id, n, h, rem) with g, their component, of the shingles that several components have."""
        named = components(links).select(F.col("node").alias("id"), "component")
        rows = written(spark, rows.join(named, "id", "left").select("id", "n", "h", "rem", F.coalesce("component", "id").alias("g")), "grouped")
        several = rows.groupBy("h").agg(F.min("g").alias("_x"), F.max("g").alias("_y")).where("_x <> _y").select("h")
        return written(spark, rows.join(several, "h"), "apart")

    def found(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where((F.col("gx") != F.col("gy")) & may_be_near("x", "y", threshold))
        pairs = written(spark, pairs.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct(), "candidates")
        return written(spark, verified(pairs, sets, threshold).select("a", "b"), "links")

    side = lambda rows, k: rows.select("h", *(F.col(c).alias(c + k) for c in ("id", "n", "rem", "g")))
    rows = apart(prefix)
    # that of which most comes from the shingle on is most like the others
    one = rows.groupBy("h").agg(F.max_by(F.struct("id", "n", "rem", "g"), F.struct(F.col("rem") / F.col("n"), "id")).alias("p")).select("h", "p.*")
    links = links.unionByName(found(side(rows, "x").join(side(one, "y"), "h")))
    rows = apart(rows.drop("g"))
    return links.unionByName(found(side(rows, "x").join(side(rows, "y"), "h").where("idx < idy")))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def union_models(answers: dict[str, DataFrame]) -> DataFrame:
    """All models' rows, tagged with their model."""
    tagged = [df.withColumn("model", F.lit(m)) for m, df in answers.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
