"""Links between texts that share most of their word shingles: SimHash first, then an exact prefix join for what it misses.

A text can only be similar to another one if few of its shingles stand in no other text. So a part of all shingles is
counted over all texts first, and only texts that may have a partner stay. Of these, fingerprints within three bits,
found by Golay keys, are compared and make the first groups. All their shingles are then counted and ordered by rarity:
two similar sets have one of the first n - ceil(similarity * n) + 1 shingles of each in common (prefix filter), and
enough shingles from there on (positional filter). Texts that share such a shingle are compared with one of them, and
after that only where they are in different groups still, so that a large group of copies makes no pairs by its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch
from sievewright.llm.components import components
from sievewright.llm.simhash import links, majority

#: Texts that may have a partner are told by the shingles whose hash is below PART modulo PARTS. With the similarity s, a
#: larger part than 1 - s drops most texts without partner; any part is safe.
PART, PARTS = 3, 8
#: Up to so many ids (16 MB), texts are picked by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a batch that goes back to the JVM, and words whose hashes each worker keeps.
ROWS = 250_000
KEPT = 300_000


class Words(dict):
    """64-bit hashes of words; keeps a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


def runs(text: str | None, shingle: int, known: Words) -> np.ndarray:
    """64-bit hashes of all runs of `shingle` words, A-Z lower-cased; fewer words are one run, none have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def limit(n: int, similarity: float) -> int:
    """How many of n shingles may be missing in a similar set."""
    return n - math.ceil(similarity * n - 1e-9)


def some_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, h) for the part of the different shingles of each row of texts(id, text) that is counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, found, size = Words(), [], [], 0

        def out() -> pa.RecordBatch:
            owner = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
            return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).view(np.int64))], ["id", "h"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = runs(t.as_py(), shingle, known)
                ids.append(i)
                found.append(np.unique(h[h % np.uint64(PARTS) < PART]))
                size += len(found[-1])
                if size >= ROWS:
                    yield out()
                    ids, found, size = [], [], 0
        if ids:
            yield out()

    return texts.mapInArrow(run, "id long, h long")


def whole_sets(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(id, n, fp, s) of texts(id, text, alone): all different shingles and the fingerprint, but for texts too many of whose shingles are alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            ids, sizes, fps, sets = [], [], [], []
            for i, t, alone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                h = runs(t.as_py(), shingle, known)
                s = np.unique(h)
                if len(s) and alone <= limit(len(s), similarity):
                    ids.append(i)
                    sizes.append(len(s))
                    fps.append(majority(h))
                    sets.append(s.view(np.int64))
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "fp", "s"])

    return texts.mapInArrow(run, "id long, n int, fp long, s array<long>")


def needed(n: Column, similarity: float) -> Column:
    """How many of n shingles a similar set has at least."""
    return F.ceil(F.lit(similarity) * n - F.lit(1e-9)).cast("int")


def alive(texts: DataFrame, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """Of texts(id, text, most), most being a number of shingles that the text can't exceed: (id, alone) of those that may have a similar one."""
    part = some_shingles(texts.select("id", "text"), shingle)
    # equal texts have one id, so a shingle with one id is in no other text
    alone = part.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    alone = scratch.written(alone, "alone")
    most = texts.groupBy("id").agg(F.max("most").alias("most"))
    few = F.coalesce("alone", F.lit(0)) <= F.col("most") - needed(F.col("most"), similarity)
    return scratch.written(most.join(alone, "id", "left").where(few).select("id", F.coalesce("alone", F.lit(0)).cast("int").alias("alone")), "alive")


def ranked(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, n, r) of sets(id, n, s): r are the shingles that other sets have too, by rarity among all sets. Sets with too few of them are left out."""
    rows = sets.select("id", "n", F.explode("s").alias("h"))
    repeated = scratch.written(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "repeated")
    # both sides of the join are plain scans, so that a shingle of very many texts can be split
    each = rows.join(repeated, "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))
    return scratch.written(each.where(F.size("r") >= needed(F.col("n"), similarity)).select("id", "n", F.transform("r", lambda x: x["h"]).alias("r")), "ranked")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of pairs(a, b) whose sets in sets(id, n, r) have at least the given Jaccard similarity: what two have in common is in the r of both."""
    pairs = scratch.written(pairs.distinct(), "candidates")
    one, two = (sets.select(F.col("id").alias(k), F.col("n").alias("n" + k), F.col("r").alias("r" + k)) for k in "ab")
    shared = F.size(F.array_intersect("ra", "rb"))
    close = shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared) - F.lit(1e-9)
    return scratch.written(pairs.join(two, "b").join(one, "a").where(close).select("a", "b"), "links")


def grouped(rows: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(id, ...) with g, the group of id by the edges so far."""
    roots = components(edges, scratch)
    return rows.join(roots, rows["id"] == roots["node"], "left").select(rows["*"], F.coalesce("root", "id").alias("g"))


def enough(one: str, two: str, similarity: float) -> Column:
    """Whether texts of n... shingles, rem... of which are left from a common one on, can be similar."""
    both = F.col("n" + one) + F.col("n" + two)
    return F.least("rem" + one, "rem" + two) >= F.ceil(F.lit(similarity / (1 + similarity)) * both - F.lit(1e-9))


def split(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(h, g, ...) of the shingles h that several groups have."""
    several = rows.groupBy("h").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("h")
    return scratch.written(rows.join(scratch.written(several, "several"), "h"), "split")


def similar_edges(texts: DataFrame, scratch: Scratch, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(a, b): pairs of similar texts of texts(id, text, most), which link the same texts into groups as all similar pairs do.

    Similar: the sets of shingles have at least the given Jaccard similarity. Equal texts must have one id, without
    nulls; texts without words have no pairs. most: a number that the text's shingles can't exceed.
    """
    left = alive(texts, similarity, shingle, scratch)
    left = F.broadcast(left) if left.count() <= BROADCAST_IDS else left
    picked = texts.select("id", "text").join(left, "id").dropDuplicates(["id"])
    sets = scratch.written(whole_sets(picked.select("id", "text", "alone"), similarity, shingle), "sets")
    full = ranked(sets.select("id", "n", "s"), similarity, scratch)

    fps = sets.select("id", "fp").join(full.select("id"), "id", "left_semi")
    least = scratch.written(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    same = fps.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = links(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    edges = verified(same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))), full, similarity, scratch)

    alone = F.col("n") - F.size("r")
    prefix = full.select("id", "n", alone.alias("alone"), F.size("r").alias("size"), F.posexplode(F.slice("r", 1, F.size("r") - needed(F.col("n"), similarity) + 1)).alias("at", "h"))
    prefix = prefix.select("id", "n", "alone", "h", (F.col("size") - F.col("at")).alias("rem"))
    rows = split(grouped(prefix, edges, scratch), scratch)
    # the text with the fewest shingles of its own is most like the others
    pivots = scratch.written(rows.groupBy("h").agg(F.min(F.struct("alone", "id", "n", "rem", "g")).alias("p")).select("h", F.col("p.id").alias("pivot"), F.col("p.n").alias("np"), F.col("p.rem").alias("remp"), F.col("p.g").alias("gp")), "pivots")
    stars = rows.withColumnsRenamed({"n": "nx", "rem": "remx"}).join(pivots, "h").where((F.col("g") != F.col("gp")) & enough("x", "p", similarity))
    edges = edges.unionByName(verified(stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")), full, similarity, scratch))

    rows = split(grouped(rows.select("id", "n", "h", "rem"), edges, scratch), scratch)
    x, y = (rows.select("h", *(F.col(c).alias(c + k) for c in ("id", "n", "rem", "g"))) for k in "xy")
    pairs = x.join(y, "h").where((F.col("gx") != F.col("gy")) & (F.col("idx") < F.col("idy")) & enough("x", "y", similarity))
    return edges.unionByName(verified(pairs.select(F.col("idx").alias("a"), F.col("idy").alias("b")), full, similarity, scratch))
