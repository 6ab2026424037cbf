"""SimHash near duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect [23, 12, 7] Golay
code's space. Of two fingerprints with at most three differing bits, at least two segments differ by one bit at most.
For such a segment, the codeword nearest to one word (three bits away at most) is within four bits of the other word;
within four bits there are one or six codewords. So for each pair of segments, one side is keyed by (nearest, each
near), the other by (each near, nearest): both codewords are then shared. A join on these keys with a check of the
distance finds every pair, without listing all pairs of a bucket for any segment alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch, written
from sievewright.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Bits of each segment and the pairs of segments, one of which has at most one differing bit on both sides.
SEGMENTS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the Golay code.
GENERATOR = 0b101011100011
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all runs of `shingle` words; fewer words are one run, none have none."""
    # bytes.lower() changes A-Z only, bytes.split() splits at 0x20 and 0x09-0x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        parts, n = iter([b" ".join(words)]), min(1, len(words))
    else:
        parts, n = map(b" ".join, zip(*[words[i:] for i in range(shingle)])), len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text: bit b is 1 if over half of the shingles' hashes have it. A text without words has 0."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row of docs; fp's bits are those of the unsigned fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def errors() -> np.ndarray:
    """For each of the 2,048 syndromes, what leads from a word to its nearest codeword, then to the five at distance four, or -1."""
    table = np.full((2048, 6), -1, np.int64)
    for weight in range(4):
        sums = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        table[syndrome(sums), 0] = sums
    sums = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), 4)], np.int64)
    s = syndrome(sums)
    order = np.argsort(s, kind="stable")
    s, sums = s[order], sums[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    table[s, place + 1] = sums
    return table


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each word: the nearest first, the others at distance four, -1 for none."""
    e = errors()[syndrome(segment)]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def key_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, side) of all keys of signed 64-bit fingerprints."""
    u, at, near = fps.view(np.uint64), 0, []
    for bits in SEGMENTS:
        near.append(codewords((u >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)))
        at += bits
    out = []
    for p, (a, b) in enumerate(PAIRS):
        for side, key in ((0, near[a][:, :1] << 12 | np.where(near[b] < 0, -1, near[b])), (1, np.where(near[a] < 0, -1, near[a] << 12) | near[b][:, :1])):
            ok = (near[b] if side == 0 else near[a]) >= 0
            rows, _ = np.nonzero(ok)
            out.append((rows, key[ok] | p << 24, np.full(len(rows), side, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key, side): about 16 keys of either side for each row of distinct(fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, key, side = key_rows(fps)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(key.astype(np.int32)), pa.array(side)], ["fp", "key", "side"])

    return distinct.select("fp").mapInArrow(run, "fp long, key int, side byte")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of distinct(fp) with at most three differing bits, each once or a few times."""
    keys = golay_keys(distinct)
    left = keys.where("side = 0").select("key", F.col("fp").alias("a"))
    right = keys.where("side = 1").select("key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return left.join(right, (left["key"] == right["key"]) & close).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints link at three or fewer differing bits; component_id is the smallest doc_id that can be reached, the
    row's own included. Equal fingerprints are one node, so that copies cost nothing but a count. Null and empty texts
    have fingerprint 0 and link as any other. A null doc_id is larger than all others: a component has null for its id
    only if all of its ids are null. Repeated rows each give a row.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct), scratch)
    grouped = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    labels = scratch.written(grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "labels")
    # only fingerprints with a link to another one are in labels; for the rest the least id of the fingerprint holds
    own = written(distinct.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    scratch.drop()
    # both sides are plain scans, so that a fingerprint with very many copies can be split by the skew join
    return fps.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
