"""Benchmark decontamination as a prefix-filtered set join on word shingles.

A window of an item occurs in a document only if the document holds all of the window's shingles, so holding its rarest
shingle is necessary: at containment 1 the prefix is one token. One pass over the texts keeps, for each document, the
places of shingles that some item has; from these the corpus-wide count of every shingle follows, and with it the rarest
shingle of each window. The places of those shingles are joined with the windows that they are the prefix of; the window
must fit into the document there (length and position), and every other shingle must stand where the window has it,
which is exact.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import WORD_TABLE, shared_dir, written

WINDOW = 10
SHINGLE = 5
#: Items are indexed in blocks of about so many characters, in the shared folder, each in a task; a worker holds one block at a time, whatever the benchmark's size.
BLOCK_CHARS = 5_000_000
#: A task holds documents of about so many bytes, and goes through the blocks once for all of them.
HELD = 64 << 20
HELD_ROWS = 2000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class Windows:
    """The different windows of a block of items and their shingles; a window shorter than a shingle is one shingle."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.words: dict[bytes, int] = {}
        self.shingles: dict[tuple, int] = {}
        self.items: dict[tuple, list[str]] = {}
        for item, text in items:
            ids = tuple(self.words.setdefault(w, len(self.words)) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = self.items.setdefault(ids[i : i + window], [])
                if item not in owners[-1:]:
                    owners.append(item)
        #: Of each window: number of words, its shingles' numbers in order, its items.
        self.parts: list[tuple[int, list[int], list[str]]] = []
        for ids, owners in self.items.items():
            k = min(shingle, len(ids))
            self.parts.append((len(ids), [self.shingles.setdefault(ids[i : i + k], len(self.shingles)) for i in range(len(ids) - k + 1)], owners))
        self.sizes = sorted({len(x) for x in self.shingles})

    def find(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Number of words, and the places and numbers of all shingles that some window has."""
        words = words_of(text)
        get, table = self.words.get, self.shingles
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known, places, numbers = ids >= 0, [], []
        for n in self.sizes:
            m = len(ids) - n + 1
            if m < 1:
                continue
            full = known[:m].copy()
            for i in range(1, n):
                full &= known[i : m + i]
            at = np.nonzero(full)[0]
            for p, key in zip(at.tolist(), zip(*(ids[at + i].tolist() for i in range(n)))):
                if (k := table.get(key)) is not None:
                    places.append(p)
                    numbers.append(k)
        return len(words), places, numbers

    def prefixes(self, counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """For each shingle, the windows whose rarest shingle it is, and where it stands in them."""
        out = defaultdict(list)
        for w, (_, shingles, _) in enumerate(self.parts):
            k, at = min((counts.get(s, 0), s, i) for i, s in enumerate(shingles))[1:]
            out[k].append((w, at))
        return dict(out)

    def verify(self, prefixes: dict[int, list[tuple[int, int]]], n_words: int, places: list[int], numbers: list[int]) -> tuple[set[int], set[str]]:
        """The words hit and the items found in a document with these shingles."""
        stands = set(zip(places, numbers))
        hit: set[int] = set()
        items: set[str] = set()
        for p, k in stands:
            for w, at in prefixes.get(k, ()):
                size, shingles, owners = self.parts[w]
                first = p - at
                if first >= 0 and first + size <= n_words and all((first + i, s) in stands for i, s in enumerate(shingles)):
                    hit.update(range(first, first + size))
                    items.update(owners)
        return hit, items


def store(thing, uri: str) -> str:
    where, path = pafs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(pickle.dumps(thing))
    return uri


def load(uri: str):
    where, path = pafs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as stream:
        return pickle.loads(stream.read())


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each block, of batches that are sorted by block."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for block, own in groupby(rows, key=lambda r: r["block"]):
        yield block, list(own)


STORED = "block int, path string"


def stored(dealt: DataFrame, blocks: int, make: Callable[[int, list[dict]], object], folder: str, kind: str) -> dict[int, str]:
    """What make() has for the rows of each block of dealt(block, ...), each in a file of the shared folder; the paths by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_block(batches):
            path = store(make(block, rows), f"{folder}/{block:06d}-{TaskContext.get().taskAttemptId()}.{kind}")
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "path": [path]})

    return {r["block"]: r["path"] for r in dealt.repartition(blocks, "block").sortWithinPartitions(*dealt.columns).mapInArrow(run, STORED).collect()}


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about HELD bytes: for each, a task goes through the blocks once."""
    run, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_ROWS):
            run.append(batch.slice(at, HELD_ROWS))
            size += run[-1].get_total_buffer_size() if batch.num_rows <= HELD_ROWS else batch.nbytes * run[-1].num_rows // batch.num_rows
            if size >= HELD:
                yield run
                run, size = [], 0
    if run:
        yield run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    docs needs doc_id and text, benchmark item_id (of any type that has a text form) and text; other columns don't matter. Null and empty texts have no
    words and are clean. Repeated documents each give a row; repeated items count once; an empty benchmark leaves all
    clean. Items of the benchmark that have fewer words than a window are one window each.
    """
    folder = shared_dir(docs.sparkSession, "windows")
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    n = math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS)
    dealt = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(max(1, n))).cast("int").alias("block"), "i", "t")
    indexes = stored(dealt, n, lambda _, rows: Windows([(r["i"], r["t"]) for r in rows], window, shingle), folder, "index") if n else {}
    blocks = sorted(indexes)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.struct([("block", pa.int32()), ("places", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int32()))]))
        for run in held(batches):
            texts = [t.as_py() for batch in run for t in batch.column(1)]
            counts, found = [len(words_of(t)) for t in texts] if not blocks else [0] * len(texts), [[] for _ in texts]
            for b in blocks:
                index = load(indexes[b])
                for i, t in enumerate(texts):
                    counts[i], p, k = index.find(t)
                    if p:
                        found[i].append({"block": b, "places": p, "shingles": k})
            ids = pa.chunked_array([batch.column(0) for batch in run]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(found, lists)], ["doc_id", "n_words", "found"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(places, "doc_id long, n_words long, found array<struct<block: int, places: array<int>, shingles: array<int>>>")
    found = written(found, "shingles")
    each = found.select(F.explode("found").alias("f")).select("f.block", F.explode("f.shingles").alias("shingle")).groupBy("block", "shingle").count()
    first = lambda b, rows: load(indexes[b]).prefixes({r["shingle"]: r["count"] for r in rows})
    prefixes = stored(each, n, first, folder, "prefixes") if n else {}

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in held(batches):
            sizes, found = ([x for batch in run for x in batch.column(c).to_pylist()] for c in (1, 2))
            hits: list[set] = [set() for _ in sizes]
            owners: list[set] = [set() for _ in sizes]
            for b in sorted({f["block"] for x in found for f in x}):
                index, first = load(indexes[b]), load(prefixes[b])
                for i, x in enumerate(found):
                    for f in x:
                        if f["block"] == b:
                            h, k = index.verify(first, sizes[i], f["places"], f["shingles"])
                            hits[i] |= h
                            owners[i] |= k
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in owners]
            ids = pa.chunked_array([batch.column(0) for batch in run]).combine_chunks()
            rows = [sizes, [len(x) for x in hits], [len(x) for x in owners]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rows), pa.array(digest, pa.string()), pa.array([bool(x) for x in hits], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(verified, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for contamination() over the views documents and benchmark."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT item_id, ws, least(len(ws), {window}) AS size, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d JOIN sizes ON len(ws) >= size)),
found AS (SELECT r, item_id, i, p.size FROM places p JOIN win USING (size, w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
