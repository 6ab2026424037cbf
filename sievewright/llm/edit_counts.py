"""Edit-aware token counts.

Each document keeps a segment tree over runs of its pre-tokens: leaf sizes in characters, and the sums of tokens of all
subtrees. An edit re-encodes the leaves it touches, and further ones while the cut behind or before them is no sure
border of pre-tokens any more; what grows is split into leaves of the usual length again. Sums change on the way to the
root only, or are added up anew if there are more leaves than before. Counts are those of encoding the whole text
anew, since a text is only ever cut before a single space between two characters that aren't white space, where every
pre-token pattern of this family (an optional space before a run of one kind, or white space not followed by text) ends
one pre-token and begins the next.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces (mostly words) of a leaf.
LEAF = 32
#: Pieces whose counts each worker keeps.
KEPT = 300_000
CUT = re.compile(r"(?<=\S) (?=\S)")


class Counts(dict):
    """Tokens of a piece of text; keeps a bounded number of pieces."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < KEPT:
            self[piece] = n
        return n

    def of(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pieces of a text and the tokens of each."""
        pieces = CUT.split(text)
        pieces[1:] = [" " + p for p in pieces[1:]]
        return pieces, np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def counts(path: str, pattern: str) -> Counts:
    """path: a .tiktoken file of ranks; pattern: how texts are split into pre-tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Counts(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))


@dataclass
class Tree:
    """sizes: characters of each leaf; sums: tokens of each subtree, node k's children being 2k and 2k + 1, leaves last."""

    sizes: list[int]
    sums: list[int]

    @classmethod
    def build(cls, sizes: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, (len(sizes) - 1).bit_length())
        sums = [0] * width + tokens + [0] * (width - len(tokens))
        for k in range(width - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return cls(sizes, sums)

    @property
    def width(self) -> int:
        return len(self.sums) // 2

    @property
    def total(self) -> int:
        return self.sums[1] if self.sums else 0

    def put(self, leaf: int, tokens: int) -> None:
        k = self.width + leaf
        change = tokens - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2


    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Other leaves instead of those from first to last; empty ones go. Sums are added up anew, nothing is encoded."""
        old = list(zip(self.sizes, self.sums[self.width : self.width + len(self.sizes)]))
        kept = [x for x in old[:first] + leaves + old[last + 1 :] if x[0]] or [(0, 0)]
        made = Tree.build([n for n, _ in kept], [t for _, t in kept])
        self.sizes, self.sums = made.sizes, made.sums


def leaves_of(text: str, known: Counts) -> list[tuple[int, int]]:
    """(characters, tokens) of each run of LEAF pieces of a text."""
    pieces, tokens = known.of(text)
    firsts = list(range(0, len(pieces), LEAF))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return list(zip(np.add.reduceat(lengths, firsts).tolist(), np.add.reduceat(tokens, firsts).tolist()))


def build_tree(text: str, known: Counts) -> Tree:
    leaves = leaves_of(text, known)
    return Tree.build([n for n, _ in leaves], [t for _, t in leaves])


def sure(text: str, at: int) -> bool:
    """Whether pre-tokens end and begin at this place, whatever stands elsewhere."""
    return at in (0, len(text)) or (text[at] == " " and at + 1 < len(text) and not text[at + 1].isspace() and not text[at - 1].isspace())


def edit(text: str, tree: Tree, start: int, end: int, new: str, known: Counts) -> tuple[str, int]:
    """Replaces text[start:end] and puts the tree right; returns the new text and how many characters were encoded anew.

    Places beyond the text are taken as its end.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    changed = text[:start] + new + text[end:]
    ends = np.cumsum(tree.sizes)
    first = min(int(np.searchsorted(ends, start, "right")), len(ends) - 1)
    last = max(first, min(int(np.searchsorted(ends, end, "left")), len(ends) - 1))
    grown = len(changed) - len(text)
    left, right = int(ends[first]) - tree.sizes[first], int(ends[last]) + grown
    # the neighbours on either side belong to the region while the cut to them isn't sure
    while first and not sure(changed, left):
        first -= 1
        left -= tree.sizes[first]
    while last + 1 < len(ends) and not sure(changed, right):
        last += 1
        right += tree.sizes[last]
    leaves = leaves_of(changed[left:right], known) if right > left else []
    if len(leaves) <= last + 1 - first:
        leaves += [(0, 0)] * (last + 1 - first - len(leaves))
        for leaf, (size, tokens) in enumerate(leaves, first):
            tree.sizes[leaf] = size
            tree.put(leaf, tokens)
    else:
        tree.replace(first, last, leaves)
    return changed, right - left


STATE = "doc_id long, text string, sizes array<int>, sums array<int>"


def build(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text, sizes, sums): the state of each row of docs; null texts are empty, and have one empty leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = counts(path, pattern), pa.list_(pa.int32())
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            trees = [build_tree(t, known) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.sizes for t in trees], kind), pa.array([t.sums for t in trees], kind)], ["doc_id", "text", "sizes", "sums"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATE)


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with the edits(doc_id, position, start, end, new) of each document, in order of position, as an array.

    Edits of unknown documents, and of a null id, are left out; every row of a repeated id gets all edits of the id, and
    repeated edits are made as often as they stand there. One document's edits must fit into memory, as its text must.
    """
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "start", "end", "new"))).alias("edits")).withColumnRenamed("doc_id", "_doc")
    return state.join(listed, state["doc_id"] == listed["_doc"], "left").drop("_doc")


def apply_edits(state: DataFrame, path: str, pattern: str) -> DataFrame:
    """state after its edits (array of structs with start, end and new, taken in order, each in the text the one before left).

    Adds n_tokens and n_tokens_before, the sums at the root, and encoded, the characters encoded anew. A null array has no edits;
    a null place is 0, a null new text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = counts(path, pattern), pa.list_(pa.int32())
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text, sizes, sums, edits in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                tree, encoded, before = Tree(sizes, sums), 0, sums[1]
                for e in edits or []:
                    text, n = edit(text, tree, e["start"] or 0, e["end"] or 0, e["new"] or "", known)
                    encoded += n
                for column, x in zip(rows, (text, tree.sizes, tree.sums, before, tree.total, encoded)):
                    column.append(x)
            arrays = [batch.column(0), pa.array(rows[0], pa.string()), pa.array(rows[1], kind), pa.array(rows[2], kind), *(pa.array(x, pa.int64()) for x in rows[3:])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "sizes", "sums", "n_tokens_before", "n_tokens", "encoded"])

    columns = state.select("doc_id", "text", "sizes", "sums", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].cast("string").alias("new"))).alias("edits"))
    return columns.mapInArrow(run, f"{STATE}, n_tokens_before long, n_tokens long, encoded long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits for a document, from hashes of its id: an insertion, a replacement and a deletion anywhere in the text."""
    size = F.length(F.coalesce(text, F.lit(""))) + 1
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), size.cast("long"))
    one = lambda k, n, new: F.struct(at(k).alias("start"), (at(k) + n).alias("end"), F.lit(new).alias("new"))
    return F.array(one(1, 0, "an inserted, 2nd phrase"), one(2, 7, " new\nwords "), one(3, 12, ""))
