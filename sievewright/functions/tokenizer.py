"""Tokens of a real tokenizer as columns: counts, and where in the text each token stands."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import trim_partial_sentences
from sievewright.operators.chunking import chunk_id

#: Texts that are encoded at a time; their characters are bounded too, so that a batch of long texts isn't encoded at once.
BATCH, BATCH_CHARS = 256, 4_000_000


@lru_cache(maxsize=4)
def loaded(path: str):
    """The tokenizer of a file in the tokenizers library's format, once for each Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        if part and (len(part) >= BATCH or chars + len(t) > BATCH_CHARS):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def token_counts(text: Column, path: str) -> Column:
    """Number of tokens; a null or empty text has none."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        tokenizer = loaded(path)
        return pa.array([len(e.ids) for part in _batches([t or "" for t in texts.to_pylist()]) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)], pa.int32())

    return count(text)


def token_spans(text: Column, path: str) -> Column:
    """array<struct<begin, end>>: the characters of each token, so that windows of tokens are stretches of the text."""

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        tokenizer, found, sizes = loaded(path), [], []
        for part in _batches([t or "" for t in texts.to_pylist()]):
            for e in tokenizer.encode_batch(part, add_special_tokens=False):
                found.append(np.array(e.offsets, np.int32).reshape(-1, 2))
                sizes.append(len(e.ids))
        flat = np.concatenate([np.zeros((0, 2), np.int32), *found])
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pairs)

    # a filter on the spans would otherwise be pushed below them, and every text be encoded once more for it
    return spans.asNondeterministic()(text)


def token_windows(docs: DataFrame, path: str, size: int = 1200, overlap: int = 150, text: str = "text", document: str = "doc_id") -> DataFrame:
    """docs with a row for each window of `size` tokens, as token_chunks() makes of words: chunk_index, n_tokens, begin and end (characters), text and chunk_id.

    A window's text is what stands from its first token to its last one, spaces included, so windows without overlap are
    the text itself but for what the tokenizer drops between them. A last window inside the one before is kept; null texts and
    texts without tokens have none. Only spans cross to Python and back with the text; windows are cut in the JVM.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    stride = size - overlap
    rows = docs.withColumn("_spans", token_spans(F.col(text), path)).where(F.size("_spans") > 0)
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.floor((F.size("_spans") - 1) / stride).cast("int"))))
    first = F.col("chunk_index") * stride
    last = F.least(first + size, F.size("_spans")) - 1
    rows = rows.withColumns({"n_tokens": last - first + 1, "begin": F.get("_spans", first)["begin"], "end": F.get("_spans", last)["end"]}).drop("_spans")
    return rows.withColumn(text, F.substr(F.col(text), F.col("begin") + 1, F.col("end") - F.col("begin"))).withColumn("chunk_id", chunk_id(document, "chunk_index"))


def repaired_windows(docs: DataFrame, path: str, size: int = 1024, overlap: int = 0, text: str = "text", document: str = "doc_id") -> DataFrame:
    """token_windows() without broken sentences at either end."""
    return token_windows(docs, path, size, overlap, text, document).withColumn(text, trim_partial_sentences(F.col(text)))
