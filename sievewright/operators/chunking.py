"""From documents to chunks. A chunk's id is its document's with ::chunk_ and a number of at least four digits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import tokens, trim_partial_sentences
from sievewright.operators.rows import found_rows


def chunk_id(document: str, index: str) -> Column:
    return F.concat(F.col(document).cast("string"), F.lit("::chunk_"), F.format_string("%04d", F.col(index)))


def _windows(df: DataFrame, parts: Column, size: int, stride: int) -> DataFrame:
    """A row for each start 0, stride, 2 stride, ... below the number of parts, with those of the window as _part."""
    df = df.withColumn("_parts", parts).where(F.size("_parts") > 0)
    df = df.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.floor((F.size("_parts") - 1) / stride).cast("int"))))
    return df.withColumn("_part", F.slice("_parts", F.col("chunk_index") * stride + 1, size)).drop("_parts")


def token_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text", document: str = "doc_id") -> DataFrame:
    """Windows of white-space tokens, joined by spaces; blank documents have none. A last window inside the one before is kept."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    out = _windows(docs, tokens(F.col(text)), size, size - overlap)
    out = out.withColumn("n_tokens", F.size("_part")).withColumn(text, F.array_join("_part", " ")).drop("_part")
    return out.withColumn("chunk_id", chunk_id(document, "chunk_index"))


def word_chunks(docs: DataFrame, size: int = 180, **names: str) -> DataFrame:
    return token_chunks(docs, size, 0, **names)


def repaired_chunks(docs: DataFrame, size: int = 1024, overlap: int = 0, **names: str) -> DataFrame:
    """token_chunks() without broken sentences at either end."""
    out = token_chunks(docs, size, overlap, **names)
    return out.withColumn(names.get("text", "text"), trim_partial_sentences(F.col(names.get("text", "text"))))


def char_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text", document: str = "doc_id") -> DataFrame:
    stride = size - overlap
    out = docs.where(F.length(text) > 0)
    out = out.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / stride).cast("int"))))
    return out.withColumn(text, F.substring(F.col(text), F.col("chunk_index") * stride + 1, F.lit(size))).withColumn("chunk_id", chunk_id(document, "chunk_index"))


def multi_text_chunks(docs: DataFrame, texts: str, size: int, document: str = "doc_id") -> DataFrame:
    """Chunks of an array of texts for each document, numbered through all of them."""
    from pyspark.sql import Window

    parts = docs.select("*", F.posexplode(texts).alias("_at", "text"))
    out = token_chunks(parts, size, 0, document=document)
    number = F.row_number().over(Window.partitionBy(document).orderBy("_at", "chunk_index")) - 1
    return out.withColumn("chunk_index", number).withColumn("chunk_id", chunk_id(document, "chunk_index")).drop("_at")


def paragraph_batches(paragraphs: DataFrame, per: int = 20, document: str = "doc_id", position: str = "pos", made: str | None = None, most: int = 50) -> DataFrame:
    """paragraphs with the number of their batch. made: a column of questions made for each paragraph; batches after `most` of a document are left out."""
    from pyspark.sql import Window

    out = paragraphs.withColumn("batch", F.floor(F.col(position) / per).cast("int"))
    if made:
        before = Window.partitionBy(document).orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.coalesce(F.sum(made).over(before), F.lit(0))).where(F.col("_before") < most).drop("_before")
    return out


def summary_calls(docs: DataFrame, most: int, size: int, overlap: int = 0, document: str = "doc_id") -> DataFrame:
    """(document, call, text): a document of at most `most` tokens as a whole with call -1, else its chunks."""
    n = F.size(tokens(F.col("text")))
    whole = docs.where(n <= most).select(document, F.lit(-1).alias("call"), "text")
    return whole.unionByName(token_chunks(docs.where(n > most), size, overlap, document=document).select(document, F.col("chunk_index").alias("call"), "text"))


#: What texts are cut after, in the order in which it is tried.
SEPARATORS = ("\n\n", "\n", ".", ",")


def cut_offsets(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[int]:
    """Offsets, in order, at which a text may be cut: behind each occurrence of a separator inside a range that is longer than size.

    The whole text is the first range; ranges between the cuts of one separator are looked at with the next one. What has
    no separator left and still is too long may be cut anywhere.
    """
    ranges = [(0, len(text), 0)]
    while ranges:
        start, end, level = ranges.pop()
        if end - start <= size:
            yield end
        elif level == len(separators):
            yield from range(start + 1, end + 1)
        else:
            sep, cuts, at = separators[level], [start], text.find(separators[level], start, end)
            while at >= 0:
                cuts.append(at + len(sep))
                at = text.find(sep, at + len(sep), end)
            bounds = cuts if cuts[-1] == end else [*cuts, end]
            ranges += [(x, y, level + 1) for x, y in reversed(list(zip(bounds, bounds[1:])))]


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters as they stand in the text, between cut_offsets(): each reaches as far as it can, and the
    next begins at the first cut from which it repeats at most overlap characters and has room for something new. Blank chunks are left out."""
    out, begins, start, end = [], deque([0]), 0, 0
    for cut in cut_offsets(text, size, separators):
        if cut - start > size:
            out.append(text[start:end])
            while begins[0] < end and (end - begins[0] > overlap or cut - begins[0] > size):
                begins.popleft()
            start = begins[0]
        end = cut
        begins.append(cut)
    return [c for c in [*out, text[start:end]] if c.strip()]


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, document: str = "doc_id") -> DataFrame:
    """(document, chunk_index, text) by recursive separators. What a chunk begins with depends on the one before, so this is done in Python."""
    return found_rows(docs, document, "text", lambda t: split_recursively(t or "", size, overlap), "chunk_index", "text")
