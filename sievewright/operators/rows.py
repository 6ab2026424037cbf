"""What a text is cut into by Python, as rows, a bounded part at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and characters of a batch that goes back to the JVM.
ROWS, CHARS = 10_000, 2_000_000


def parts(batches: Iterator[pa.RecordBatch], found: Callable[[str | None], Iterable[str]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (item, position, what is found) of batches of (item, text), of at most ROWS rows and little over CHARS characters."""
    for b in batches:
        ids, places, texts, chars = [], [], [], 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names)

        for i, t in zip(b.column(0), b.column(1)):
            for k, x in enumerate(found(t.as_py())):
                ids.append(i.as_py())
                places.append(k)
                texts.append(x)
                chars += len(x)
                if chars >= CHARS or len(ids) >= ROWS:
                    yield part()
                    ids, places, texts, chars = [], [], [], 0
        if ids:
            yield part()


def found_rows(df: DataFrame, item: str, text: str, found: Callable[[str | None], Iterable[str]], position: str, name: str) -> DataFrame:
    """(item, position, name) of found(text) for every row, numbered from 0. One text is read at a time, and what is found goes back in
    parts, so a worker holds a batch as it came, one text and one part, however many rows a batch has."""
    kind = f"`{item}` {df.schema[item].dataType.simpleString()}, {position} int, {name} string"
    return df.select(item, text).mapInArrow(lambda batches: parts(batches, found, [item, position, name]), kind)
