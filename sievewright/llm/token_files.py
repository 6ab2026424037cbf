"""Token ids as Arrow IPC files of fixed-size lists: every record is one sequence and its mask, at a place known by arithmetic.

A shard holds the documents of one range of doc_id, in order. Its ids run on from document to document and are cut into
sequences of equal length; only the last sequence of a shard is padded, and its mask says so. Batches have the same
number of sequences, uncompressed, so a reader that maps the file into memory gets sequence k without copying or
reading the others. Beside each shard lies an index of its documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.encoding import encoder

SEQUENCE = 1024
#: Sequences in a batch.
BATCH = 512
END_ID = 2
#: About how many characters of text a shard takes at most.
SHARD_CHARS = 256 << 20


class ShardWriter:
    """Fills batches of `batch` sequences from ids as they come; holds one batch at a time."""

    def __init__(self, sink, dtype: np.dtype, sequence: int, batch: int):
        self.sequence, self.batch, self.room = sequence, np.zeros(sequence * batch, dtype), sequence * batch
        self.filled = self.total = 0
        ids = pa.list_(pa.from_numpy_dtype(dtype), sequence)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), self.room - self.filled)
            self.batch[self.filled : self.filled + n] = ids[:n]
            self.filled += n
            ids = ids[n:]
            if self.filled == self.room:
                self.flush()

    def flush(self) -> None:
        rows = -(-self.filled // self.sequence)
        if rows:
            self.batch[self.filled : rows * self.sequence] = 0
            mask = np.arange(rows * self.sequence) < self.filled
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (self.batch[: rows * self.sequence], mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.filled = 0

    def close(self) -> int:
        self.flush()
        self.out.close()
        return self.total


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, partitions: int | None = None) -> list[dict]:
    """Encodes all texts of docs(doc_id, text) into shards under folder (a URI that pyarrow.fs knows), in ascending doc_id order.

    Null ids come first and null texts are empty; rows of one id are ordered by their text. Every document ends with
    end_id. Returns a dict for each shard: path, index path, documents and ids in it, ids before it. A file is named by
    its task attempt, and only what a finished attempt reports is listed, so lost executors and repeated tasks do no harm.
    """
    spark = docs.sparkSession
    n = partitions
    if not n:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / SHARD_CHARS))
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, writer = encoder(tokenizer), TaskContext.get(), None
        store, root = pafs.FileSystem.from_uri(folder)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        ids_path, docs_path = f"{root}/{name}.ids.arrow", f"{root}/{name}.docs.arrow"
        schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                sinks = store.open_output_stream(ids_path), store.open_output_stream(docs_path)
                writer, index = ShardWriter(sinks[0], enc.dtype, sequence, BATCH), pa.ipc.new_file(sinks[1], schema)
            at = 0
            for ids, sizes in enc.encode(batch.column(1)):
                before, k = writer.total, len(sizes)
                ends = np.cumsum(sizes + 1)
                whole = np.empty(int(ends[-1]), enc.dtype)
                last = np.zeros(len(whole), bool)
                last[ends - 1] = True
                whole[last], whole[~last] = end_id, ids
                writer.add(whole)
                columns = [batch.column(0)[at : at + k], pa.array(before + ends - sizes - 1), pa.array(sizes + 1)]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                at += k
            count += at
        if writer is not None:
            total = writer.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "ids": [ids_path], "docs": [docs_path], "n_docs": [count], "n_ids": [total]})

    # one row a shard
    shards, before = [], 0
    for r in sorted(ordered.mapInArrow(run, "shard long, ids string, docs string, n_docs long, n_ids long").collect(), key=lambda r: r["shard"]):
        shards.append(r.asDict() | {"before": before})
        before += r["n_ids"]
    return shards


def open_file(store: pafs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))


def sequence_at(store: pafs.FileSystem, path: str, k: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids (without copying) and mask of sequence k of a shard."""
    rows = open_file(store, path).get_batch(k // batch)
    size = rows.column(0).type.list_size
    ids, mask = (rows.column(c)[k % batch : k % batch + 1].flatten() for c in (0, 1))
    assert len(ids) == size
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(store: pafs.FileSystem, shard: dict) -> Iterator[tuple[list, list[int], list[int], list[int]]]:
    """(doc_id, start, n_tokens, crc32 of the ids) of a shard's documents, an index batch at a time, from its files."""
    ids, index = open_file(store, shard["ids"]), open_file(store, shard["docs"])
    k, have, values = -1, 0, np.empty(0, np.uint16)
    for b in range(index.num_record_batches):
        rows = index.get_batch(b)
        crcs = []
        for n in rows.column(2).to_pylist():
            crc = 0
            while n:
                if not have:
                    k += 1
                    values = ids.get_batch(k).column(0).flatten().to_numpy()
                    have = len(values)
                take = min(n, have)
                crc = zlib.crc32(values[len(values) - have : len(values) - have + take].astype("<u4"), crc)
                have -= take
                n -= take
            crcs.append(crc)
        yield rows.column(0).to_pylist(), [shard["before"] + x for x in rows.column(1).to_pylist()], rows.column(2).to_pylist(), crcs


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; a task for each shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.sparkContext.broadcast(shards)  # a few hundred bytes a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for doc_id, start, n, crc in read_documents(store, listed.value[k]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, start, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)
