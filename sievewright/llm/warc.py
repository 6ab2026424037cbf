"""WARC archives with revisit resolution.

Headers (id, payload digest and length) are written once, in one pass over the pages; only they are shuffled by digest. What they say is brought back to the pages by a
broadcast while there are few enough revisits, so that payloads stay where they are; else by a shuffle of pages. The smallest id of each digest is found by a pre-aggregating group, and joined back to the headers that have
company. Digests with very many records are joined by a broadcast, of which there is a proven bound, the rest by a
shuffle. Archives are gzip files with a member for each record, and have fresh headers.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch

#: Shorter payloads are never revisits.
LEAST_BYTES = 100
#: A digest with over this share of all records is frequent; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01
#: Up to so many revisits (about 20 MB), pages are told by a broadcast of them and payloads stay where they are; beyond it they are shuffled.
BROADCAST_REVISITS = 200_000
DATE = "1970-01-01T00:00:00Z"


def resolve(headers: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers(page_id, payload_digest, payload_bytes, ...) with record_type and refers_to.

    Of records with equal digests of at least least_bytes, those with the smallest id are responses and the others
    revisits of it. A null id is larger than all others.
    """
    headers = headers.where(F.col("payload_bytes") >= least_bytes), headers.where(F.coalesce(F.col("payload_bytes") < least_bytes, F.lit(True)))
    long, short = headers
    groups = scratch.written(long.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "originals")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = groups.where(F.col("_n") > max(1, int(total * HOT_SHARE))).select(F.col("payload_digest").alias("_hot"), F.col("_first").alias("_hot_first"))
    marked = long.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left")
    # a frequent digest leaves the shuffled join: its key is spread over nulls that no group has, by id
    cold = groups.where(F.col("_n") <= max(1, int(total * HOT_SHARE))).select(F.col("payload_digest").alias("_cold"), F.col("_first").alias("_cold_first"))
    key = F.when(F.col("_hot").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("hot-"), F.xxhash64("page_id").cast("string")))
    joined = marked.join(cold, key == F.col("_cold"), "left").withColumn("_first", F.coalesce("_hot_first", "_cold_first")).drop("_hot", "_hot_first", "_cold", "_cold_first")
    revisit = F.col("_first").isNotNull() & F.coalesce(F.col("page_id") != F.col("_first"), F.lit(True))
    joined = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")
    return joined.unionByName(short.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")))


def record_id(page_id: int | None, digest: str) -> str:
    """The same for rows of one id and payload only."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no block; its length and digest are those of the response's payload."""
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if payload is None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload or b"")))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + (payload or b"") + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> list[dict]:
    """Writes pages(page_id, url, html, payload_digest, payload_bytes, record_type, refers_to), an archive for each partition.

    Returns a dict for each archive. Its name holds the task attempt, and only finished attempts are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, ""
        for batch in batches:
            for page_id, url, html, digest, size, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store, root = pafs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass") if kind == "response" else None
                out.write(gzip.compress(record(page_id, url, digest, size, payload, refers_to), 1, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    return [r.asDict() for r in pages.select("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(run, "path string, n long").collect()]


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed members of a gzip file, one in memory at a time."""
    data = b""
    while data or (data := stream.read(block)):
        inflate, out = zlib.decompressobj(31), []
        while True:
            out.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                break
            data = stream.read(block)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(spark: SparkSession, folder: str, archives: list[dict]) -> DataFrame:
    """A row for each record of the archives; a response's digest and length are computed anew and must match its headers."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not archives:
        return spark.createDataFrame([], schema)
    listed = spark.sparkContext.broadcast(archives)  # a few dozen bytes an archive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        target = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(listed.value[k]["path"], compression=None) as stream:
                    for raw in members(stream):
                        fields, payload = parse(raw)
                        number = lambda name: int(x) if (x := fields.get(name, "")) and x != "None" else None  # noqa: E731, B023
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append({"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, target)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, target)

    return spark.range(0, len(archives), 1, len(archives)).mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str) -> list[dict]:
    """Writes a deduplicated archive of pages(page_id, url, html) under folder.

    A null html is an empty payload, a null url an empty target. Repeated rows of one id and payload are responses
    alike if the id is the payload's smallest, else revisits of it. Records hold what was given, a page's text without
    the answer it came in, so a response's block is the payload itself. Tables of headers are deleted at the end.
    """
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    headers = scratch.written(full.select("page_id", "payload_digest", "payload_bytes"), "headers")
    resolved = resolve(headers, scratch)
    revisits = scratch.written(resolved.where("record_type = 'revisit'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to").distinct(), "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    # only revisits are joined to the pages, by id and digest
    joined = full.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    joined = joined.withColumn("record_type", F.when(F.col("_digest").isNotNull(), "revisit").otherwise("response"))
    archives = write_archives(joined.withColumn("html", F.when(F.col("record_type") == "response", F.col("html"))), folder)
    scratch.drop()
    return archives


def archive_sql() -> str:
    """DuckDB SQL for the records of archive() over the view pages."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS o FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o IS NOT NULL AND page_id IS DISTINCT FROM o THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN o IS NOT NULL AND page_id IS DISTINCT FROM o THEN o END AS refers_to FROM f"""
