"""A folder of crawled pages as a data source: <folder>/<language>/<Title_with_underscores>.html.

`crawl(spark, folder)` registers and reads it. Filters on language and on the title's beginning reach the listing, so
other files aren't opened; files are dealt into partitions by size and read in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "language string, title string, url string, html string, bytes long"
ENDING = ".html"
#: Bytes and files of a partition, and files of a batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_FILES = 64 << 20, 10_000, 64


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str, int]]


class CrawlReader(DataSourceReader):
    def __init__(self, folder: str, site: str):
        self.folder, self.site, self.languages, self.titles, self.beginnings = folder, site, None, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else {*f.value} if isinstance(f, In) else None
            if values is not None and f.attribute == ("language",):
                self.languages = values if self.languages is None else self.languages & values
            elif values is not None and f.attribute == ("title",):
                self.titles = values if self.titles is None else self.titles & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("title",):
                self.beginnings.append(f.value)
            else:
                yield f

    def wanted(self, title: str) -> bool:
        return (self.titles is None or title in self.titles) and all(title.startswith(b) for b in self.beginnings)

    def files(self) -> list[tuple[str, str, int]]:
        """(language, path, bytes) of the files that the filters leave."""
        store, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)
        folders = [x.path for x in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.Directory]
        out = []
        for folder in sorted(folders):
            language = folder.rsplit("/", 1)[1]
            if self.languages is None or language in self.languages:
                found = store.get_file_info(pafs.FileSelector(folder))
                out += [(language, x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(ENDING) and self.wanted(title_of(x.path))]
        return sorted(out)

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for f in self.files():
            if out[-1].paths and (size + f[2] > PARTITION_BYTES or len(out[-1].paths) >= PARTITION_FILES):
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f)
            size += f[2]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        for at in range(0, len(partition.paths), BATCH_FILES):
            rows = []
            for language, path, size in partition.paths[at : at + BATCH_FILES]:
                with store.open_input_stream(path) as stream:
                    html = stream.read().decode("utf-8", "replace")
                title = title_of(path)
                rows.append((language, title, f"https://{language}.{self.site}/wiki/{quote(title.replace(' ', '_'))}", html, size))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], ["language", "title", "url", "html", "bytes"])


def title_of(path: str) -> str:
    return path.rsplit("/", 1)[1].removesuffix(ENDING).replace("_", " ")


class CrawlSource(DataSource):
    """Options: path, the crawl's folder; site (example.org): where its urls point."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options["path"], self.options.get("site", "example.org"))


def crawl(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(language, title, url, html, bytes) of a crawl's pages. A folder that isn't there is an empty table; bytes that aren't UTF-8 are replaced."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlSource)
    return spark.read.format("crawl").options(**options).load(folder)
