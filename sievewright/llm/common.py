"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, ASCII-only text rules, skew-safe joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the `[^...]+` contracts: what separates them, as a Java/RE2 class.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_BREAK = r"[\x20\x09-\x0D]+"

#: bytes.translate table: A-Z to a-z, every other ASCII byte outside 0-9 a-z to a space; UTF-8 bytes of other characters stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing on a local master (tests, a laptop) is a temporary folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables in the shared folder that are deleted together, once nothing is computed from them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, collect: bool = False) -> None:
        """Deletes the tables. collect: a collection on the driver then lets Spark's cleaner remove the shuffle files of their jobs too."""
        jvm = self.spark._jvm
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []
        if collect:
            gc.collect()
            jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower case in which only A-Z can become an ASCII letter; a null text is empty.

    lower() would also turn the Kelvin sign into an ASCII k, so that sign is exchanged for another non-ASCII letter first.
    The result serves comparisons with ASCII words; non-ASCII letters may be changed, but stay non-ASCII word characters.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))


def ascii_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id as text, mod 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """At most per_class labelled ids of each class outside the held-out fold, by hash order; repeated ids count once.

    Rows with a null id or label are left out. A written table of at most 2 * per_class rows, which may be broadcast.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    classes = [rows.where(F.col("_label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    return written(classes[0].unionByName(classes[1]), "labels")


def one_each(rows: DataFrame) -> DataFrame:
    """Of rows(doc_id, text, _label) that share an id, that with the smallest text, null being the largest; equal rows are combined before the shuffle."""
    least = F.min(F.struct(F.col("text").isNull().alias("none"), "text", "_label")).alias("r")
    return rows.groupBy("doc_id").agg(least).select("doc_id", "r.text", "r._label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
