"""The corpus pipeline: five stages from raw documents to token files, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, mixing, rules, similar, token_files
from sievewright.llm.common import Scratch, shared_dir, table, written
from sievewright.llm.components import components
from sievewright.llm.queries import tokenizer_file

#: Near duplicates of this stage share this much of their sets of five-word shingles.
SHINGLE = 5
SIMILARITY = 0.8
#: Up to so many ids (16 MB), documents are taken out by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled documents of the stage's input."""
    return rules.accepted(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash that only rows with equal id and text share, and its column's name, which no column of docs has; null is an id, and a text, of its own."""
    null, name = (lambda c: F.col(c).isNull()), "_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    key = F.xxhash64(null("doc_id"), F.coalesce(F.col("doc_id"), F.lit(0)), null("text"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn(name, key), name


def without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs without those whose key is in keys(_key), which are written first, so that their number is known."""
    gone = written(keys.select("_key").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)  # the texts needn't be shuffled
    return docs.join(gone, docs[key] == gone["_key"], "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays, null being the largest; of repeated rows, one.

    Documents are linked if they have at least SIMILARITY of their five-word shingles in common. Fingerprints of SimHash
    find most links, an exact join the rest. The groups are the components of all links of the stage's input, those of
    documents that go included. Equal texts are one node, as are texts without words.
    """
    (docs, key), scratch = keyed(docs), Scratch(spark)
    words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    node = F.when(words, F.xxhash64("text")).otherwise(F.lit(0))
    rows = scratch.written(docs.select("doc_id", F.col(key).alias("_key"), node.alias("node")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    firsts = scratch.written(rows.groupBy("node").agg(F.min(order).alias("first")), "firsts")
    # words end before a blank or the text's end, and every shingle begins with another word
    most = F.greatest(F.lit(1), F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) + 2 - SHINGLE)
    texts = docs.where(words).select(node.alias("id"), "text", most.alias("most"))
    roots = components(similar.similar_edges(texts, scratch, SIMILARITY, SHINGLE), scratch)
    kept = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    repeated = scratch.written(rows.groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    gone = written(rows.select("_key").distinct().join(kept.select("first._key"), "_key", "left_anti").distinct(), "gone")
    once = written(docs.join(repeated, docs[key] == repeated["_key"], "left_semi").dropDuplicates([key]), "once")
    single = without(docs, key, repeated.unionByName(gone).distinct())
    out = single.unionByName(without(once, key, gone)).drop(key)
    scratch.drop(collect=True)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, and no others of their id."""
    docs, key = keyed(docs)
    found = decontaminate.contamination(docs.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return without(docs, key, found.select(F.col("doc_id").alias("_key"))).drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and a row for each document in them."""
    folder = shared_dir(spark, "pipeline-tokens")
    return token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, tokenizer_file("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]

#: A fitted model, fingerprints and byte-pair encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
