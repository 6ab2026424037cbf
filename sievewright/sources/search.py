"""Search over crawled pages by an inverted index: built once, read by term.

The index is three Parquet tables in a folder: postings(term, item, n) in order of term and item, so that a term's postings
lie in few row groups and a filter on terms reads only these; terms(term, pages), how many pages have a term; and
pages(item, title, url).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.text import WORD

TAG = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<[^>]*>"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def visible(html: Column) -> Column:
    """The text of a page, tags, scripts and comments as spaces."""
    return F.regexp_replace(html, TAG, " ")


@dataclass
class Index:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def postings(self, words: list[str]) -> DataFrame:
        """Postings of a few terms; the filter reaches the row groups."""
        return self.read("postings").where(F.col("term").isin(words))


def build_index(pages: DataFrame, folder: str, item: str = "page_id", text: str = "text", title: str = "title", url: str = "url") -> Index:
    """Writes the index of pages(item, text, title, url). A page without words has no postings; rows that share an item are one page.

    Counts are combined before the shuffle; ranges are of term and item, so a term that every page has is dealt over many files.
    """
    spark = pages.sparkSession
    counted = pages.select(F.col(item).alias("item"), F.explode(terms_of(F.col(text))).alias("term")).groupBy("term", "item").agg(F.count("*").alias("n"))
    counted.repartitionByRange("term", "item").sortWithinPartitions("term", "item").write.mode("overwrite").parquet(f"{folder}/postings")
    index = Index(spark, folder)
    index.read("postings").groupBy("term").agg(F.count("*").alias("pages")).write.mode("overwrite").parquet(f"{folder}/terms")
    pages.select(F.col(item).alias("item"), F.col(title).alias("title"), F.col(url).alias("url")).groupBy("item").agg(F.min("title").alias("title"), F.min("url").alias("url")).write.mode("overwrite").parquet(f"{folder}/pages")
    return index


def find(index: Index, query: str, limit: int = 5) -> DataFrame:
    """(item, hits, title, url): the pages that have all words of the query, those with the most occurrences first, then the least item. A query without words finds nothing."""
    words = sorted({r[0] for r in index.spark.range(1).select(F.explode(terms_of(F.lit(query)))).collect()})
    found = index.postings(words).groupBy("item").agg(F.count("*").alias("_words"), F.sum("n").alias("hits")).where(F.col("_words") == len(words))
    best = found.orderBy(F.col("hits").desc(), "item").limit(limit)
    return best.join(index.read("pages"), "item").select("item", "hits", "title", "url").orderBy(F.col("hits").desc(), "item")


def find_all(index: Index, queries: DataFrame, limit: int = 5, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, rank, item, hits) of many queries at once, as find() gives for each.

    Only the postings of a query's rarest word give candidates; each other word is looked up for these by term and page
    together, so a frequent word is neither listed nor in one task. A word that no page has ends its query.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(terms_of(F.col(query))).alias("words")).where(F.size("words") > 0)
    each = asked.select("query_id", F.size("words").alias("n_words"), F.explode("words").alias("term")).join(index.read("terms"), "term")
    known = each.groupBy("query_id", "n_words").agg(F.count("*").alias("_known"), F.min(F.struct("pages", "term")).alias("rarest")).where(F.col("_known") == F.col("n_words")).select("query_id", F.col("rarest.term").alias("rarest"))
    posting = index.read("postings")
    first = known.join(posting, known["rarest"] == posting["term"]).select("query_id", "item", "rarest", "n")
    others = each.join(known, "query_id").where("term <> rarest").select("query_id", "n_words", "term")
    wanted = first.join(others, "query_id").select("query_id", "item", "term")
    more = wanted.join(posting, ["term", "item"]).select("query_id", "item", "n")
    sizes = each.select("query_id", "n_words").distinct()
    hits = first.select("query_id", "item", "n").unionByName(more).groupBy("query_id", "item").agg(F.count("*").alias("_words"), F.sum("n").alias("hits")).join(sizes, "query_id").where(F.col("_words") == F.col("n_words"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "item"))
    return hits.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "rank", "item", "hits")
