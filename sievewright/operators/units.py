"""Evidence units: single chunks, and neighbouring chunks of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import signals as S
from sievewright.functions.signals import with_scores, with_signals, with_tags
from sievewright.functions.text import hash32


def single_units(chunks: DataFrame, summaries: DataFrame | None = None, document: str = "doc_id") -> DataFrame:
    """chunks with signals, scores and tags. summaries(document, summary): what chunks are aligned with; documents without one have an empty summary."""
    if summaries is not None:
        chunks = chunks.join(summaries, document, "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return with_tags(with_scores(with_signals(chunks, "summary" if summaries is not None else None)))


def windows(chunks: DataFrame, sizes: tuple[int, ...] = (2, 3), document: str = "doc_id", carry: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """(document, carry..., size, first_index, chunk_ids, texts, indices, sums...): runs of neighbouring chunks; one sort of each document for all sizes.
    Of chunks with tags, a run has tags too: those of any of its chunks, in order. sums: columns that a run has the sum of."""
    most, tagged = max(sizes), ["tags"] if "tags" in chunks.columns else []
    run = Window.partitionBy(document).orderBy("chunk_index").rowsBetween(0, most - 1)
    rows = chunks.withColumn("_run", F.collect_list(F.struct("chunk_index", "chunk_id", "text", *tagged, *sums)).over(run))
    rows = rows.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.size("_run")))).withColumn("_run", F.slice("_run", F.lit(1), F.col("size")))
    union = [merged_tags(F.col("_run.tags")).alias("tags") for _ in tagged]
    each = lambda c: [F.coalesce(F.get(F.col("_run"), F.lit(k))[c], F.lit(0)) for k in range(most)]
    added = [sum(each(c)[1:], each(c)[0]).alias(c) for c in sums]
    return rows.select(document, *carry, "size", F.col("chunk_index").alias("first_index"), F.col("_run.chunk_id").alias("chunk_ids"), F.col("_run.text").alias("texts"), F.col("_run.chunk_index").alias("indices"), *union, *added)


def multi_units(chunks: DataFrame, sizes: tuple[int, ...] = (2, 3), span: int = 3, most_tokens: int = 1500, document: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """windows() whose indices span at most `span` and whose joined text has at most most_tokens tokens."""
    from sievewright.functions.text import n_tokens

    w = windows(chunks, sizes, document, carry).withColumn("text", F.array_join("texts", " ")).withColumn("n_tokens", n_tokens(F.col("text")))
    return w.where((F.array_max("indices") - F.array_min("indices") <= span) & (F.col("n_tokens") <= most_tokens))


def scored_windows(chunks: DataFrame, sizes: tuple[int, ...] = (2, 3), document: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(document, carry..., size, first_index, chunk_ids, indices, tokens, signals, scores): windows() with the signals of their joined texts.

    Each chunk's text is read once: a window's counts are the sums of its chunks', corrected by what stands where they meet. chunks: with
    their texts, or with_counts() without them.
    """
    rows = chunks if "ends" in chunks.columns else S.with_counts(chunks)
    names = [c[2:] for c in rows.columns if c.startswith("c_")]
    # what is in the ends is counted in the joined ones
    own = {f"_{k}": F.coalesce(F.col(f"c_{k}") - F.col(f"e_{k}") if k in S.ACROSS else F.col(f"c_{k}"), F.lit(0)) for k in names}
    rows = rows.select(document, *carry, "chunk_index", "chunk_id", F.col("ends").alias("text"), F.coalesce("tokens", F.lit(0)).alias("tokens"), *(x.alias(k) for k, x in own.items()))
    w = windows(rows, sizes, document, carry, sums=("tokens", *own)).withColumn("_ends", F.array_join("texts", " "))
    w = S.across(w, "_ends", "_across")
    made = {k: F.col(f"_{k}") + F.col(f"_across_{k}") if k in S.ACROSS else F.col(f"_{k}") for k in names}
    return with_scores(S.from_counts(w, made)).drop("texts", "_ends", *own, *(f"_across_{k}" for k in S.ACROSS))


def multi_score(hard: bool = False) -> Column:
    """0.6 of hard or of the mean of mcq and qa, 0.25 of alignment, 0.15 of length."""
    base = F.col("hard_score") if hard else (F.col("mcq_score") + F.col("qa_score")) / 2
    return base * 0.6 + F.col("alignment") * 0.25 + F.col("length") * 0.15


def top_multi_units(chunks: DataFrame, count: int, hard: bool = False, topic: str = "topic", document: str = "doc_id", texts: bool = True) -> DataFrame:
    """The `count` best windows of each topic by multi_score() of their joined text; ties by document, first chunk and size. Without texts, documents are read once."""
    units = scored_windows(chunks, document=document, carry=(topic,)).withColumn("score", multi_score(hard))
    best = Window.partitionBy(topic).orderBy(F.round("score", 9).desc(), document, "first_index", "size")
    top = units.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    if not texts:
        return top
    # texts of the best ones only
    asked = top.select(topic, "rank", F.posexplode("indices").alias("_at", "chunk_index"), document)
    said = chunks.select(document, "chunk_index", "text").join(F.broadcast(asked), [document, "chunk_index"]).groupBy(topic, "rank").agg(F.array_sort(F.collect_list(F.struct("_at", "text")))["text"].alias("texts"))
    said = said.select(F.col(topic).alias("_topic"), F.col("rank").alias("_rank"), "texts", F.array_join("texts", " ").alias("text"))
    return top.join(said, F.col(topic).eqNullSafe(F.col("_topic")) & (F.col("rank") == F.col("_rank"))).drop("_topic", "_rank")


def merged_tags(tags: Column) -> Column:
    """The tags of any of several lists, null lists being empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(tags))))


def multihop_combos(chunks: DataFrame, least: int = 2, most: int = 4, factor: int = 2, document: str = "doc_id") -> DataFrame:
    """(document, combo_index, indices): random sets of chunks of each document, the same on every run.

    A document of one chunk has the set of it; one of fewer than `least` has none. For each size, draws take the chunks with
    the smallest hashes; a size of at least n chunks is drawn up to min(5, n div size) times. Repeated sets count once, and
    max(1, n div factor) stay. A draw's chunks are picked inside its document's row, as a document's chunk numbers fit there.
    """
    docs = chunks.groupBy(document).agg(F.count("*").cast("int").alias("n"))
    target = F.greatest(F.lit(1), F.floor(F.col("n") / factor).cast("int"))
    each = F.greatest(F.lit(1), F.floor(target / (most - least + 1)).cast("int"))
    one = docs.where("n = 1").select(document, F.lit(0).alias("combo_index"), F.array(F.lit(0)).alias("indices"))
    sized = docs.where(F.col("n") >= least).where("n > 1").withColumn("target", target).withColumn("size", F.explode(F.sequence(F.lit(least), F.lit(most)))).where("size <= n")
    draws = F.when(each >= F.col("n"), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("n") / F.col("size")).cast("int")))).otherwise(each)
    drawn = sized.withColumn("draw", F.explode(F.sequence(F.lit(1), draws)))
    key = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(hash32(F.col(document), F.col("size"), F.col("draw"), i).alias("h"), i.alias("i")))
    drawn = drawn.withColumn("indices", F.array_sort(F.transform(F.slice(F.array_sort(key), F.lit(1), F.col("size")), lambda x: x["i"])))
    first = drawn.groupBy(document, "target", "indices").agg(F.min(F.struct("size", "draw")).alias("first"))
    place = F.row_number().over(Window.partitionBy(document).orderBy("first"))
    return one.unionByName(first.withColumn("combo_index", place - 1).where(F.col("combo_index") < F.col("target")).select(document, "combo_index", "indices"))
