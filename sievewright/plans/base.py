"""What the catalogue's queries start from, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import signals as S
from sievewright.operators.chunking import token_chunks
from sievewright.operators.units import single_units

SIZE, STRIDE = 200, 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of at least so many bytes a core has row groups enough for all cores.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt over all cores by the columns if it is small: one row group is one task, however many splits its file has.

    Only where the tasks that read it would be fewer than the cores is this worth a shuffle; larger tables stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores, *by) if size < SPREAD_BYTES * cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, with the source as topic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("topic"))
    return token_chunks(spread(docs, "doc_id", "text"), SIZE, SIZE - STRIDE)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_units(chunks(spark, sf_dir)).withColumns({"unit_id": F.col("chunk_id"), "unit_type": F.lit("single"), "usage_count": F.lit(0)})


CHUNKS_SQL = rf"""toks AS (SELECT doc_id, source AS topic, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents),
chunks AS (SELECT doc_id, topic, i::INTEGER AS chunk_index, doc_id::VARCHAR || '::chunk_' || printf('%04d', i::INTEGER) AS chunk_id, array_to_string(t[i * {STRIDE} + 1 : i * {STRIDE} + {SIZE}], ' ') AS text,
 len(t[i * {STRIDE} + 1 : i * {STRIDE} + {SIZE}])::INTEGER AS tokens FROM (SELECT *, unnest(range(0, (len(t) - 1) // {STRIDE} + 1)) AS i FROM toks WHERE len(t) > 0))"""


def phrase_sql(groups: list[list[str]]) -> str:
    """Counts of phrases in s, the text in which each word run stands between chr(1) and chr(2)."""
    one = lambda phrase: " ".join(rf"\x01{w}\x02" for w in phrase.split(" "))
    return " + ".join(f"len(regexp_extract_all(s, '(?i)(?:{'|'.join(one(p) for p in g)})'))" for g in groups)


def number_sql(k: int) -> str:
    return "len(regexp_extract_all(s, '" + [r"\x01\d{1,4}\x02(?:,\x01\d{3}\x02)*(?:\.\x01\d+\x02)?", r"\x01(?:19|20)\d{2}\x02", r"\x01\d+\x02(?:\.(?:\x01\d+\x02)?)?%\x01", r"\x01\d+\x02[-–]\x01\d+\x02"][k] + "'))"


def per_hundred_sql(count: str, full: float) -> str:
    return f"CASE WHEN tokens > 0 THEN least(({count}) * 100.0::DOUBLE / tokens / {float(full)}::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


WORDS_SQL = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


def signals_sql(source: str, name: str = "sig", summary: str | None = None) -> str:
    """CTEs for with_signals() over a CTE with text and tokens."""
    made = {n: per_hundred_sql(phrase_sql(groups), full) for n, (full, groups) in S.PHRASES.items()}
    made["numeric"] = per_hundred_sql(" + ".join(map(number_sql, range(4))), S.NUMERIC_FULL)
    made["entity"] = per_hundred_sql(r"len(regexp_extract_all(s, '\x01[A-Z][a-z]+\x02')) + 2 * len(regexp_extract_all(s, '\x01[A-Z][a-z]+\x02(?:\s+\x01[A-Z][a-z]+\x02)+'))", S.ENTITY_FULL)
    a, b = WORDS_SQL.format("text"), WORDS_SQL.format(summary or "''")
    made["alignment"] = f"CASE WHEN len({a}) > 0 AND coalesce(len({b}), 0) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END" if summary else "0.0::DOUBLE"
    made["length"] = "CASE WHEN tokens < 200 THEN tokens::DOUBLE / 200 WHEN tokens <= 600 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (tokens::DOUBLE - 600) / 600) END"
    pieces = r"regexp_split_to_array(trim(text, E' \t\r\n'), '[.!?]+')"
    full = rf"len(list_filter({pieces}, lambda x: trim(x, E' \t\r\n') <> ''))"
    short = rf"len(list_filter({pieces}, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) < 5))"
    made["ambiguity"] = f"CASE WHEN tokens > 0 THEN least(({phrase_sql([S.PRONOUNS])}) * 10.0::DOUBLE / tokens + {full} * 0.2::DOUBLE + {short} * 0.1::DOUBLE, 1.0::DOUBLE) ELSE 1.0::DOUBLE END"
    made["usage"] = "0.0::DOUBLE"
    made["years"] = number_sql(1)
    columns = ", ".join(f"{x} AS {n}" for n, x in made.items())
    return rf"{name}_s AS (SELECT *, regexp_replace(text, '[\p{{L}}\p{{N}}_]+', chr(1) || '\0' || chr(2), 'g') AS s FROM {source}), {name} AS (SELECT *, {columns} FROM {name}_s)"


def weighted_sql(weights: dict[str, float]) -> str:
    total = "0.0::DOUBLE"
    for n, w in weights.items():
        total = f"({total} + {w}::DOUBLE * {n})"
    return f"least(greatest({total}, 0.0::DOUBLE), 1.0::DOUBLE)"


SCORES_SQL = f"{weighted_sql(S.MCQ)} AS mcq_score, {weighted_sql(S.QA)} AS qa_score, {weighted_sql(S.HARD)} AS hard_score"
UNITS_SQL = f"{CHUNKS_SQL}, {signals_sql('chunks')}, units AS (SELECT *, chunk_id AS unit_id, {SCORES_SQL} FROM sig)"


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def race_sql(weight: str, *parts: str) -> str:
    return f"CASE WHEN {weight} > 0 THEN -ln(({hash_sql(*parts)} + 1)::DOUBLE / 4294967297.0::DOUBLE) / ({weight}) ELSE 1e300 END"
