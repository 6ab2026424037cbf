"""Files: local texts, JSON lines with explicit schemas, results by topic, finished calls."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.schemas import content_id


def local_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, path, content): .md and .txt files below a folder, trimmed, without empty ones."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.trim("value", F.lit(" \t\r\n")).alias("content")).where("content <> ''")
    return rows.select(content_id(F.col("path"), F.col("content")).alias("document_id"), "path", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines folder; blank lines are skipped, and a missing folder is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_results(questions: DataFrame, folder: str, topic: str = "topic") -> None:
    """Questions in a folder for each topic. Overwrites."""
    questions.write.mode("overwrite").partitionBy(topic).parquet(folder)


def pending(calls: DataFrame, ledger_path: str, schema: str) -> DataFrame:
    """Calls without a finished response in the ledger."""
    done = read_jsonl(calls.sparkSession, ledger_path, schema).where("error IS NULL").select("call_id").distinct()
    return calls.join(done, "call_id", "left_anti")


class Store:
    """A run's small JSON documents, in any folder that Spark can reach. Tables belong into Parquet or JSON lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, data: object) -> None:
        """Overwrites; what JSON doesn't know is written as text."""
        path, store = self._place(name)
        out = store.create(path, True)
        try:
            out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=2, default=str).encode()))
        finally:
            out.close()

    def load(self, name: str) -> object | None:
        """None if there is no such document."""
        if not self.exists(name):
            return None
        rows = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def exists(self, name: str) -> bool:
        path, store = self._place(name)
        return store.exists(path)

    def names(self, pattern: str = "*.jsonl") -> list[str]:
        path, store = self._place(pattern)
        return sorted(x.getPath().getName() for x in store.globStatus(path) or [])


def save_run(store: Store, questions: DataFrame, states: DataFrame, evidence: dict, report: dict, topic: str = "topic") -> None:
    """A run's results: question pools by topic and topic states as tables, evidence statistics and the report as JSON."""
    save_results(questions, f"{store.folder}/questions", topic)
    states.write.mode("overwrite").parquet(f"{store.folder}/topic_states")
    store.save("evidence_stats.json", evidence)
    store.save("generation_report.json", report)


def expanded(value: object, env: dict[str, str]) -> object:
    """value, at any depth, with ${NAME:default} replaced by variables."""
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value) if isinstance(value, str) else value


def config(text: str, environment: dict[str, str] | None = None, run_id: str | None = None) -> dict:
    """A configuration in YAML (JSON where no YAML library is installed), in whose values ${NAME:default} stands for a variable
    of the environment. run_id replaces that of the file."""
    try:
        from yaml import safe_load as read
    except ImportError:
        read = json.loads
    out = expanded(read(text) or {}, dict(os.environ) if environment is None else environment)
    return out | {"run_id": run_id} if run_id is not None else out
