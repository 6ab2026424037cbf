"""Model clients. A client has complete(prompts) -> responses; the offline one is deterministic and the default."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.schemas import RESPONSES, content_id


class Client(Protocol):
    name: str

    def complete(self, prompts: list[str]) -> list[str]: ...


@dataclass
class OfflineClient:
    """Answers every prompt with one easy question about its first sentence."""

    name: str = "offline"

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            head = p.split(".")[0].strip()[:200]
            out.append(json.dumps([{"question": f"What does the text say about: {head[:60]}?", "answer": head or "nothing is said", "question_type": "factual", "estimated_difficulty": "easy", "citations": [{"chunk_id": "", "text": head or "-"}]}], ensure_ascii=False))
        return out


@dataclass
class HttpClient:
    """An endpoint with the common chat-completions interface. At most `parallel` calls of a task run at once."""

    name: str
    url: str = "http://localhost:8000/v1/chat/completions"
    key: str = ""
    parallel: int = 5
    retries: int = 3
    timeout: float = 60.0

    def one(self, prompt: str) -> str:
        return self.post({"model": self.name, "messages": [{"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]

    def post(self, message: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(message).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except OSError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(2**attempt)
        raise ValueError("retries must be at least 1")

    def complete(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self.one, prompts))


@dataclass
class JudgeClient:
    """Judges offline: true if prediction and gold answer are the same apart from case and blanks."""

    name: str = "judge"

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            last = p.rpartition("pred=")[2].partition("\nreason:")[0]
            prediction, _, gold = last.partition(" || gold=")
            out.append(f"compared ## {str(' '.join(prediction.lower().split()) == ' '.join(gold.lower().split())).lower()}")
        return out


@dataclass
class OllamaClient(HttpClient):
    """A local server with the generate interface."""

    url: str = "http://localhost:11434/api/generate"

    def one(self, prompt: str) -> str:
        return self.post({"model": self.name, "prompt": prompt, "stream": False})["response"]


@dataclass
class VllmClient(HttpClient):
    """A local server with the chat-completions interface."""

    url: str = "http://localhost:8000/v1/chat/completions"


@dataclass
class TransformersClient:
    """A local model, loaded once a worker. Needs the transformers library."""

    name: str
    device: str = "cpu"
    max_new_tokens: int = 512

    def complete(self, prompts: list[str]) -> list[str]:
        made = _pipelines.get((self.name, self.device))
        if made is None:
            from transformers import pipeline

            made = _pipelines[self.name, self.device] = pipeline("text-generation", model=self.name, device=self.device)
        return [r[0]["generated_text"] for r in made(prompts, max_new_tokens=self.max_new_tokens, return_full_text=False)]


_pipelines: dict[tuple[str, str], Callable] = {}
CLIENTS: dict[str, Callable[..., Client]] = {"offline": OfflineClient, "judge": JudgeClient, "http": HttpClient, "openai": HttpClient, "ollama": OllamaClient, "vllm": VllmClient, "transformers": TransformersClient}


def load(spec: dict) -> Client:
    kind = spec.get("kind", "offline")
    if kind not in CLIENTS:
        raise ValueError(f"unknown client {kind!r}; there are {sorted(CLIENTS)}")
    return CLIENTS[kind](**{k: v for k, v in spec.items() if k != "kind"})


def load_all(specs: list[dict], roles: dict[str, str] | None = None) -> dict[str, Client]:
    """Clients by name; with roles, also by role. Two clients of one name, or a role of an unknown one, are an error."""
    out: dict[str, Client] = {}
    for client in map(load, specs):
        if client.name in out:
            raise ValueError(f"two clients are named {client.name!r}")
        out[client.name] = client
    unknown = set((roles or {}).values()) - out.keys()
    if unknown:
        raise ValueError(f"roles name unknown clients {sorted(unknown)}")
    return out | {role: out[name] for role, name in (roles or {}).items()}


#: Rows, and characters of prompts, that are sent back to Spark together.
ROWS, CHARS = 1_024, 4_000_000


def said(client: Client, prompts: list[str], batch: int = 16) -> Iterator[tuple[list[str], list[str | None], list[str | None]]]:
    """(prompts, responses, errors) of ROWS prompts or more at a time, or of CHARS; the client gets `batch` of them a call."""
    asked, texts, errors, size = [], [], [], 0
    for at in range(0, len(prompts), batch):
        part = prompts[at : at + batch]
        try:
            got, error = list(client.complete(part)), None
            if len(got) != len(part):
                raise ValueError(f"{len(got)} responses to {len(part)} prompts")
        except Exception as e:  # noqa: BLE001  an endpoint may fail in any way
            got, error = [None] * len(part), f"{type(e).__name__}: {e}"
        asked, texts, errors, size = asked + part, texts + got, errors + [error] * len(part), size + sum(map(len, part))
        if len(asked) >= ROWS or size >= CHARS:
            yield asked, texts, errors
            asked, texts, errors, size = [], [], [], 0
    if asked:
        yield asked, texts, errors


def responses(prompts: DataFrame, client: Client, prompt: str = "prompt", batch: int = 16) -> DataFrame:
    """prompts with the columns of schemas.RESPONSES. call_id is a hash of model and prompt, so that a ledger can be resumed.
    A call that fails gives a row with its error; it never fails the task. Write the result before using it twice."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name != prompt]
    keep = [f.name for f in prompts.schema if f.name != prompt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names = 0, b.schema.names
            for asked, texts, errors in said(client, [p or "" for p in b.column(names.index(prompt)).to_pylist()], batch):
                n, strings = len(asked), lambda x: pa.array(x, pa.string())
                kept = [b.column(names.index(c)).slice(at, n) for c in (*keep, "call_id")]
                made = [strings([client.name] * n), strings(asked), strings(texts), pa.array([len(p.split()) for p in asked], pa.int64()), pa.array([len((t or "").split()) for t in texts], pa.int64()), strings(errors)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "call_id", "model", "prompt", "text", "input_tokens", "output_tokens", "error"])
                at += n

    called = prompts.withColumn("call_id", content_id(F.lit(client.name), F.col(prompt)))
    return called.mapInArrow(run, ", ".join([*columns, RESPONSES]))


def hierarchical_summary(calls: DataFrame, summarise: Callable[[F.Column], F.Column], document: str = "doc_id") -> DataFrame:
    """(document, summary): each call's text is summarised, and the summaries of a document of several calls are joined in order and summarised again."""
    first = calls.withColumn("_s", summarise(F.col("text")))
    joined = first.groupBy(document).agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call", "_s"))), lambda x: x["_s"]), " ").alias("_s"))
    return joined.select(document, F.when(F.col("_n") > 1, summarise(F.col("_s"))).otherwise(F.col("_s")).alias("summary"))
