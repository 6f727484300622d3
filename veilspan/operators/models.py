"""Model calls.  A model is a callable (prompt) -> answer, idempotent because tasks are retried.

Nothing here opens a connection by itself: ``http_model`` makes a callable for a chat endpoint of
the common JSON shapes, to be used where a network exists; tests use the deterministic ones.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

Model = Callable[[str], str]
# Headers that belong to one connection.
HOP_HEADERS = ("host", "content-length", "transfer-encoding", "connection", "accept-encoding")
CLASSIFY_CHARS = 500
PAUSE = 0.2  # seconds before the first retry


def _asked(prompts: list[str | None], model: Model, threads: int, retries: int) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt, several at a time; a null prompt is not asked."""

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        for left in range(retries, -1, -1):
            try:
                return model(prompt), None
            except Exception as e:  # whatever a user's callable raises
                if not left:
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(PAUSE * 2 ** (retries - left))
        return None, None

    if threads <= 1 or len(prompts) <= 1:
        return [one(p) for p in prompts]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, prompts))


def with_answer(df: DataFrame, prompt: Column, name: str, model: Model, threads: int = 1, retries: int = 0) -> DataFrame:
    """df with the model's answer per row and, as NAME_error, why there is none.  The other columns
    pass as Arrow batches; the answer is a column of its own, which no later step can move into
    another expression.  ``threads`` calls of a batch run at a time, for models that wait for a network."""
    schema = StructType([*df.schema.fields, StructField(name, StringType()), StructField(f"{name}_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = _asked(batch.column(batch.num_columns - 1).to_pylist(), model, threads, retries)
            columns = [*batch.columns[:-1], pa.array([a for a, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.withColumn("__prompt", prompt.cast("string")).mapInArrow(run, schema)


def failures(df: DataFrame, name: str) -> DataFrame:
    """How many calls failed, by reason."""
    return df.filter(F.col(f"{name}_error").isNotNull()).groupBy(F.col(f"{name}_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def answer(prompt: Column, model: Model) -> Column:
    """The model's answer per row as a column, null on failure; see ``with_answer`` for the reasons."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([a for a, _ in _asked([p if isinstance(p, str) else None for p in s], model, 1, 0)], dtype=object)

    return run.asNondeterministic()(prompt)  # never called twice for a row because of a plan rewrite


def _request(url: str, name: str, prompt: str, style: str, stream: bool, headers: dict | None, key_env: str) -> urllib.request.Request:
    body = {"model": name, "messages": [{"role": "user", "content": prompt}], "stream": stream}
    if style == "anthropic":
        body["max_tokens"] = 1024
    sent = {k: v for k, v in (headers or {}).items() if k.lower() not in HOP_HEADERS} | {"Content-Type": "application/json"}
    if key := os.environ.get(key_env, "") if key_env else "":
        sent |= {"x-api-key": key, "anthropic-version": "2023-06-01"} if style == "anthropic" else {"Authorization": f"Bearer {key}"}
    return urllib.request.Request(url, json.dumps(body).encode(), sent)


def http_model(url: str, name: str, style: str = "openai", timeout: float = 120.0, headers: dict | None = None, key_env: str = "") -> Model:
    """style: openai, anthropic or ollama; the key is in the environment variable ``key_env`` of the worker."""

    def call(prompt: str) -> str:
        with urllib.request.urlopen(_request(url, name, prompt, style, False, headers, key_env), timeout=timeout) as r:
            got = json.load(r)
        if style == "anthropic":
            return "".join(b.get("text", "") for b in got["content"])
        return got["message"]["content"] if style == "ollama" else got["choices"][0]["message"]["content"]

    return call


def http_events(
    url: str, name: str, style: str = "openai", timeout: float = 120.0, headers: dict | None = None, key_env: str = "",
) -> Callable[[str], Iterator[str]]:
    """As http_model, but the lines of the server-sent events of a streamed answer."""

    def call(prompt: str) -> Iterator[str]:
        with urllib.request.urlopen(_request(url, name, prompt, style, True, headers, key_env), timeout=timeout) as r:
            for line in r:
                if text := line.decode("utf-8").rstrip("\r\n"):
                    yield text

    return call


def event_lines(df: DataFrame, request: str, prompt: Column, source: Callable[[str], Iterator[str]]) -> DataFrame:
    """(request, seq, value): the event lines of each prompt's streamed answer, as ``parse_events``
    and ``restore_stream`` read them; a source that fails ends with an event of type error."""
    kind = df.schema[request].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, values = [], [], []
            for i, p in enumerate(batch.column(1).to_pylist()):
                lines = []
                try:
                    lines += source(p) if p is not None else []
                except Exception as e:  # whatever a user's callable raises
                    lines.append("event: error " + json.dumps(f"{type(e).__name__}: {e}"))
                ids += [i] * len(lines)
                seqs += range(len(lines))
                values += lines
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(seqs, pa.int64()), pa.array(values, pa.string())],
                names=[request, "seq", "value"],
            )

    schema = StructType([StructField(request, kind), StructField("seq", LongType()), StructField("value", StringType())])
    return df.select(request, prompt.cast("string").alias("__prompt")).mapInArrow(run, schema)


def forwarded_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*HOP_HEADERS))


_ROUTING = """Say whether a small model on this machine can answer the request, in one word: TRIVIAL or COMPLEX.
Facts, definitions, conversions and short rewrites are TRIVIAL; design, debugging, analysis and long texts are COMPLEX.

Request: What is the capital of Norway?
TRIVIAL

Request: Rework this service so that two writers cannot lose each other's updates, and explain the trade-offs.
COMPLEX

Request: Translate "good morning" into Spanish.
TRIVIAL

Request: """


def classification_prompt(text: Column) -> Column:
    """A few examples, then the beginning of the text."""
    return F.concat(F.lit(_ROUTING), F.substring(text, 1, CLASSIFY_CHARS))


def short_is_trivial(prompt: str) -> str:
    """A deterministic stand-in for a routing model: of what is asked, what is short and of one line is trivial."""
    asked = prompt[len(_ROUTING) :] if prompt.startswith(_ROUTING) else prompt
    return "TRIVIAL" if len(asked.split()) < 120 and "\n" not in asked.strip() else "I think COMPLEX"


def decision(raw: Column) -> Column:
    """The first decision word of an answer; none or a failure is COMPLEX."""
    word = F.upper(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?iU)\b(TRIVIAL|COMPLEX)\b", 1))
    return F.when(word != "", word).otherwise("COMPLEX")


_SOFTEN = [(re.compile(r"\bPlease\b"), "Kindly"), (re.compile(r"\bCan you\b"), "Could you"), (re.compile(r"\bMy guess is\b"), "It seems")]


def soft_rephrase(text: str) -> str:
    """A deterministic stand-in for a rephrasing model."""
    for p, new in _SOFTEN:
        text = p.sub(new, text)
    return text


def judge_yes(raw: Column) -> Column:
    """Whether a judge's answer begins with YES."""
    return F.coalesce(F.upper(F.trim(raw)).startswith("YES"), F.lit(False))
