"""Where models plug in: protocols, the retry rule, and deterministic stand-ins that need no model.

The stand-ins are for tests and offline use; they aren't the models' equals."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Config


class Ocr(Protocol):
    def pages(self, content: bytes) -> list[dict]:
        """Rows of page (from 1), text or words (value, confidence, x1, y1, x2, y2), avg_confidence, error; a page that fails has an error and no text."""


class PageModel(Protocol):
    def reply(self, talk: list[dict], forced: bool) -> dict:
        """The next step after the messages (role, content): {"tool": "fetch_page", "page": n}, {"tool": "submit_chunks", "chunks": [...]}, or
        {"text": ...}, which holds the chunks; forced: it has to submit."""


class FixModel(Protocol):
    def fix(self, lines: list[dict]) -> list[dict]:
        """For rows of id, text, before and after: rows of id and action, which is merge_before, merge_after or standalone."""


class RegexModel(Protocol):
    def ask(self, prompt: str) -> str:
        """An answer whose last line is "regex:" and a pattern of chapter titles, or NONE."""


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class ChunkScorer(Protocol):
    def score(self, query: str, chunks: list[tuple[str, str]]) -> tuple[list[dict], int, int]:
        """Rows of chunk_id, score, reason, and the tokens in and out."""


class AnswerModel(Protocol):
    def answer(self, message: str) -> tuple[str, int, int]: ...


class HashedWords:
    """An embedder of hashed words, unit length."""

    def __init__(self, dim: int = 1024) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
            if n := np.linalg.norm(row):
                row /= n
        return out


class WordOverlap:
    """A pair and chunk scorer: the share of the query's words that the text has."""

    def score_pair(self, query: str, text: str) -> float:
        q = set(query.lower().split())
        return len(q & set(text.lower().split())) / len(q) if q else 0.0

    def score(self, query: str, chunks: list) -> list[float] | tuple[list[dict], int, int]:
        if chunks and isinstance(chunks[0], str):
            return [self.score_pair(query, t) for t in chunks]
        return [{"chunk_id": c, "score": round(10 * self.score_pair(query, t)), "reason": "words in common"} for c, t in chunks], 0, 0


class FirstLines:
    """An answer model: the first lines of the context."""

    def answer(self, message: str) -> tuple[str, int, int]:
        return "\n".join(message.splitlines()[:5]), len(message), 0


class WholePages:
    """A page model: each page that it is shown is one chunk, with a table if a line begins with a bar."""

    def reply(self, talk: list[dict], forced: bool) -> dict:
        chunks, rows = [], talk[0]["content"].split("\n")
        heads = [(i, m) for i, x in enumerate(rows) if (m := re.match(r"\[第(\d+)页，共\d+页\]", x))] + [(len(rows), None)]
        for (at, m), (end, _) in zip(heads, heads[1:]):
            body = [x for x in rows[at + 1 : end] if re.match(r"L\d+: ", x)]
            if body:
                kind = "table" if any(re.match(r"L\d+: \s*\|", x) for x in body) else "text"
                chunks.append({"chunk_type": kind, "context_summary": "", "segments": [{"page": int(m[1]), "line_range": [1, int(re.match(r"L(\d+)", body[-1])[1])]}]})
        return {"tool": "submit_chunks", "chunks": chunks}


class StandAlone:
    """A fix model without answers: every line stands alone."""

    def fix(self, lines: list[dict]) -> list[dict]:
        return []


class Retrying:
    """A provider whose calls are made again by with_retry(); for those that talk to a service."""

    def __init__(self, inner: object, config: Config = Config(), wait: Callable[[float], None] = time.sleep) -> None:
        self._inner, self._config, self._wait = inner, config, wait

    def __getattr__(self, name: str):
        call = getattr(self._inner, name)
        return lambda *args: with_retry(lambda: call(*args), self._config, self._wait)


class ToolScorer:
    """A chunk scorer over a model that is given the chunks and calls a tool with their scores: send(message) -> (calls, tokens in, tokens out)."""

    def __init__(self, send: Callable[[str], tuple[list[tuple[str, str]], int, int]]) -> None:
        self.send = send

    def score(self, query: str, chunks: list[tuple[str, str]]) -> tuple[list[dict], int, int]:
        shown = "\n\n".join(f"[{c}]\n{t}" for c, t in chunks)
        calls, used, made = self.send(f"{query}\n\n{shown}")
        return tool_scores(calls), used, made


def embedded(df: DataFrame, make: Callable[[], Embedder], column: str = "text", config: Config = Config()) -> DataFrame:
    """df with `vector`; the embedder is made once in each worker and gets batches of the configured size. It isn't deterministic to Spark, so it isn't run twice unasked."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [model.encode(texts[i : i + config.embedding_batch]) for i in range(0, len(texts), config.embedding_batch)]
            yield pd.Series([row.tolist() for part in parts for row in part], dtype=object)

    return df.withColumn("vector", F.pandas_udf(encode, "array<float>").asNondeterministic()(F.col(column)))


def pair_scored(pairs: DataFrame, make: Callable[[], PairScorer]) -> DataFrame:
    """pairs(query, text, ...) with cross_encoder_score."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for queries, texts in batches:
            yield pd.Series([float(model.score(q, [t])[0]) for q, t in zip(queries, texts)], dtype="float64")

    return pairs.withColumn("cross_encoder_score", F.pandas_udf(score, "double").asNondeterministic()("query", "text"))


def preview(text: Column, chars: int = 1200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("…[截断]"))).otherwise(text)


def chunk_scores(candidates: DataFrame, make: Callable[[], ChunkScorer], config: Config = Config()) -> DataFrame:
    """candidates(query_id, query, id, text, rank) -> query_id, chunk_id, score, reason, ord, input_tokens, output_tokens.

    A model gets one query's chunks in batches; a batch whose answer is malformed gives no rows, a transport error is raised."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        model, rows = make(), []
        pdf = pdf.sort_values("rank")
        for i in range(0, len(pdf), config.score_batch):
            part = pdf.iloc[i : i + config.score_batch]
            found, used, made = model.score(part["query"].iloc[0], list(zip(part["id"], part["text"])))
            for j, x in enumerate(found):
                rows.append((part["query_id"].iloc[0], str(x["chunk_id"]), int(x["score"]), str(x.get("reason", "")), i * 1000 + j, used if j == 0 else 0, made if j == 0 else 0))
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "reason", "ord", "input_tokens", "output_tokens"])

    short = candidates.withColumn("text", preview(F.col("text"), config.preview_chars))
    return short.groupBy("query_id").applyInPandas(score, "query_id long, chunk_id string, score int, reason string, ord int, input_tokens long, output_tokens long")


class HttpError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def with_retry(call: Callable[[], object], config: Config = Config(), wait: Callable[[float], None] = time.sleep) -> object:
    """The call, again after delays that double if it fails, but for client errors other than 429, which are raised at once."""
    for attempt in range(config.retries + 1):
        try:
            return call()
        except HttpError as error:
            if 400 <= error.status < 500 and error.status != 429 or attempt == config.retries:
                raise
        except Exception:
            if attempt == config.retries:
                raise
        wait(config.retry_delay * 2**attempt)
    raise AssertionError("unreachable")


def json_answer(text: str) -> dict:
    """A model's JSON object, with or without a code fence; {} if it isn't one."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        found = json.loads(body)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def tool_scores(calls: list[tuple[str, str]], name: str = "submit_scores") -> list[dict]:
    """Score rows of a model's tool calls (name, JSON arguments): of exactly one call with the right name, else none."""
    if len(calls) != 1 or calls[0][0] != name:
        return []
    rows = json_answer(calls[0][1]).get("scores", [])
    return [r for r in rows if isinstance(r, dict) and "chunk_id" in r and "score" in r]


class Progress:
    """Reports steps with their times: start, end, end of a task. `clock` is for tests."""

    def __init__(self, report: Callable[[float | None, str], None] | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.report, self.clock, self.began = report, clock, None

    def start(self, text: str) -> None:
        self.began = self.clock()
        self._say(text)

    def end(self, text: str) -> None:
        if self.began is None:
            raise RuntimeError("end before start")
        self._say(f"{text} ({self.clock() - self.began:.1f}s)")
        self.began = None

    def done(self, text: str) -> None:
        self._say(text)

    def _say(self, text: str) -> None:
        if self.report:
            self.report(None, text)
