"""The boundary to language models: injected functions, caches, budgets, retries.

A chat function takes (system, user, schema) and returns JSON text; an embedding
function takes texts and returns vectors. Nothing here knows a service.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.logs import fingerprint

Chat = Callable[[str, str, dict], str]
Embed = Callable[[list[str]], list[list[float]]]

CITE_AGAIN = 3
DIMENSIONS, BATCH = 64, 64


class OverBudget(RuntimeError):
    """The money that a run may spend is spent."""


@dataclass
class Meter:
    """Tokens and money by model; unknown models cost the default."""

    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    default: tuple[float, float] = (0.15, 0.6)
    budget: float = float("inf")
    usd: float = 0.0
    tokens: dict[str, tuple[int, int]] = field(default_factory=dict)

    def add(self, model: str, tokens_in: int, tokens_out: int) -> float:
        a, b = self.prices.get(model, self.default)
        spent = (tokens_in * a + tokens_out * b) / 1e6
        self.usd += spent
        x, y = self.tokens.get(model, (0, 0))
        self.tokens[model] = x + tokens_in, y + tokens_out
        if self.usd > self.budget:
            raise OverBudget(f"{self.usd:.4f} of {self.budget:.4f} USD")
        return spent


def retried(call: Callable, attempts: int = 5, first: float = 1.0, most: float = 60.0, sleep=time.sleep, passes=(OverBudget,), only=Exception):
    """A call's result, after doubling waits with jitter between failures; those that aren't ``only`` end it at once."""
    for n in range(attempts):
        try:
            return call()
        except passes:
            raise
        except only:
            if n == attempts - 1:
                raise
            sleep(min(most, first * 2**n) * (0.5 + random.random() / 2))


class Pacer:
    """At most so many calls a minute; what it waits is counted apart from a call's latency."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.waited = 60 / per_minute, clock, sleep, 0.0, 0.0

    def wait(self) -> float:
        now = self.clock()
        pause = max(0.0, self.next - now)
        if pause:
            self.sleep(pause)
        self.next = max(now, self.next) + self.gap
        self.waited += pause
        return pause


def cache_key(kind: str, *parts, **options) -> str:
    """Options are part of a key only where they are set, so that adding one keeps old keys."""
    return fingerprint(kind, *parts, size=64, **options)


def embed_missing(chunks: DataFrame, cache: DataFrame, embed: Embed, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, embedding of all chunks: those of the cache, and the rest by calls of BATCH texts.

    Calls run where the rows are. Write the result before it is used twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for low in range(0, len(rows), BATCH):
                part = rows.iloc[low : low + BATCH]
                yield pd.DataFrame({key: part[key], "embedding": embed(part[text].fillna("").tolist())})

    kind = chunks.schema[key].dataType.simpleString()
    fresh = chunks.join(cache.select(key), key, "left_anti").select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
    return cache.select(key, "embedding").join(chunks.select(key), key, "left_semi").unionByName(fresh)


def extract(chunks: DataFrame, chat: Chat, system: str, schema: dict, result: str, attempts: int = 2) -> DataFrame:
    """chunk_id, extraction (parsed as ``result``), error, attempts: one of extraction and error is null.

    A reply that isn't JSON is asked for again with the error; a failing call
    gives an error row, never a failed job.
    """

    def ask(row) -> tuple[str | None, str | None, int]:
        user, error = row.text or "", None
        for n in range(1, attempts + 1):
            try:
                reply = chat(system, user if error is None else f"{user}\n\nThe last reply was rejected: {error}", schema)
                json.loads(reply)
                return reply, None, n
            except ValueError as e:
                error = str(e)
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:300], n
        return None, error, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [ask(r) for r in rows.itertuples()]
            yield pd.DataFrame({"chunk_id": rows["chunk_id"], "reply": [f[0] for f in found], "error": [f[1] for f in found], "attempts": [f[2] for f in found]})

    rows = chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, reply string, error string, attempts long")
    return rows.select("chunk_id", F.from_json("reply", result).alias("extraction"), "error", "attempts")


def make_plan(question: str, chat: Chat, system: str, schema: dict):
    """(plan, error): a plan for any question; vectors alone where the model gives none."""
    from quillgraph.operators.routing import ROUTES, SHAPES, Plan

    try:
        found = json.loads(chat(system, question, schema))
        plan = Plan(**{k: found[k] for k in ("route", "confidence", "entities", "shape", "chain") if k in found})
        if plan.route not in ROUTES or plan.shape not in SHAPES:
            raise ValueError("route or shape isn't known")
        return plan, None
    except Exception as e:
        return Plan("vector", "low"), f"{type(e).__name__}: {e}"[:200]


def synthesise(question: str, context: str, valid: set[str], chat: Chat, system: str, schema: dict) -> dict:
    """An answer whose every claim cites what the context shows, or a refusal with its reason.

    Wrong citations are sent back, named, so that a retry differs; after
    CITE_AGAIN attempts the answer is refused.
    """
    refused = lambda why, n: {"answerable": False, "refusal_reason": why, "claims": [], "attempts": n}
    if not context:
        return refused("no_context", 0)
    user = f"{question}\n\n{context}"
    for n in range(1, CITE_AGAIN + 1):
        try:
            reply = chat(system, user, schema)
        except Exception as e:
            return refused(f"synthesiser_unreachable:{type(e).__name__}", n)
        try:
            answer = json.loads(reply)
            claims = [{"text": c["text"], "citations": [x.strip().strip("[]").strip() for x in c["citations"]]} for c in answer.get("claims", [])]
        except (ValueError, KeyError, TypeError, AttributeError):
            return refused("synthesiser_invalid_answer", n)
        if not answer.get("answerable"):
            return refused(answer.get("refusal_reason") or "model_refused", n)
        wrong = sorted({x for c in claims for x in c["citations"]} - valid)
        bare = sum(not c["citations"] for c in claims)
        if not wrong and not bare:
            return {"answerable": True, "refusal_reason": None, "claims": claims, "attempts": n}
        user = f"{question}\n\n{context}\n\nThese ids were not shown: {', '.join(wrong)}. {bare} claims cite nothing. Cite only ids that are shown."
    return refused("citation_unrecoverable", CITE_AGAIN)


def judge(question: str, reference: str, answer: str, chat: Chat, system: str, schema: dict) -> str:
    """A verdict, or ``ungraded`` where none can be had."""
    try:
        found = json.loads(chat(system, f"Question: {question}\n\nReference:\n{reference}\n\nAnswer:\n{answer}", schema))["verdict"]
        return found if found in ("correct", "partial", "incorrect", "unverifiable") else "ungraded"
    except Exception:
        return "ungraded"


def fake_embed(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Deterministic vectors: sums of hashed words. For tests and offline runs."""
    out = []
    for text in texts:
        vector = [0.0] * dimensions
        for word in text.lower().split():
            h = hashlib.sha256(word.encode()).digest()
            vector[h[0] % dimensions] += 1 if h[1] & 1 else -1
        out.append(vector)
    return out
