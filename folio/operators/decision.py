"""Decisions by an outside provider: request budgets, choices, reranking. Off unless a provider is given.

Trimming is a loop whose next step depends on what is left; it runs row by row in Arrow batches.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENS = 512
CONFIDENCE_KEYS = ("confidence", "probability")
RERANKED = 8
MARK = " … "


class DecisionProvider(Protocol):
    def decide(self, request: dict) -> dict: ...


class Disabled:
    """The provider that answers nothing, so that callers keep their own order."""

    def decide(self, request: dict) -> dict:
        return {"answers": {}}


class HttpProvider:
    """Posts requests as JSON. After a transport or server error it rests for `cooldown` seconds, in which
    it fails at once; a refusal by the server (4xx) is an error without a rest."""

    def __init__(self, url: str, timeout: float = 3.0, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.url, self.timeout, self.cooldown, self.clock, self.until = url, timeout, cooldown, clock, 0.0

    def decide(self, request: dict) -> dict:
        if self.clock() < self.until:
            raise OSError("the decision endpoint rests after an error")
        post = urllib.request.Request(self.url, json.dumps(request).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(post, timeout=self.timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as e:
            if e.code >= 500:
                self.until = self.clock() + self.cooldown
            raise
        except OSError:
            self.until = self.clock() + self.cooldown
            raise


_DENSE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0002fa1f]")


def dense(c: str) -> bool:
    return _DENSE.fullmatch(c) is not None


def estimate(s: str) -> int:
    n = 0 if s.isascii() else len(_DENSE.findall(s))
    return n + -(-(len(s) - n) // 3)


def trimmed(s: str, tokens: int) -> str:
    """The beginning and the end of a text within the tokens, three parts to two, with a mark between."""
    if estimate(s) <= tokens:
        return s
    low, high = 0, len(s)
    made = lambda n: s[: n * 3 // 5] + MARK + (s[len(s) - (n - n * 3 // 5) :] if n - n * 3 // 5 else "")
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if estimate(made(middle)) <= tokens else (low, middle - 1)
    return made(low)


def strings(value: Any, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, text) of all texts in JSON."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from strings(v, (*path, i))


def request_size(value: Any) -> int:
    """Tokens of all texts and of the keys around them."""
    if isinstance(value, dict):
        return sum(estimate(k) + 1 + request_size(v) for k, v in value.items())
    if isinstance(value, list):
        return sum(map(request_size, value))
    return estimate(value) if isinstance(value, str) else 1


def fit(state: Any, tokens: int = TOKENS) -> Any:
    """The state with its longest texts halved, longest first, until it fits or none is left to halve."""
    state = json.loads(json.dumps(state))
    while request_size(state) > tokens:
        path, longest = max(strings(state), key=lambda x: estimate(x[1]), default=((), ""))
        size = estimate(longest)
        if size <= 8:
            break
        cut = trimmed(longest, size // 2)
        if not path:
            return cut
        if cut == longest:
            break
        place = state
        for p in path[:-1]:
            place = place[p]
        place[path[-1]] = cut
    return state


def fit_column(rows: DataFrame, json_col: str, tokens: int = TOKENS, out: str = "fitted") -> DataFrame:
    """Adds the fitted JSON of each row, its size before and after, and what is wrong with it.

    Null stays null; malformed JSON gives null and an error, and the other rows go on."""
    names, at = rows.columns, rows.columns.index(json_col)
    added = [out, "tokens_before", "tokens_after", "fit_error"]
    if clash := sorted({n.lower() for n in names} & set(added)):
        raise ValueError(f"columns that the result adds: {clash}")

    def parsed(x: str | None) -> tuple[Any, str | None]:
        try:
            return (None, None) if x is None else (json.loads(x), None)
        except (ValueError, RecursionError) as e:
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parsed(x) for x in batch.column(at).to_pylist()]
            before = [x for x, _ in read]
            after = [None if x is None else fit(x, tokens) for x in before]
            size = lambda xs: pa.array([None if x is None else request_size(x) for x in xs], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else json.dumps(x, ensure_ascii=False) for x in after], pa.string()), size(before), size(after), pa.array([e for _, e in read], pa.string())], [*names, *added])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, {out} string, tokens_before long, tokens_after long, fit_error string")


def choice(response: dict, question: str, options: list[str]) -> tuple[str | None, float | None]:
    """The chosen option and its confidence; no answer is None, an unknown option an error."""
    answer = (response.get("answers") or {}).get(question)
    if answer is None:
        return None, None
    chosen = answer.get("choice") if isinstance(answer, dict) else answer
    if chosen not in options:
        raise ValueError(f"not an option: {chosen}")
    sure = next((answer[k] for k in CONFIDENCE_KEYS if isinstance(answer, dict) and k in answer), None)
    return chosen, sure


def reranked(hits: DataFrame, probabilities: DataFrame) -> DataFrame:
    """The first eight hits by probability, the ones without one last; the others keep their places.

    hits: id, place (from 0), a ranking's bounded depth; probabilities: id, p. Adds `at`, the new place."""
    first = F.when(F.col("place") < RERANKED, 0).otherwise(1)
    p = F.when(F.col("place") < RERANKED, F.col("p"))
    order = Window.orderBy(first, F.desc_nulls_last(p), "place")
    return hits.join(probabilities, "id", "left").withColumn("at", F.row_number().over(order) - 1).orderBy("at")


def decide_each(rows: DataFrame, request_col: str, provider: Callable[[], DecisionProvider]) -> DataFrame:
    """(request, response): JSON answers of a provider that each task makes once; errors answer nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = provider()
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                try:
                    out.append(json.dumps(own.decide(json.loads(x))))
                except (OSError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["request", "response"])

    return rows.select(request_col).mapInArrow(run, "request string, response string")
