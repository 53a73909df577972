"""Model calls behind one interface: a provider answers a batch of prompts inside a task.

A provider is a factory that a task calls once; what it returns maps a list of prompts to a
list of answers (dicts of the schema's fields). A failed prompt gets nulls and an error text
after `tries` attempts; it never fails the task. lexical() is a deterministic stand-in that
needs no network or model.
"""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

Provider = Callable[[], Callable[[list[str]], list[dict]]]


def wait_seconds(attempt: int, base: float = 1.0, most: float = 60.0, jitter: Callable[[], float] = random.random) -> float:
    """Exponential back-off with jitter."""
    return min(most, base * 2**attempt) * (0.5 + jitter() / 2)


def _attempt(call, prompt: str, fields: list[str], allowed: Mapping[str, Sequence[str]], tries: int, base: float) -> dict:
    error = None
    for k in range(tries):
        try:
            answer = call([prompt])[0]
            for f, known in allowed.items():
                if answer.get(f) not in known:
                    raise ValueError(f"unexpected {f}: {answer.get(f)!r}")
            return {f: answer.get(f) for f in fields} | {"error": None}
        except Exception as e:  # noqa: BLE001  any failure of the service becomes the row's error
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait_seconds(k, base))
    return dict.fromkeys(fields) | {"error": error}


def answered(df: DataFrame, prompt: str, provider: Provider, schema: str, workers: int = 8, tries: int = 3, backoff: float = 0.0, allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df with the answer fields of schema and error; up to `workers` prompts of a task are under way at once.

    allowed lists the values that a field may have: an answer with another value is a failure, and asked again.
    Use df.repartition(n) before it to bound how many tasks call the service.
    """
    fields = _parse_datatype_string(schema)
    names = fields.fieldNames()
    out = StructType([*df.schema, *fields]).add("error", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = provider()
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(lambda p: _attempt(call, p, names, allowed or {}, tries, backoff), batch[prompt]))
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=[*names, "error"], dtype=object)], axis=1)

    return df.mapInPandas(run, out)


def lexical() -> Callable[[list[str]], list[dict]]:
    """For prompts 'A<newline>---<newline>B': the share of A's words that B has, as score and as log-probabilities."""
    from math import log

    def call(prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            a, _, b = p.partition("\n---\n")
            x, y = set(a.lower().split()), set(b.lower().split())
            s = (len(x & y) + 0.5) / (len(x) + 1)
            out.append({"score": s, "yes": log(s), "no": log(1 - s), "prompt_tokens": len(p.split()), "completion_tokens": 1})
        return out

    return call


def keywords(fields: Mapping[str, Mapping[str, Sequence[str]]]) -> Callable[[list[str]], list[dict]]:
    """For each field the value whose words stand most often in the prompt's last part (after a line ':'-head), the first of equals."""

    def call(prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            seen = Counter(p.rpartition(":\n")[2].lower().split())
            out.append({f: max(values, key=lambda v, values=values: sum(seen[w] for w in values[v])) for f, values in fields.items()})
        return out

    return call


SCORERS: dict[str, Provider] = {"lexical": lambda: lexical()}


def scorer(name: str) -> Provider:
    """The registered provider of a name."""
    if name not in SCORERS:
        raise KeyError(f"unknown scorer {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def pointwise_prompt(query: Column, candidate: Column) -> Column:
    return F.concat(query, F.lit("\n---\n"), candidate)


def labels_valid(labels: Column) -> Column:
    """Whether the four answers of the grounding filter are all there."""
    return F.forall(F.array(*(labels[c].isNotNull() for c in ("future_changes", "new_experiments", "external_references", "grounded_in_paper"))), lambda x: x)
