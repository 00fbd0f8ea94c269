"""The interface of model-backed steps, a deterministic stand-in, and the checks around generated statements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.model import SchemaInfo

#: The nine kinds of question.
QUESTION_TYPES = ("Scan", "Aggregate", "Filter", "Sort", "TopSort", "Join", "Except", "Intersect", "Union")
NUMERIC = ("bigint", "integer", "int", "smallint", "double precision", "double", "numeric", "decimal", "real", "float")
TEMPORAL = ("date", "timestamp", "time")


class Generator(Protocol):
    def generate(self, prompt: str, temperature: float = 0.0) -> str: ...


class Stub:
    """Answers by rule: the same prompt always gets the same text; unknown prompts get ''."""

    def __init__(self, rules: list[tuple[str, str]] | None = None) -> None:
        self.rules = [(re.compile(p, re.I | re.S), a) for p, a in rules or ()]

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        return next((m.expand(a) for p, a in self.rules if (m := p.search(prompt))), "")


@dataclass
class Clients:
    """Separate models for statements and for questions; one given alone serves both."""

    sql: Generator
    question: Generator | None = None

    def for_questions(self) -> Generator:
        return self.question or self.sql


def generate_column(df: DataFrame, prompt: str, out: str, make: Callable[[], Generator]) -> DataFrame:
    """Generated text for each row's prompt; each task makes one generator and keeps it."""
    shape = df.withColumn(out, F.lit("").cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(**{out: [model.generate(p) if p else "" for p in frame[prompt]]})

    return df.mapInPandas(run, shape)


def shares(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to `total`, by largest remainder; ties by the order given."""
    whole = sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()} if whole else dict.fromkeys(weights, 0.0)
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: out[k] - exact[k])[: total - sum(out.values())] if whole else ():
        out[k] += 1
    return out


def type_of(sql: str) -> str:
    """The kind of question a statement answers, by its leading feature."""
    low = re.sub(r"\s+", " ", sql.lower())
    for word, kind in ((" except ", "Except"), (" intersect ", "Intersect"), (" union ", "Union")):
        if word in low:
            return kind
    if " join " in low:
        return "Join"
    if " group by " in low or re.search(r"\b(count|sum|avg|min|max)\s*\(", low):
        return "Aggregate"
    if " order by " in low:
        return "TopSort" if " limit " in low else "Sort"
    return "Filter" if " where " in low else "Scan"


def unsafe_uses(sql: str, schema: SchemaInfo) -> list[str]:
    """AVG or SUM of a column that isn't numeric, and numbers compared with columns neither numeric nor temporal; only `alias.column` is looked at."""
    alias = {}
    for m in re.finditer(r"\b(?:from|join)\s+\"?(\w+)\"?(?:\s+(?:as\s+)?(\w+))?", sql, re.I):
        alias[(m[2] or m[1]).lower()] = alias[m[1].lower()] = m[1].lower()
    kinds = {(t.name.lower(), n.lower()): k.lower() for t in schema.tables.values() for n, k in t.columns}

    def kind(a: str, c: str) -> str | None:
        return kinds.get((alias.get(a.lower(), a.lower()), c.lower()))

    out = []
    for m in re.finditer(r"\b(avg|sum)\s*\(\s*(\w+)\.(\w+)\s*\)", sql, re.I):
        k = kind(m[2], m[3])
        if k and not k.startswith(NUMERIC):
            out.append(m[0])
    for m in re.finditer(r"(\w+)\.(\w+)\s*(<=|>=|<>|=|<|>)\s*(\d+(?:\.\d+)?)\b", sql):
        k = kind(m[1], m[2])
        if k and not k.startswith(NUMERIC) and not k.startswith(TEMPORAL):
            out.append(m[0])
    return out
