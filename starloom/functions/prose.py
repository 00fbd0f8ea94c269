"""Structured parts of generated prose: JSON fields and statements."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words with which a further line of a statement may begin, and after which one goes on.
_CLAUSE = re.compile(r"\s*(select|from|where|and|or|on|join|inner|left|right|full|cross|group|order|having|limit|offset|union|intersect|except|with|when|then|else|end|case|fetch|as|\)|\(|,|--)", re.I)
_GOES_ON = re.compile(r"(?:[,(=<>+*/|-]|\b(?:select|distinct|from|where|and|or|on|by|having|when|then|else|as|in|like|between|not|join|all))\s*\Z", re.I)
_PIECE = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|```|\n|[();]|(?P<stop>[.?!](?=\s|\Z))|\s[A-Z][a-z]+:(?!:)|.", re.S)
_BEGIN = re.compile(r"(?<!\w)(?:select\b(?=[\s*(])|with\s+(?:recursive\s+)?\w+\s*(?:\([^)]*\)\s*)?as\b)", re.I)


def fenced(text: str) -> list[str]:
    """Contents of the blocks between fences, in order; a fence stands at the start of a line or inside one, and the last block may be open."""
    blocks, at = [], text.find("```")
    while at >= 0:
        end = text.find("```", at + 3)
        body = text[at + 3 : end if end >= 0 else len(text)]
        tag, line_end, rest = body.partition("\n")
        blocks.append((rest if line_end and tag.strip().isalnum() or not tag.strip() else body).strip())
        at = text.find("```", end + 3) if end >= 0 else -1
    return blocks


def json_object(text: str | None) -> dict | None:
    """The object that a text is or holds: the whole text, else the last fenced block that is one, else from the first brace to the last."""
    if not text:
        return None
    blocks = [b.removeprefix("json").strip() for b in fenced(text)[::-1]]
    span = [text[text.find("{") : text.rfind("}") + 1]] if "{" in text else []
    for candidate in [text.strip(), *blocks, *span]:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def json_field(text: Column, name: str) -> Column:
    """A field of the object in the text, as JSON text for nested values; null if there is none."""

    @F.pandas_udf(T.StringType())
    def field(values: pd.Series) -> pd.Series:
        def one(v):
            found = (json_object(v) or {}).get(name)
            return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False)

        return values.map(one)

    return field(text)


def _from(text: str) -> str:
    """The statement that begins a text: up to a semicolon, a fence, the end of its sentence, a label, or a line that doesn't go on with it."""
    depth, done = 0, []
    for m in _PIECE.finditer(text):
        t = m[0]
        if t == "```" or not depth and (t == ";" or m["stop"] or t[0].isspace() and len(t) > 1):
            break
        if t == "\n" and not depth and not _CLAUSE.match(text, m.end()) and not _GOES_ON.search(text, 0, m.start()):
            break
        depth += (t == "(") - (t == ")")
        done.append(t)
    return "".join(done).strip().strip("`").strip()


def statement(text: str | None) -> str | None:
    """The first statement in prose: in a fenced block, after a label, after `the SQL query ... is`, else anywhere; null if there is none.

    Anywhere, a lower-case `select` or `with` counts only at the start of a line or after a mark, as prose uses these words too.
    """
    if not text:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    labelled = [text[m.end() :] for m in re.finditer(r"(?im)^\s*(?:final\s+)?sql(?:\s+query)?\s*:", text)]
    said = [text[m.end() :] for m in re.finditer(r"(?i)\bsql query\b[^\n;]*?\bis:?\s+(?=select\b|with\b)", text)]
    for candidate in (*fenced(text), *labelled, *said):
        if (m := _BEGIN.search(candidate)) and (found := _from(candidate[m.start() :])):
            return found
    for m in _BEGIN.finditer(text):
        before, rest = text[: m.start()], text[m.start() :]
        rest = rest.partition("`")[0] if before.endswith("`") else rest
        if (m[0][:4].isupper() or re.search(r"(?:\A|\n|[:`])[ \t]*\Z", before)) and (found := _from(rest)):
            return found
    return None


@F.pandas_udf(T.StringType())
def statement_of(values: pd.Series) -> pd.Series:
    return values.map(statement, na_action="ignore")
