"""Statements inside answers: finding them, splitting them into tokens, and telling whole ones from ones that break off."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

TOKEN = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|\d+(?:\.\d+)?|[^\W\d]\w*|<=|>=|<>|!=|\|\||::|.", re.S)

#: Words of SQL that are never names.
KEYWORDS = frozenset(
    "select distinct from where and or not in is null like ilike between exists case when then else end as on join inner left right full outer cross natural using "
    "group by having order asc desc nulls first last limit offset fetch union all intersect except with recursive over partition rows range preceding following "
    "count sum avg min max round coalesce nullif cast stddev rank dense_rank row_number ntile extract lower upper trim length substring abs true false int integer "
    "bigint double precision numeric decimal text varchar date timestamp interval year month day filter within".split()
)
#: Words and marks after which a statement cannot end.
OPEN_ENDED = frozenset("select distinct from where and or not in like ilike between exists case when then else as on join inner left right full outer cross natural using group by having order nulls limit offset fetch union all intersect except with recursive over partition = < > <= >= <> != + - * / % || :: , . (".split())
#: Words that may begin a further line of a statement.
CONTINUES = frozenset("select from where and or on join inner left right full cross natural using group having order limit offset fetch union intersect except when then else end case with".split())

START = re.compile(r"^[ \t]*(?:sql[ \t]*:[ \t]*)?(?=(?:select\b|with\s+\w+))", re.I | re.M)
LABEL = re.compile(r"^[ \t]*sql[ \t]*:[ \t]*", re.I | re.M)
FENCE = re.compile(r"^[ \t]*```\w*[ \t]*$|```(?:sql)?", re.M | re.I)
COMMENT = re.compile(r"^[ \t]*--[^\n]*$", re.M)


def split_answer(text: str) -> tuple[str | None, str]:
    """(statement or None, the prose around or instead of it); fences, labels and comment lines are neither."""
    text = COMMENT.sub("", FENCE.sub("\n", text.replace("\r", "\n")))
    at = next((m for m in START.finditer(text) if _begins(text[m.end() :])), None)
    if not at:
        return None, LABEL.sub("", text).strip()
    before, rest = text[: at.start()], text[at.end() :]
    lines, out, after = rest.split("\n"), [], ""
    seen, last = _Lines(rest), max((i for i, line in enumerate(lines) if line.strip()), default=0)
    for i, line in enumerate(lines):
        word = re.match(r"\s*(\w+|.)", line)
        if i and word and word[1].lower() not in CONTINUES and word[1] not in "),(" and not _open(seen, lines[i - 1]) and not (i == last and _cut_word(line)):
            after = "\n".join(lines[i:])
            break
        end = seen.add(line)
        if end is not None:
            out, after = [rest[:end]], rest[end + 1 : seen.end] + "\n" + "\n".join(lines[i + 1 :])
            break
        out.append(line)
    return "\n".join(out).strip(), LABEL.sub("", before + "\n" + after).strip()


def _cut_word(line: str) -> bool:
    """A last line of one word in capitals, the beginning of a word that goes on with a statement."""
    m = re.fullmatch(r"\s*([A-Z]{2,})\s*;?\s*", line)
    return bool(m) and any(w.upper().startswith(m[1]) for w in CONTINUES)


def _begins(rest: str) -> bool:
    """SELECT, or WITH name and then AS or the end: prose may begin with `With`."""
    return rest[:6].lower() == "select" or bool(re.match(r"with\s+(?:recursive\s+)?\w+\s*(?:\Z|\(|as?\b)", rest, re.I))


class _Lines:
    """The first lines of a text, read on line by line: `end`, and `depth`, the parentheses open there by the tokens up to there.

    A quote that no later one closes yet is a token of its own; only a line with a quote can change that, so only then is the text read again, from there.
    """

    def __init__(self, text: str) -> None:
        self.text, self.end, self.depth = text, -1, 0
        self.lone: tuple[int, int] | None = None  # place of the first quote that isn't closed, and the depth there

    def add(self, line: str) -> int | None:
        """The place of the first semicolon, if there is one up to the end of `line`."""
        at = max(self.end, 0)
        self.end += 1 + len(line)
        if self.lone and ("'" in line or '"' in line):
            (at, self.depth), self.lone = self.lone, None
        for m in TOKEN.finditer(self.text, at, self.end):
            t = m[0]
            if t == ";":
                return m.start()
            if t in "'\"" and not self.lone:
                self.lone = m.start(), self.depth
            self.depth += (t == "(") - (t == ")")
        return None


def _open(seen: _Lines, last: str) -> bool:
    """Whether the lines so far, which end in `last`, end inside parentheses."""
    return seen.depth > 0 and not re.search(r"[.।?!]\s*\Z", last)


@dataclass
class Statement:
    tokens: list[str]
    skeleton: list[str]
    broken: bool  # by delimiters, last word or unknown names


def read(statement: str, columns: frozenset[str], tables: frozenset[str]) -> Statement:
    """Tokens, masked tokens, and whether the statement breaks off by its own form."""
    tokens = [t for t in TOKEN.findall(statement) if not t.isspace() and not t.startswith("--")]
    while tokens and tokens[-1] == ";":
        tokens.pop()
    low = [t.lower() for t in tokens]
    aliases: set[str] = set()
    for i, t in enumerate(low):
        named = t[0].isalpha() or t[0] == "_"
        if named and t not in KEYWORDS and i:
            if low[i - 1] == "as" or low[i - 1] in tables or (low[i - 1] == ")" and (i + 1 == len(low) or low[i + 1] != ".")):
                aliases.add(t)
            if i + 1 < len(low) and low[i + 1] == "as" and low[i - 1] in ("with", ",", "recursive"):
                aliases.add(t)
    skeleton, unknown, stack = [], False, []
    for i, t in enumerate(low):
        if t[0].isdigit():
            skeleton.append("0")
        elif t[0] in "'\"" and len(t) > 1:
            skeleton.append("s")
        elif t in KEYWORDS or not (t[0].isalpha() or t[0] == "_"):
            skeleton.append(t)
        elif t in tables:
            skeleton.append("T")
        elif t in columns:
            skeleton.append("C")
        elif t in aliases:
            skeleton.append(t if len(t) <= 2 else "A")
        elif i + 1 < len(low) and low[i + 1] == ".":
            skeleton.append(t)
        else:
            skeleton.append(t)
            unknown = True
        if t in "([":
            stack.append(t)
        elif t in ")]" and stack:
            stack.pop()
    cases = low.count("case") != low.count("end")
    quotes = any(t in "'\"" for t in low)
    tail = bool(low) and low[-1] in OPEN_ENDED and not (low[-1] == "*" and len(low) > 1 and low[-2] in ("(", "select", "."))
    lone = len(low) > 1 and low[-1] in aliases and len(low[-1]) <= 2 and low[-2] in OPEN_ENDED and low[-2] != "as"
    return Statement(tokens, skeleton, bool(stack) or cases or quotes or tail or lone or "from" not in low or unknown)


@lru_cache(1 << 14)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def prefix_hashes(skeleton: list[str]) -> list[int]:
    """A 64-bit hash of every prefix of the masked tokens, in one pass: each token's hash is mixed into a running state."""
    state, out = 0, []
    for t in skeleton:
        state = (state ^ _token_hash(t)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 29
        out.append(state - (1 << 64) if state >> 63 else state)
    return out
