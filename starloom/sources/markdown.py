"""Star specifications from Markdown design notes.

A note lists dimension and fact tables under second-level headings, each table under a third-level heading with bullet lines
"- `name` (TYPE, PK)" or "- `name` (TYPE, FK → TABLE)", and may map source columns to targets in a table under "COLUMN MAPPING".
"""

from __future__ import annotations

import re

from starloom.model import ColumnSpec, FkSpec, StarSpec, TableSpec

_BULLET = re.compile(r"^\s*-\s*`([^`]+)`\s*\(([^)]*)\)")
_REFERENCE = re.compile(r"FK\s*(?:→|->)\s*(\w+)", re.I)


def _loose(name: str) -> str:
    return " ".join(re.split(r"[_\-\s]+", name.strip().lower())).strip()


def find_column(name: str, header: list[str]) -> int | None:
    """Position of a column by name: exact, then loosely equal, then contained either way; the first hit of the first way that hits."""
    ways = (lambda a, b: a.strip().lower() == b.strip().lower(), lambda a, b: _loose(a) == _loose(b), lambda a, b: _loose(a) in _loose(b) or _loose(b) in _loose(a))
    return next((i for same in ways for i, h in enumerate(header) if same(name, h)), None)


def read_design(note: str, header: list[str]) -> StarSpec:
    """The note's tables as a specification over a CSV with this header; dimensions are deduplicated by all columns found."""
    part, table, listed = "", "", {}
    kinds: dict[str, str] = {}
    purposes: dict[str, str] = {}
    mapped: dict[tuple[str, str], int] = {}
    by_name: dict[str, int] = {}
    for line in note.splitlines():
        if re.match(r"^##\s+", line) and not line.startswith("###"):
            title = line.upper()
            part = next((k for k, words in (("dimension", "DIMENSION TABLES"), ("fact", "FACT TABLES"), ("mapping", "COLUMN MAPPING")) if words in " ".join(title.split())), "")
            table = ""
        elif m := re.match(r"^###\s*\**\s*([A-Za-z]\w*)", line):
            table = m[1].upper()
            if part in ("dimension", "fact"):
                kinds[table], listed[table] = part, []
        elif part == "mapping" and line.lstrip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if len(cells) < 5 or set(cells[0]) <= set("-: ") or cells[0].lower() == "original column":
                continue
            at = int(cells[1]) if cells[1].isdigit() else find_column(cells[0], header)
            if at is not None:
                for target in cells[3].split(","):
                    mapped[(target.strip().upper(), cells[4].upper())] = at
                by_name[cells[4].lower()] = by_name[cells[0].lower()] = at
        elif table and (m := _BULLET.match(line)):
            listed[table].append((m[1].strip().upper(), m[2]))
        elif table and (m := re.match(r"^\**Purpose:?\**:?\s*(.+)", line.strip())):
            purposes[table] = m[1].strip().strip("*").strip()

    def build(name: str) -> TableSpec:
        key, columns, references = None, [], []
        for column, note_ in listed[name]:
            if ref := _REFERENCE.search(note_):
                references.append(FkSpec(column, ref[1].upper(), column))
            elif re.search(r"\bPK\b", note_, re.I):
                key = column
            else:
                at = mapped.get((name, column), by_name.get(column.lower(), find_column(column, header)))
                if at is not None:
                    columns.append(ColumnSpec(at, column))
        dedup = tuple(c.source_index for c in columns) if kinds[name] == "dimension" else ()
        return TableSpec(name, tuple(columns), dedup, key or f"{name}_ID", foreign_keys=tuple(references))

    return StarSpec(tuple(build(t) for t, k in kinds.items() if k == "dimension"), tuple(build(t) for t, k in kinds.items() if k == "fact"), (), purposes)
