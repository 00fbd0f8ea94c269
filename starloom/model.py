"""Plain descriptions of star schemas and of catalogued tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnSpec:
    source_index: int | None
    target: str
    transform: str | None = None
    source_column: str | None = None  # for derived columns: an already extracted column instead of an index


@dataclass(frozen=True)
class FkSpec:
    column: str
    references: str
    references_column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    dedup_columns: tuple[int, ...] = ()  # empty for facts
    key_column: str | None = None
    key_source_index: int | None = None
    key_transform: str | None = None
    foreign_keys: tuple[FkSpec, ...] = ()
    derived_columns: tuple[ColumnSpec, ...] = ()

    @property
    def key(self) -> str:
        return self.key_column or f"{self.name.removeprefix('DIM_').removeprefix('FACT_') if self.dedup_columns else self.name}_ID"


@dataclass(frozen=True)
class StarSpec:
    dimensions: tuple[TableSpec, ...]
    facts: tuple[TableSpec, ...]
    validation_columns: tuple[int, ...] = ()
    descriptions: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def from_config(config: Mapping) -> StarSpec:
        """From the mapping that a YAML schema configuration parses to."""

        def columns(items) -> tuple[ColumnSpec, ...]:
            return tuple(ColumnSpec(c.get("source_index"), c["target_name"], c.get("transform"), c.get("source_column")) for c in items or ())

        def table(name: str, t: Mapping, dimension: bool) -> TableSpec:
            fks = tuple(FkSpec(f["column"], f["references"], f.get("references_column", f["column"])) for f in t.get("foreign_keys") or ())
            listed = columns(t.get("columns"))
            dedup = tuple(t.get("dedup_columns") or ()) or (tuple(c.source_index for c in listed) if dimension else ())
            return TableSpec(name, listed, dedup, t.get("key_column"), t.get("key_source_index"), t.get("key_transform"), fks, columns(t.get("derived_columns")))

        def each(key: str, dimension: bool) -> tuple[TableSpec, ...]:
            found = config.get(key) or {}
            pairs = found.items() if isinstance(found, Mapping) else [(t["name"], t) for t in found]
            return tuple(table(name, t, dimension) for name, t in pairs)

        return StarSpec(each("dimension_tables", True), each("fact_tables", False), tuple(config.get("validation_columns") or ()), dict(config.get("table_descriptions") or {}))

    def errors(self, header: list[str]) -> list[str]:
        """Indices outside the header, and foreign keys to unknown tables."""
        out, names = [], {t.name for t in (*self.dimensions, *self.facts)}
        for t in (*self.dimensions, *self.facts):
            used = [c.source_index for c in (*t.columns, *t.derived_columns)] + [*t.dedup_columns, t.key_source_index]
            out += [f"{t.name}: column {i} is outside the {len(header)} columns" for i in used if i is not None and not 0 <= i < len(header)]
            out += [f"{t.name}.{f.column}: unknown table {f.references}" for f in t.foreign_keys if f.references not in names]
        return out


@dataclass
class TableInfo:
    name: str
    columns: list[tuple[str, str]]  # name, type
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)  # column, table, column
    description: str = ""


@dataclass
class SchemaInfo:
    database: str
    tables: dict[str, TableInfo] = field(default_factory=dict)

    def edges(self) -> list[tuple[str, str, str, str]]:
        return [(t.name, c, ref, rc) for t in self.tables.values() for c, ref, rc in t.foreign_keys]
