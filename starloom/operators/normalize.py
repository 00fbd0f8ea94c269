"""Splitting one wide table into dimensions and facts with dense keys and resolved references.

A dimension's key numbers its distinct keys in the order of their first rows; the numbering runs over distinct keys, never over the wide
rows. References are joins on struct keys (so a '|' inside a value can't make two keys one), broadcast if the dimension is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.sizes import broadcast_if_small
from starloom.functions.transforms import complete, is_valid, strip, struct_key, text_of, transformed
from starloom.lineage import cut
from starloom.model import StarSpec, TableSpec


def dense_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers 1.. in the order of `order`, from range-sorted partitions and a prefix sum over their counts: no single task sorts all rows."""
    sorted_ = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sorted_ = cut(sorted_)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return sorted_.withColumn("_r", inside).join(F.broadcast(offsets), "_p").withColumn(out, (F.col("_off") + F.col("_r")).cast("long")).drop("_p", "_off", "_r")


def clean_rows(wide: DataFrame, spec: StarSpec) -> DataFrame:
    """Rows whose required cells are all valid; columns become _c0.. and keep `_pos`."""
    names = [c for c in wide.columns if c != "_pos"]
    rows = wide.select("_pos", *[text_of(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)])
    used = set(spec.validation_columns)
    for t in (*spec.dimensions, *spec.facts):
        used |= {c.source_index for c in t.columns if c.source_index is not None} | set(t.dedup_columns)
    return rows.filter(complete([F.col(f"_c{i}") for i in sorted(used)]))


def _key_columns(t: TableSpec, parents: dict[str, str]) -> list:
    """The parts of a dimension's dedup key: natural key, raw cells, parents' keys."""
    natural = [transformed(F.col(f"_c{t.key_source_index}"), t.key_transform)] if t.key_source_index is not None else []
    return [*natural, *[F.col(f"_c{i}") for i in t.dedup_columns], *[F.col(parents[f.column]) for f in t.foreign_keys if f.column in parents]]


def _attach_parents(rows: DataFrame, t: TableSpec) -> tuple[DataFrame, dict[str, str]]:
    """Rows with the keys of the table's parents; parents not built yet stay null."""
    names = {}
    for f in t.foreign_keys:
        name = f"_k_{f.references}"
        names[f.column] = name
        if name in rows.columns:
            continue
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows, names


def _numbered(first: DataFrame, order: str, out: str, small: int = 100_000) -> DataFrame:
    """Rows written once, with numbers 1.. in the order of `order`: up to `small` of them, counted, in one sort, more by ranges."""
    kept = cut(first)
    if kept.count() > small:
        return cut(dense_numbers(kept, [order], out))
    return kept.withColumn(out, F.row_number().over(Window.orderBy(order)).cast("long"))


def _needed(spec: StarSpec, only: set[str] | None) -> set[str]:
    """The asked tables and what they refer to."""
    tables = {t.name: t for t in (*spec.dimensions, *spec.facts)}
    left, out = list(only if only is not None else tables), set()
    while left:
        name = left.pop()
        if name in tables and name not in out:
            out.add(name)
            left += [f.references for f in tables[name].foreign_keys]
    return out


def split(wide: DataFrame, spec: StarSpec, strict_reference: bool = False, only: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the star, or those of `only` and what they refer to. `wide` has text cells and `_pos`; tables are built in the order of the specification.

    `strict_reference` leaves a dimension's derived columns out, as computed but unwritten; by default they are written. A fact without rows has no table.
    """
    rows = cut(clean_rows(wide, spec))  # one scan feeds all tables
    out: dict[str, DataFrame] = {}
    needed = _needed(spec, only)
    for t in spec.dimensions:
        if t.name not in needed:
            continue
        rows, parents = _attach_parents(rows, t)
        keyed = rows.withColumn("_key", struct_key(_key_columns(t, parents)))
        cells = [transformed(F.col(f"_c{c.source_index}"), c.transform).alias(c.target) for c in t.columns]
        if not strict_reference:
            cells += [_derived(t, c) for c in t.derived_columns]
        refs = [F.col(parents[f.column]).alias(f.column) for f in t.foreign_keys]
        natural = transformed(F.col(f"_c{t.key_source_index}"), t.key_transform) if t.key_source_index is not None else F.lit(None).cast("string")
        first = keyed.groupBy("_key").agg(F.min("_pos").alias("_first"), F.min_by(F.struct(natural.alias("_natural"), *refs, *cells), "_pos").alias("_row"))
        numbered = _numbered(first, "_first", "_id")
        key = F.when(is_valid(F.col("_row._natural")), F.col("_row._natural")).otherwise(F.col("_id").cast("string"))
        table = numbered.withColumn(t.key, key)
        out[t.name] = table.select(t.key, *[f"_row.{f.column}" for f in t.foreign_keys], *[F.col(f"_row.{c.target}") for c in t.columns if c.target != t.key], *([] if strict_reference else [F.col(f"_row.{c.target}") for c in t.derived_columns]))
        ids = broadcast_if_small(table.select("_key", F.col(t.key).alias(f"_k_{t.name}")))
        rows = keyed.drop(f"_k_{t.name}").join(ids, "_key", "left").drop("_key")
    for t in spec.facts:
        if t.name not in needed or rows.isEmpty():
            continue
        shared = next((f for f in t.foreign_keys if f.column == t.key), None)
        numbered = rows.withColumn("_id", F.col(f"_k_{shared.references}")) if shared else dense_numbers(rows, ["_pos"], "_id").withColumn("_id", F.col("_id").cast("string"))
        have = set(numbered.columns)
        refs = [(F.col(f"_k_{f.references}") if f"_k_{f.references}" in have else F.lit(None).cast("string")).alias(f.column) for f in t.foreign_keys if f is not shared]
        cells = [transformed(F.col(f"_c{c.source_index}"), c.transform).alias(c.target) for c in t.columns]
        out[t.name] = numbered.select(F.col("_id").alias(t.key), *refs, *cells, *[_derived(t, c) for c in t.derived_columns])
    return {name: table for name, table in out.items() if only is None or name in only}


def _derived(t: TableSpec, c) -> Column:
    if c.source_index is not None:
        return transformed(F.col(f"_c{c.source_index}"), c.transform).alias(c.target)
    base = next(x for x in t.columns if x.target == c.source_column)
    return transformed(transformed(F.col(f"_c{base.source_index}"), base.transform), c.transform).alias(c.target)


def rejoin(tables: dict[str, DataFrame], spec: StarSpec, fact: str) -> DataFrame:
    """A fact with its dimensions' columns again: the split undone."""
    t = next(x for x in spec.facts if x.name == fact)
    dims = {d.name: d for d in spec.dimensions}
    out = tables[fact]
    for f in t.foreign_keys:
        d = dims[f.references]
        out = out.join(tables[d.name].select(F.col(d.key).alias("_rk"), *[c.target for c in d.columns if c.target != d.key]), F.col(f.column) == F.col("_rk"), "left").drop("_rk")
    return out


def unpivot(df: DataFrame, ids: list[str], measures: list[str], name: str, value: str) -> DataFrame:
    """One row for each measure that isn't null or blank."""
    long = df.unpivot(ids, measures, name, value)
    return long.filter(strip(text_of(F.col(value))) != "")


def hierarchy(df: DataFrame, key: str, parent: str, often: int = 20) -> DataFrame:
    """(`key`, `root`, `level`) of a self-referencing table of any depth; a dangling parent starts a tree of its own.

    Every `often` levels the last one is checkpointed. A cycle is an error, whether its nodes hang on no root or a repeated key hangs them on one.
    """
    nodes = df.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    keys = nodes.select(F.col("k").alias("pk"))
    level = nodes.join(keys, F.col("p") == F.col("pk"), "left").filter(F.col("pk").isNull()).select("k", F.col("k").alias("root"), F.lit(1).alias("level"))
    found, depth = [level], 1
    while True:
        depth += 1
        level = nodes.join(level.select(F.col("k").alias("up"), "root"), F.col("p") == F.col("up")).select("k", "root", F.lit(depth).alias("level"))
        if depth % often == 0:
            level = cut(level)
        if level.isEmpty():
            break
        if depth % often == 0 and depth > keys.distinct().count():
            raise ValueError("a cycle below a root")
        found.append(level)
    out = cut(reduce(DataFrame.unionByName, found)).select(F.col("k").alias(key), "root", "level")
    if not nodes.join(out.select(F.col(key).alias("_k")), F.col("k") == F.col("_k"), "left_anti").filter("k is not null").isEmpty():
        raise ValueError("a cycle without a root")
    return out
