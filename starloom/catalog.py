"""Schemas, keys and constraints: parsing and writing DDL, the constraint registry, and the checks Spark does not make itself."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.dialect import TYPES, statements
from starloom.model import SchemaInfo, TableInfo

_NAME = r'(?:"[^"]+"|`[^`]+`|[\w.]+)'


def _bare(name: str) -> str:
    return name.strip().split(".")[-1].strip('"`')


def split_top_level(body: str) -> list[str]:
    """Parts of a column list between commas outside parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(body):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]] if p.strip()]


def parse_create_table(ddl: str) -> TableInfo | None:
    """Columns, primary key (inline, as a table constraint, else the first column) and foreign keys (inline or as constraints)."""
    m = re.search(rf"create\s+table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\(", ddl, re.I)
    if not m:
        return None
    depth, end = 1, m.end()
    while end < len(ddl) and depth:
        depth += {"(": 1, ")": -1}.get(ddl[end], 0)
        end += 1
    table = TableInfo(_bare(m[1]), [])
    names = lambda text: [_bare(x) for x in text.split(",")]
    for part in split_top_level(ddl[m.end() : end - 1]):
        if pk := re.match(r"(?:constraint\s+\S+\s+)?primary\s+key\s*\(([^)]*)\)", part, re.I):
            table.primary_key = names(pk[1])
        elif fk := re.match(rf"(?:constraint\s+\S+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+({_NAME})\s*(?:\(([^)]*)\))?", part, re.I):
            table.foreign_keys += [(a, _bare(fk[2]), b) for a, b in zip(names(fk[1]), names(fk[3] or fk[1]))]
        elif re.match(r"(?:constraint\s+\S+\s+)?(?:unique|check)\b", part, re.I):
            continue
        elif col := re.match(rf"({_NAME}(?<!\.))\s+(.*)", part, re.S):
            name, rest = _bare(col[1]), col[2]
            kind = re.split(r"\b(?:primary\s+key|references|not\s+null|null|unique|default|check|constraint)\b", rest, maxsplit=1, flags=re.I)[0].strip()
            table.columns.append((name, kind))
            if re.search(r"\bprimary\s+key\b", rest, re.I):
                table.primary_key = [name]
            if ref := re.search(rf"\breferences\s+({_NAME})\s*(?:\(([^)]*)\))?", rest, re.I):
                table.foreign_keys.append((name, _bare(ref[1]), _bare(ref[2] or name)))
    if not table.primary_key and table.columns:
        table.primary_key = [table.columns[0][0]]
    return table


def parse_script(ddl: str, database: str = "") -> SchemaInfo:
    found = [t for s in statements(ddl) if (t := parse_create_table(s))]
    return SchemaInfo(database, {t.name: t for t in found})


def spark_type(kind: str) -> str:
    low = re.sub(r"\s+", " ", kind.strip().lower())
    if low.startswith(("varchar", "character varying", "char", "text")):
        return "string"
    return TYPES.get(re.sub(r"\(.*", "", low).strip(), low) if not low.startswith("numeric(") else low.replace("numeric", "decimal")


def create_table(table: TableInfo) -> str:
    """DROP and CREATE TABLE in PostgreSQL's words, keys and references included."""
    lines = [f"    {n} {k}" for n, k in table.columns]
    lines += [f"    PRIMARY KEY ({', '.join(table.primary_key)})"] if table.primary_key else []
    lines += [f"    FOREIGN KEY ({c}) REFERENCES {t}({rc})" for c, t, rc in table.foreign_keys]
    return f"DROP TABLE IF EXISTS {table.name} CASCADE;\nCREATE TABLE {table.name} (\n" + ",\n".join(lines) + "\n);"


def create_database(spark: SparkSession, name: str) -> bool:
    """Whether the database (in lower case) was made now; one that is there is left as it is."""
    if spark.catalog.databaseExists(name.lower()):
        return False
    spark.sql(f"CREATE DATABASE `{name.lower()}`")
    return True


def create_tables(spark: SparkSession, folder: str, database: str | None = None, dry_run: bool = False) -> dict[str, list[str]]:
    """The tables of every DDL.csv below `folder`, in a database named like its folder unless one is given; `dry_run` only lists them."""
    from starloom.sources.tables import ddl_csv

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "DDL.csv").load(folder).select("path").orderBy("path").collect()
    out: dict[str, list[str]] = {}
    for (path,) in files:
        name = (database or path.split("/")[-2]).lower()
        for t in ddl_csv(path, name).tables.values():
            if not dry_run:
                create_spark_table(spark, name, t)
            out.setdefault(name, []).append(t.name.lower())
    return out


def from_spark(spark: SparkSession, database: str) -> SchemaInfo:
    """Tables and columns, in order, of one of Spark's databases; keys and references stay those of the registry, as Spark holds none."""
    tables = {}
    for t in spark.catalog.listTables(database):
        if t.isTemporary:
            continue  # of the session, not of the database
        found = spark.catalog.listColumns(f"{database}.{t.name}")
        tables[t.name] = TableInfo(t.name, [(c.name, c.dataType) for c in found], description=t.description or "")
    return SchemaInfo(database, tables)


def distinct_places(tables: dict[str, DataFrame], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(`level`, `n`): distinct given values of each administrative level over all tables that have one of its columns."""
    parts = []
    for level, names in columns.items():
        for df in tables.values():
            parts += [df.select(F.lit(level).alias("level"), F.upper(F.trim(F.col(c).cast("string"))).alias("v")) for c in df.columns if c.lower() in names]
    return reduce(DataFrame.unionByName, parts).filter("v <> ''").groupBy("level").agg(F.count_distinct("v").alias("n"))


def create_spark_table(spark: SparkSession, database: str, table: TableInfo) -> None:
    """The table in Spark's catalog (database and table in lower case); constraints stay in the registry."""
    db = database.lower()
    create_database(spark, db)
    spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{table.name.lower()}`")
    columns = ", ".join(f"`{n.lower()}` {spark_type(k)}" for n, k in table.columns)
    spark.sql(f"CREATE TABLE `{db}`.`{table.name.lower()}` ({columns}) USING parquet")


def execute_script(spark: SparkSession, script: str) -> list[tuple[str, str | None]]:
    """Each statement and its error, if any; later statements run all the same."""
    from starloom.dialect import to_spark

    out = []
    for s in statements(script):
        try:
            spark.sql(to_spark(s))
            out.append((s, None))
        except Exception as error:  # noqa: BLE001 - the report is the result
            out.append((s, str(error).splitlines()[0]))
    return out


def constraint_name(kind: str, *parts: str) -> str:
    """A name of at most 63 characters; longer ones end in part of their md5."""
    name = "_".join([kind, *parts]).lower()
    return name if len(name) <= 63 else f"{name[:54]}_{hashlib.md5(name.encode()).hexdigest()[:8]}"


def valid_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name))


def sync_foreign_keys(schema: SchemaInfo, contract: list[tuple[str, str, str, str]]) -> list[str]:
    """Adds missing columns and references of the contract to the registry; returns the names of what was added. Doing it twice adds nothing."""
    added = []
    for table, column, ref, ref_column in contract:
        if not all(map(valid_identifier, (table, column, ref, ref_column))):
            raise ValueError(f"not an identifier among {table}, {column}, {ref}, {ref_column}")
        t, r = schema.tables[table], schema.tables[ref]
        if column.lower() not in {n.lower() for n, _ in t.columns}:
            t.columns.append((column, dict(r.columns).get(ref_column, "BIGINT")))
            added.append(f"{table}.{column}")
        if r.primary_key != [ref_column]:
            name = constraint_name("uq", ref, ref_column)
            if name not in added:
                added.append(name)
        if (column, ref, ref_column) not in t.foreign_keys:
            t.foreign_keys.append((column, ref, ref_column))
            added.append(constraint_name("fk", table, column, ref))
    return added


def information_schema(spark: SparkSession, schema: SchemaInfo) -> dict[str, DataFrame]:
    """Views information_schema_tables, _columns, _key_columns and _references of a registered schema."""
    rows = {
        "tables": ([(schema.database, t.name.lower(), t.description) for t in schema.tables.values()], "table_schema string, table_name string, description string"),
        "columns": ([(schema.database, t.name.lower(), n.lower(), i, k) for t in schema.tables.values() for i, (n, k) in enumerate(t.columns, 1)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string"),
        "key_columns": ([(schema.database, t.name.lower(), c.lower()) for t in schema.tables.values() for c in t.primary_key], "table_schema string, table_name string, column_name string"),
        "references": ([(schema.database, a.lower(), b.lower(), c.lower(), d.lower()) for a, b, c, d in schema.edges()], "table_schema string, table_name string, column_name string, foreign_table_name string, foreign_column_name string"),
    }
    out = {name: spark.createDataFrame(data, shape) for name, (data, shape) in rows.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(f"information_schema_{name}")
    return out


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key)))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is given but has no parent."""
    keys = parent.select(F.col(parent_column).alias("_k"))
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")


def components(schema: SchemaInfo) -> list[set[str]]:
    """Connected components of the reference graph; tables number tens, so this is metadata work."""
    near = neighbours(schema)
    left, out = set(schema.tables), []
    while left:
        out.append(set(walk(near, min(left))))
        left -= out[-1]
    return out


def neighbours(schema: SchemaInfo) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {t: set() for t in schema.tables}
    for a, _, b, _ in schema.edges():
        if b in near:
            near[a].add(b)
            near[b].add(a)
    return near


def walk(near: dict[str, set[str]], start: str, most: int | None = None) -> list[str]:
    """Breadth-first order from `start`, the first `most` tables."""
    seen, queue = [start], deque([start])
    while queue and (most is None or len(seen) < most):
        for t in sorted(near[queue.popleft()]):
            if t not in seen and (most is None or len(seen) < most):
                seen.append(t)
                queue.append(t)
    return seen


def statistics(schema: SchemaInfo, counts: dict[str, int] | None = None) -> dict[str, float]:
    """Tables, columns, references, references per table, and rows if counted."""
    tables, columns, fks = len(schema.tables), sum(len(t.columns) for t in schema.tables.values()), len(schema.edges())
    return {"tables": tables, "columns": columns, "foreign_keys": fks, "fk_density": round(fks / tables, 2) if tables else 0.0, "rows": sum((counts or {}).values())}


def invalid_joins(sql: str, schema: SchemaInfo) -> list[tuple[str, str, str, str]]:
    """Equality predicates between two tables of a statement that no declared reference covers (either way round)."""
    alias = {}
    for m in re.finditer(rf"\b(?:from|join)\s+({_NAME})(?:\s+(?:as\s+)?(?!on\b|where\b|join\b|inner\b|left\b|right\b|full\b|cross\b|group\b|order\b|limit\b|using\b)(\w+))?", sql, re.I):
        alias[(m[2] or _bare(m[1])).lower()] = _bare(m[1]).lower()
    legal = {tuple(x.lower() for x in e) for e in schema.edges()}
    known = {t.lower() for t in schema.tables}
    out = []
    for m in re.finditer(r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)", sql):
        a, ac, b, bc = (x.lower() for x in m.groups())
        ta, tb = alias.get(a, a), alias.get(b, b)
        if ta in known and tb in known and (ta, ac, tb, bc) not in legal and (tb, bc, ta, ac) not in legal:
            out.append((ta, ac, tb, bc))
    return out
