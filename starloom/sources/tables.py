"""Sources and sinks: CSV, JSON, DDL and query files, samples and results."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.catalog import parse_script, spark_type
from starloom.dialect import strip_comment_lines
from starloom.functions.transforms import path_parts
from starloom.model import SchemaInfo, StarSpec, TableInfo

TASK = ("question string, sql string, gold_sql string, pair_id string, original_question_id string, schema_used array<string>, linked_schema map<string,array<string>>, skeleton_id string, difficulty string, similarity_score double")
EVALUATION = ("pair_id string, question string, gold_sql string, sql string, predicted_sql string, raw_output string, em int, ex int, error string")
SCORES = ("db string, lang string, pair_id string, comet_score double, src string, mt string")


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text, missing and empty ones as ''; columns keep their order and are addressed by position."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    return df.na.fill("")


def positioned(df: DataFrame, name: str = "_pos") -> DataFrame:
    """With each row's position in the file: increasing over the ordered partitions of a file scan, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def table_csv(spark: SparkSession, path: str, table: TableInfo) -> DataFrame:
    """A table's CSV with the types of its DDL; '' is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    given = {c.lower(): c for c in raw.columns}
    return raw.select(*[F.nullif(F.col(f"`{given[n.lower()]}`"), F.lit("")).try_cast(spark_type(k)).alias(n.lower()) for n, k in table.columns if n.lower() in given])


def text_file(path: str) -> str:
    """A small file's text, from whatever storage the session reads; of a folder, as Spark writes one, its parts in order."""
    spark = SparkSession.active()
    return "\n".join(r.value.rstrip("\n") for r in spark.read.text(path, wholetext=True).withColumn("f", F.col("_metadata.file_path")).orderBy("f").collect() if r.value.strip())


def write_text(path: str, text: str) -> None:
    """A small file, on whatever storage the session writes to."""
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def header(path: str) -> list[str]:
    first = SparkSession.active().read.text(path).limit(1).collect()
    return next(csv.reader([r.value for r in first]), [])


def ddl_csv(path: str, database: str = "") -> SchemaInfo:
    """A package's DDL.csv (table_name, description, DDL)."""
    rows = list(csv.DictReader(io.StringIO(text_file(path), newline="")))
    schema = parse_script(";\n".join(r.get("DDL") or r.get("ddl") or "" for r in rows), database)
    notes = {(r.get("table_name") or "").lower(): r.get("description") or "" for r in rows}
    for t in schema.tables.values():
        t.description = notes.get(t.name.lower(), "")
    return schema


def _yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(text_file(path)) or {}


def star_config(path: str) -> StarSpec:
    return StarSpec.from_config(_yaml(path))


def _configured(config: dict) -> dict[str, dict]:
    """Dimension and fact tables by name in upper case; a list of tables with names counts as a mapping."""
    found = {}
    for part in ("dimension_tables", "fact_tables"):
        tables = config.get(part) or {}
        found |= {n.upper(): t or {} for n, t in (tables.items() if isinstance(tables, dict) else ((t["name"], t) for t in tables))}
    return found


def key_contract(path: str) -> tuple[dict[str, str], list[tuple[str, str, str, str]]]:
    """Each table's key column, and (table, column, referenced table, referenced column) of each reference, all in upper case.

    A table without a key column has TABLE_ID; a reference without a column takes the referenced table's key, else its own column's name.
    """
    tables = _configured(_yaml(path))
    keys = {n: (t.get("key_column") or f"{n}_ID").upper() for n, t in tables.items()}
    links = []
    for name, t in tables.items():
        for fk in t.get("foreign_keys") or ():
            if (column := fk.get("column")) and (to := fk.get("references")):
                links.append((name, column.upper(), to.upper(), (fk.get("references_column") or keys.get(to.upper()) or column).upper()))
    return keys, links


def schema_config(path: str, database: str = "") -> SchemaInfo:
    """Tables, columns, keys and references of a YAML schema; types come from the column's own `type`, else from its name."""
    from starloom.operators.profile import infer_from_name, key_type

    config = _yaml(path)
    keys, links = key_contract(path)
    out = SchemaInfo(database or str(config.get("database") or ""))
    notes = {k.upper(): v for k, v in (config.get("table_descriptions") or {}).items()}
    for name, t in _configured(config).items():
        columns = {keys[name]: key_type(keys[name])} | {c.upper(): key_type(c.upper()) for n, c, _, _ in links if n == name}
        for c in [*(t.get("columns") or ()), *(t.get("derived_columns") or ())]:
            target = c["target_name"]
            columns.setdefault(target if target.upper() not in columns else target.upper(), c.get("type") or infer_from_name(target))
        out.tables[name] = TableInfo(name, list(columns.items()), [keys[name]], [(c, r, rc) for n, c, r, rc in links if n == name], notes.get(name, t.get("description") or ""))
    return out


def table_samples(spark: SparkSession, path: str) -> DataFrame:
    """The rows of sample files, each one JSON list or an object with `sample_rows`, with the table's name from the file's."""
    raw = spark.read.text(path, wholetext=True).withColumn("table_name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    listed = F.coalesce(F.get_json_object("value", "$.sample_rows"), F.when(F.ltrim("value").startswith("["), F.col("value")))
    return raw.select("table_name", F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("place", "cells"))


def tasks(spark: SparkSession, path: str, schema: str = TASK) -> DataFrame:
    """JSON lines, or one JSON list; `sql` is the gold statement wherever `gold_sql` is missing."""
    one_list = path.endswith(".json")
    df = spark.read.schema(schema).json(path, multiLine=one_list)
    return df.withColumn("gold_sql", F.coalesce("gold_sql", "sql")) if {"gold_sql", "sql"} <= set(df.columns) else df


def evaluation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows of all files below a folder, with database, model, language and time stamp from the path; few-shot and raw files are left out."""
    df = spark.read.schema(EVALUATION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*evaluated.jsonl").json(folder)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    return df.withColumns(path_parts(F.col("path"))).withColumn("gold_sql", F.coalesce("gold_sql", "sql")).filter(~F.lower(F.element_at(F.split("path", "/"), -2)).rlike("fewshot|raw"))


def evidence_map(df: DataFrame, order: str) -> DataFrame:
    """(pair_id, evidence): the last one given wins."""
    return df.groupBy("pair_id").agg(F.max_by("evidence", order).alias("evidence"))


def query_files(folder: str) -> list[dict]:
    """The .sql files of a folder: name, sql, complexity, category."""
    out = []
    files = SparkSession.active().read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.sql$", 1).alias("name"))
    for file in files.orderBy("name").collect():
        sql, meta = strip_comment_lines(file["value"])
        out.append({"name": file["name"], "sql": sql, "complexity": meta.get("complexity", ""), "category": meta.get("category", "")})
    return out


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; null and '' are both empty cells. `single` is for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quote='"', escape='"')


def write_json_lines(df: DataFrame, path: str, without: tuple[str, ...] = (), metadata: dict | None = None) -> None:
    """One object a row, without the `without` columns; `metadata`, if given, goes into one more object at PATH.metadata."""
    df.drop(*without).write.mode("overwrite").json(path)
    if metadata is not None:
        df.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".metadata")


def append_results(df: DataFrame, path: str, first: bool = False) -> None:
    """Results added to the JSON lines that are there; the first ones of a run replace them."""
    df.write.mode("overwrite" if first else "append").json(path)


def append_table(df: DataFrame, table: str, most: int | None = None) -> int:
    """Rows, the first `most` if given, added to a table, '' as null and each column in the table's type (an error aborts, nothing is added); returns their number."""
    target = df.sparkSession.table(table)
    given = {c.lower(): c for c in df.columns}
    unknown = set(given) - {c.lower() for c in target.columns}
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
    cells = []
    for f in target.schema:
        c = F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)
        text = f.name.lower() in given and isinstance(df.schema[given[f.name.lower()]].dataType, T.StringType)
        cells.append((F.nullif(c, F.lit("")) if text else c).cast(f.dataType).alias(f.name))
    rows = df if most is None else df.limit(most)
    before = target.count()
    rows.select(*cells).write.mode("append").saveAsTable(table)
    return df.sparkSession.table(table).count() - before


def truncate(spark: SparkSession, table: str) -> str | None:
    """Empties a table; what went wrong is returned as a warning, and the caller goes on."""
    try:
        spark.sql(f"TRUNCATE TABLE {table}")
    except Exception as error:  # noqa: BLE001 - the warning is the result
        return str(error).splitlines()[0]
    return None


def sample_json(df: DataFrame, path: str, key: list[str], rows: int = 5) -> None:
    """The first rows by key, as one JSON list."""
    write_text(path, json.dumps([r.asDict() for r in df.orderBy(*key).limit(rows).collect()], indent=2, default=str, ensure_ascii=False))


def whole_number(v):
    """3.0 as 3, everything else as it is."""
    return int(v) if isinstance(v, float) and v == int(v) else v


def table_sample(df: DataFrame, name: str, path: str | None = None, description: str = "", rows: int = 3) -> dict:
    """Name, columns, simple types and a few rows of a table, for prompts; types come from the first 100 rows."""
    from starloom.operators.profile import simple_types

    head = df.limit(100)
    kinds = simple_types(head)
    shown = [{k: whole_number(v) for k, v in r.asDict().items()} for r in head.limit(rows).collect()]
    out = {"table_name": name, "table_fullname": name, "column_names": df.columns, "column_types": [kinds[c] for c in df.columns], "description": [description] * len(df.columns), "sample_rows": shown}
    if path:
        write_text(path, json.dumps(out, indent=2, default=str, ensure_ascii=False))
    return out


def write_ddl_csv(schema: SchemaInfo, path: str) -> None:
    """One file with name, description and definition of each table, at `path` on whatever storage the session writes to."""
    from starloom.catalog import create_table

    text = io.StringIO(newline="")
    out = csv.writer(text)
    out.writerow(["table_name", "description", "DDL"])
    for t in schema.tables.values():
        out.writerow([t.name, t.description, create_table(t)])
    write_text(path, text.getvalue())


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than `most` rows are an error, as nothing is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]])
