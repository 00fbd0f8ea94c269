"""A small command line: `python -m starloom.cli DIR` opens a prompt over a folder of parquet tables."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from starloom.query import run_sql
from starloom.session import get_session


def register_folder(spark: SparkSession, folder: str) -> list[str]:
    names = sorted(p.stem for p in Path(folder).glob("*.parquet"))
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names


def answer(spark: SparkSession, line: str, rows: int = 20) -> str:
    """The text of one command: databases or schemas, tables, use NAME, or a statement."""
    word, _, rest = line.strip().rstrip(";").partition(" ")
    if word in ("databases", "schemas"):
        return "\n".join(d.name for d in spark.catalog.listDatabases())
    if word == "tables":
        return "\n".join(t.name for t in spark.catalog.listTables())
    if word == "use":
        spark.catalog.setCurrentDatabase(rest.strip().lower())
        return f"using {rest.strip().lower()}"
    try:
        return run_sql(spark, line)._show_string(rows, 40)
    except Exception as error:  # noqa: BLE001 - shown to the user
        return f"error: {str(error).splitlines()[0]}"


def main() -> None:
    spark = get_session()
    print("tables:", ", ".join(register_folder(spark, sys.argv[1] if len(sys.argv) > 1 else ".")))
    for line in sys.stdin:
        if line.strip() in ("exit", "quit", "\\q"):
            break
        if line.strip():
            print(answer(spark, line))


if __name__ == "__main__":
    main()
