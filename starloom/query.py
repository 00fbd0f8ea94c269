"""Running query sets: results to files, validation, timing, reports."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.dialect import statements, to_spark
from starloom.match import with_timeout

SHAPE = "name string, complexity string, category string, success boolean, rows bigint, columns int, seconds double, error string"


@dataclass
class Run:
    name: str
    complexity: str
    category: str
    success: bool
    rows: int | None
    columns: int | None
    seconds: float
    error: str | None


def run_sql(spark: SparkSession, sql: str, one: bool = False) -> DataFrame:
    df = spark.sql(to_spark(sql))
    return df.limit(1) if one else df


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    return [run_sql(spark, s) for s in statements(script)]


def executable(spark: SparkSession, sql: str, seconds: float = 20.0) -> tuple[bool, str | None]:
    """Whether the statement runs within the time and returns a row."""
    try:
        found = with_timeout(spark, seconds, lambda: not run_sql(spark, sql).isEmpty())
        return found, None if found else "no rows"
    except Exception as error:  # noqa: BLE001 - the message is the result
        return False, str(error).splitlines()[0]


def validate(spark: SparkSession, queries: list[dict], save_to: str | None = None, seconds: float = 600.0) -> list[Run]:
    """Runs each query ({name, sql, complexity, category}) by itself; one failing leaves the others alone. Results go to CSV folders if asked for."""
    out = []
    for q in queries:
        began, rows, columns, error = time.time(), None, None, None
        try:
            df = run_sql(spark, q["sql"])
            columns = len(df.columns)
            if save_to:  # run once: the rows are counted in the file
                path = f"{save_to}/{q['name']}"
                with_timeout(spark, seconds, lambda df=df, path=path: df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quote='"', escape='"'))
                rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').count()
            else:
                rows = with_timeout(spark, seconds, df.count)
        except Exception as e:  # noqa: BLE001
            error = str(e).splitlines()[0]
        out.append(Run(q["name"], q.get("complexity", ""), q.get("category", ""), error is None, rows, columns, time.time() - began, error))
    return out


def save_result(spark: SparkSession, sql: str, path: str) -> tuple[bool, int]:
    """A statement's result as CSV with a header; a statement without rows leaves one `message` row, a failing one an `error` row. Returns success and rows."""
    from starloom.sources.tables import write_csv

    try:
        df = run_sql(spark, sql)
        if df.columns:
            write_csv(df, path)
            return True, spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').count()
        out, done = spark.createDataFrame([("done",)], "message string"), True
    except Exception as error:  # noqa: BLE001 - the row is the result
        out, done = spark.createDataFrame([(str(error).splitlines()[0],)], "error string"), False
    write_csv(out, path, single=True)
    return done, 0


def report(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """Per complexity: queries, successes, failures, least, mean and largest time."""
    df = spark.createDataFrame([tuple(asdict(r).values()) for r in runs], SHAPE)
    return df.groupBy("complexity").agg(F.count("*").alias("queries"), F.sum(F.col("success").cast("long")).alias("passed"), F.sum((~F.col("success")).cast("long")).alias("failed"), F.min("seconds").alias("min_s"), F.avg("seconds").alias("avg_s"), F.max("seconds").alias("max_s"))
