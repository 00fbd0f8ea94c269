"""Session settings shared by the command line, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every starloom session wants. ANSI mode gives errors for overflow and division by zero.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "starloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with DEFAULTS; `extra` uses double underscores for dots (spark__ui__enabled='false')."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """The parquet table `name` of the data directory, single file or folder alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
