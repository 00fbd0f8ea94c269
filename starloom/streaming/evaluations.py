"""Evaluation files as a stream: rows are appended once each, metric tables are kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.functions.transforms import path_parts
from starloom.sources.tables import EVALUATION


def evaluation_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New evaluated files below a folder, with database, model and language from their paths."""
    df = spark.readStream.schema(EVALUATION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*evaluated.jsonl").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return df.withColumn("path", F.col("_metadata.file_path")).withColumns(path_parts(F.col("path")))


def running_metrics(stream: DataFrame, by: list[str]) -> DataFrame:
    """Rows and means of both matches so far, for complete or update mode."""
    return stream.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("em").alias("em_mean"), F.avg("ex").alias("ex_mean"))


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all rows that are there to a parquet folder, then stops; run again, it goes on with new files."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; rows later than the watermark allows are left out. Works on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
