"""Broadcasts only of sides whose size has been checked, in rows and in bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A broadcast side is held by every executor and built on the driver.
MOST_BYTES = 64 << 20


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(32).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(16))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _bytes(F.map_values(c), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = 100_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (counted, never more than rows + 1 of them) of `most_bytes` in all, else as it is."""
    size = reduce(lambda a, b: a + b, (_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and found["b"] <= most_bytes else df


def in_parts(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as the cluster has cores: a small file, read in one piece, is dealt out; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """`df` hashed by `keys` into a fixed number of partitions, for Python work after an aggregation by these keys.

    Adaptive execution would merge them by their bytes, of which heavy Python work has few; the aggregation needs no shuffle of its own.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
