"""Cutoffs that keep a target fraction of each source, best scores first.

Rows are range-sorted by source and score. Each partition counts its rows per source, a prefix sum over those few counts tells which
partition holds a source's target row, and only there the exact row is read. A source of any size is spread over as many partitions as
it needs; only counts, one per partition and source, meet in one place.

Defined results: null and NaN scores are left out of every count; the target row is number ceil(fraction * n) in descending order
(none for fraction 0 or less: cutoff null, 0 kept); all rows that tie with the cutoff are kept, so `kept` may exceed the target;
fraction 1 or more keeps all; a source of the targets without scored rows gets n = 0, kept = 0 and a null cutoff and fraction;
sources without a target, or with a null name, are left out; -0.0 equals 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.sizes import broadcast_if_small
from starloom.lineage import cut


def cutoffs(df: DataFrame, source: str, score: str, targets: DataFrame, target_source: str, target_fraction: str) -> DataFrame:
    """(`source`, `target_fraction`, `scored`, `cutoff`, `kept`, `actual_fraction`) for each row of `targets`."""
    goals = targets.select(F.col(target_source).alias("source"), F.col(target_fraction).cast("double").alias("target_fraction")).filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_fraction").alias("target_fraction"))
    rows = df.select(F.col(source).alias("source"), (F.col(score).cast("double") + 0.0).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.join(goals.select("source"), "source", "left_semi")
    # equal scores of a source fall into one partition with a plain range on (source, score); the third key spreads them
    ranged = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(F.col("source"), F.col("score").desc(), F.col("spread"))
    ranged = cut(ranged.sortWithinPartitions(F.col("source"), F.col("score").desc()).select("source", "score", F.spark_partition_id().alias("part")))
    counts = ranged.groupBy("part", "source").agg(F.count("*").alias("here"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("source").agg(F.sum("here").alias("scored"))
    placed = counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).join(whole, "source").join(goals, "source")
    # a tiny allowance keeps 0.8 * 5 at row 4 in spite of binary fractions
    wanted = F.least(F.col("scored"), F.ceil(F.col("target_fraction") * F.col("scored") - 1e-9))
    target = placed.withColumn("wanted", wanted).filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("here")))
    target = target.select("source", "part", (F.col("wanted") - F.col("before")).alias("nth"))
    # row numbers run over the target partitions' rows alone; a partition is one task's rows already
    inside = ranged.join(broadcast_if_small(target), ["source", "part"]).withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy(F.col("score").desc())))
    exact = inside.filter("rank = nth").select("source", F.col("score").alias("cutoff"))
    exact = cut(exact)
    # ties with the cutoff may run on into later partitions
    kept = ranged.join(broadcast_if_small(exact), "source").filter("score >= cutoff").groupBy("source").agg(F.count("*").alias("kept"))
    out = goals.join(whole, "source", "left").join(exact, "source", "left").join(kept, "source", "left")
    n, k = F.coalesce("scored", F.lit(0)), F.coalesce("kept", F.lit(0))
    return out.select("source", "target_fraction", n.alias("scored"), "cutoff", k.alias("kept"), F.when(n > 0, k / n).alias("actual_fraction"))


def kept_rows(df: DataFrame, source: str, score: str, chosen: DataFrame) -> DataFrame:
    """The rows of `df` at or above their source's cutoff (`chosen` is the result of `cutoffs`)."""
    limits = broadcast_if_small(chosen.filter(F.col("cutoff").isNotNull()).select(F.col("source").alias("_source"), F.col("cutoff").alias("_cutoff")))
    value = F.col(score).cast("double")
    return df.join(limits, (F.col(source) == F.col("_source")) & ~F.isnan(value) & (value >= F.col("_cutoff"))).drop("_source", "_cutoff")
