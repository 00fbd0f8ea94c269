"""Neighbours in order, without one task per group.

A window over a whole group sorts that group in one task. Here a group's rows get dense positions from per-block counts, are cut
into chunks of fixed length, and each chunk receives the few rows before and after it. Windows then run over (group, chunk),
whose size is bounded however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.lineage import cut


def with_positions(df: DataFrame, group: str, order: list[str], block: list[Column], out: str = "_pos") -> DataFrame:
    """Dense 0-based positions within `group` in the order of `order`.

    `block` are columns that are monotone in the order and split a group into pieces of bounded size (say year and
    sequence number div 4096). Only the block counts are summed along a group, rows never meet in one task.
    """
    names = [f"_b{i}" for i in range(len(block))]
    df = df.withColumns(dict(zip(names, block)))
    counts = df.groupBy(group, *names).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_og"), *[F.col(n).alias("_o" + n) for n in names], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(group, *names).orderBy(*order)) - 1
    same = F.col(group).eqNullSafe(F.col("_og"))
    for n in names:
        same &= F.col(n).eqNullSafe(F.col("_o" + n))
    return df.withColumn("_in", inside).join(offsets, same, "left").withColumn(out, F.col("_off") + F.col("_in")).drop(*names, "_og", *["_o" + n for n in names], "_off", "_in")


def exact_quantiles(rows: DataFrame, group: str, value: str, share: float, out: str) -> DataFrame:
    """(`group`, `n`, `out`): rows and the `share` quantile, linear between neighbours (0.5: the mean of the lower and upper median).

    From counts per group and value and prefix sums over range partitions, so exact at any size: a group is as many tasks' as it needs. Nulls are left out.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(group, "_x").sortWithinPartitions(group, "_x").withColumn("_part", F.spark_partition_id()))
    per = ranged.groupBy("_part", group).agg(F.sum("_c").alias("_here"))  # one row a partition and group
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.select("_part", F.col(group).alias("_g"), F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(Window.partitionBy(group)).alias("n"))
    upto = ranged.withColumnRenamed("_part", "_at").withColumn("_in", F.sum("_c").over(Window.partitionBy("_at", group).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.join(placed, (F.col("_at") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("_upto", F.col("_before") + F.col("_in"))
    place = (F.col("n") - 1) * F.lit(float(share))
    found = upto.groupBy(group).agg(F.first("n").alias("n"), F.min(F.when(F.col("_upto") >= F.floor(place) + 1, F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_upto") >= F.ceil(place) + 1, F.col("_x"))).alias("_hi"))
    part = place - F.floor(place)
    return found.select(group, "n", (F.col("_lo") + part * (F.col("_hi") - F.col("_lo")) if share != 0.5 else (F.when(part > 0, F.col("_lo") + F.col("_hi")).otherwise(2 * F.col("_lo")) / 2)).alias(out))


def with_halo(df: DataFrame, pos: str = "_pos", size: int = 4096, halo: int = 4) -> DataFrame:
    """Rows with `_chunk` and `_own`; rows within `halo` of a border appear in the neighbouring chunk too, with `_own` false."""
    at = (F.col(pos) / F.lit(size)).cast("long")
    inside = F.col(pos) - at * size
    home = F.struct(at.alias("c"), F.lit(True).alias("own"))
    left = F.when((inside < halo) & (at > 0), F.struct((at - 1).alias("c"), F.lit(False).alias("own")))
    right = F.when(inside >= size - halo, F.struct((at + 1).alias("c"), F.lit(False).alias("own")))
    spread = F.filter(F.array(home, left, right), lambda x: x.isNotNull())
    return df.withColumn("_h", F.explode(spread)).withColumns({"_chunk": F.col("_h.c"), "_own": F.col("_h.own")}).drop("_h")
