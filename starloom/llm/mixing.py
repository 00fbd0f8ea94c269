"""Mixing sources to target weights: hierarchical budgets over a weight tree, token prefixes of seeded epochs per leaf.

The tree's levels are columns (say domain, language, source, in any order); a node's weight is divided among its children, by given
weights on the level that has them and by available tokens elsewhere. A child that cannot use its part (its tokens times its
repeats) leaves the rest to its siblings, in proportion to their weights, and only what no sibling can use goes up to the ancestors.
Going down from the root, each node's budget is filled like water: its children, in the order of room by weight, get their room up to
the first one that a common level of the rest doesn't reach. A level of the tree is one window over its nodes, whatever their number.
Every leaf then takes whole epochs and a prefix of one more epoch, whose order is a seeded hash, so a larger budget extends a smaller one. The record that
crosses the end of a prefix is taken if most of it lies inside, so a leaf misses its budget by half a record at most.

Defined results: texts without tokens (null, empty) are never taken; sources without a target are left out; a
null source has no target; a null name on another level is a node of its own; a target without rows gets nothing and its weight goes to
its siblings if a budget is given, while the default budget is the largest that meets every target which has rows; record ids must be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.sizes import broadcast_if_small
from starloom.lineage import cut


def _same(levels: list[str], other: str) -> Column:
    """Equal names on all levels, null being a name; the other side's columns begin with `other`."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(other + x)) for x in levels))


def _renamed(df: DataFrame, levels: list[str], other: str) -> DataFrame:
    return df.withColumnsRenamed({x: other + x for x in levels})


def sized_rows(sized: DataFrame, id_col: str, tokens_col: str, levels: list[str], targets: DataFrame, weighted: str) -> DataFrame:
    """(`id`, levels..., `tokens`, `share`, `most`) of the records that a target names: written once, as counting tokens again would cost more."""
    goals = targets.select(F.col(weighted).alias("_w"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("most"))
    goals = goals.filter("_w is not null and share > 0").groupBy("_w").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    rows = sized.filter(F.col(tokens_col) > 0).select(F.col(id_col).alias("id"), *levels, F.col(tokens_col).cast("long").alias("tokens"))
    return cut(rows.join(broadcast_if_small(goals), F.col(weighted) == F.col("_w")).drop("_w"))


def budgets(rows: DataFrame, levels: list[str], weighted: str, budget: float | None = None, room_share: float | None = None) -> DataFrame:
    """(levels..., `tokens`, `n`, `largest`, `weight`, `room`, `budget`) of each leaf; the budget in all is given, or a share of all room, or the largest that meets every target."""
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max("tokens").alias("largest"), F.first("share").alias("share"), F.first("most").alias("most"))
    names = leaves.groupBy(weighted).agg(F.sum("tokens").alias("_all"), F.first("share").alias("_share"), F.first("most").alias("_most"))
    meets = names.agg((F.min(F.col("_all") * F.col("_most") / F.col("_share")) * F.sum("_share")).alias("b")).first()["b"] or 0.0
    # a leaf's own part of its weighted name's target; nodes above sum their leaves' parts
    leaves = leaves.join(_renamed(names.select(weighted, "_all"), [weighted], "_n_"), F.col(weighted) == F.col("_n_" + weighted)).drop("_n_" + weighted)
    leaves = cut(leaves.withColumn("weight", F.col("share") * F.col("tokens") / F.col("_all")).withColumn("room", (F.col("tokens") * F.col("most")).cast("double")).drop("_all", "share", "most"))
    room = leaves.agg(F.sum("room").alias("r")).first()["r"] or 0.0
    total = min(room, room * room_share if room_share is not None else meets if budget is None else budget)
    parents = None
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("weight").alias("weight"), F.sum("room").alias("room"))
        nodes = nodes.withColumn("has", F.lit(float(total))) if parents is None else nodes.join(_renamed(parents, above, "_p_"), _same(above, "_p_")).drop(*["_p_" + x for x in above])
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ordered = siblings.orderBy(F.col("room") / F.col("weight"), *path)
        spent = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        level = (F.col("has") - spent) / F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") < F.col("room"), F.col("_level"))).over(siblings))
        parents = nodes.select(*path, F.when(F.col("_level").isNull(), F.col("room")).otherwise(F.least("room", F.col("_level") * F.col("weight"))).alias("has"))
    found = _renamed(parents, levels, "_p_").withColumnRenamed("has", "budget")
    return cut(leaves.join(broadcast_if_small(found), _same(levels, "_p_")).drop(*["_p_" + x for x in levels]))


def take(rows: DataFrame, plan: DataFrame, id_col: str, levels: list[str], seed: int = 7, rows_per_bucket: int = 10_000) -> DataFrame:
    """(`id_col`, levels..., `tokens`, `uses`): the records taken and how often. Prefix sums run over hash buckets of about `rows_per_bucket` rows, never over a whole leaf."""
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    epochs = F.floor(whole / F.col("tokens")).cast("int")
    per_leaf = plan.select(*levels, epochs.alias("epochs"), (whole - epochs * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.floor(F.col("n") / rows_per_bucket)).alias("buckets"))
    # the order of epoch e is a hash of (seed, e, id); one number in [0, 1) gives bucket and order
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    joined = rows.select("id", *levels, "tokens").join(broadcast_if_small(_renamed(per_leaf, levels, "_l_")), _same(levels, "_l_")).drop(*["_l_" + x for x in levels])
    ordered = joined.withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    sums = ordered.filter("rest > 0").groupBy(*levels, "bucket").agg(F.sum("tokens").alias("here"))
    before = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).select(*levels, "bucket", "before", "here"))
    keys = [*levels, "bucket"]
    placed = ordered.join(broadcast_if_small(_renamed(sums, keys, "_s_")), _same(keys, "_s_"), "left").drop(*["_s_" + x for x in keys])
    running = F.sum("tokens").over(Window.partitionBy(*levels, "bucket").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.filter("rest > 0 and before < rest and before + here > rest").withColumn("one_more", (2 * (F.col("before") + running) - F.col("tokens") <= 2 * F.col("rest")).cast("int"))
    clear = placed.filter("not (rest > 0 and before < rest and before + here > rest)").withColumn("one_more", F.when((F.col("rest") > 0) & (F.col("before") + F.col("here") <= F.col("rest")), 1).otherwise(0))
    uses = clear.unionByName(inside).withColumn("uses", F.col("epochs") + F.col("one_more"))
    return uses.filter("uses > 0").select(F.col("id").alias(id_col), *levels, "tokens", "uses")


def mix(sized: DataFrame, id_col: str, tokens_col: str, levels: list[str], targets: DataFrame, weighted: str, budget: float | None = None, seed: int = 7, rows_per_bucket: int = 10_000) -> DataFrame:
    """The records taken. `targets` has columns `weighted`, `target_share` and `max_repeats`; only totals reach the driver."""
    rows = sized_rows(sized, id_col, tokens_col, levels, targets, weighted)
    return take(rows, budgets(rows, levels, weighted, budget), id_col, levels, seed, rows_per_bucket)


def report(mixed: DataFrame, targets: DataFrame, weighted: str) -> DataFrame:
    """Per target: target and actual share, tokens, records, uses, the largest number of uses and the permitted one."""
    per = mixed.groupBy(weighted).agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    whole = per.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.select(weighted, "target_share", "max_repeats").join(per, weighted, "left").crossJoin(F.broadcast(whole))  # one row
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "records", "uses", "most_uses")}
    return out.withColumns(zero).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens"))).drop("all_tokens")
