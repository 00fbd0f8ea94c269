"""Metric roll-ups, latest picks and joins of evaluation rows, and the statistics of translation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.ordered import exact_quantiles


def summarize_files(rows: DataFrame, by: list[str], new_em: str = "em_new") -> DataFrame:
    """Per file: rows, means of the old and new exact match and of the execution match, and how many exact matches changed."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("em").alias("em_old_mean"), F.avg(new_em).alias("em_new_mean"), F.avg("ex").alias("ex_mean"), F.coalesce(F.sum((F.col("em") != F.col(new_em)).cast("long")), F.lit(0)).alias("em_changed_rows"))


def macro_micro(files: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Macro: mean of the files' means. Micro: mean weighted by rows."""
    weighted = [(F.sum(F.col(m) * F.col("rows")) / F.sum(F.when(F.col(m).isNotNull(), F.col("rows")))).alias(f"micro_{m}") for m in measures]
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), *[F.avg(m).alias(f"macro_{m}") for m in measures], *weighted)


def counts_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """'hits/total' of both matches."""
    hit = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return rows.groupBy(*by).agg(*[F.concat(hit(c).cast("string"), F.lit("/"), F.count("*").cast("string")).alias(c) for c in ("em", "ex")])


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest `order` values (nulls last); partial aggregation, no sort of a whole key."""
    names = df.columns
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n keys in the order of a seeded hash: the same ones wherever the key occurs."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def source_with_translation(source: DataFrame, translated: DataFrame, key: list[str]) -> DataFrame:
    return source.join(translated, key)


def with_evidence(df: DataFrame, evidence: DataFrame, key: str, required: bool = False) -> DataFrame:
    """Rows with the `evidence` of their key, null if there is none or it is unusable; with `required`, only rows that have one."""
    from starloom.operators.retrieval import usable_evidence

    known = evidence.filter(usable_evidence(F.col("evidence"))).select(F.col(key).alias("_k"), "evidence")
    return df.join(known, F.col(key) == F.col("_k"), "inner" if required else "left").drop("_k")


def zip_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of equal position; positions are dense numbers of each side's order."""
    from starloom.operators.normalize import dense_numbers

    return dense_numbers(a, [order_a], "_z").join(dense_numbers(b, [order_b], "_z"), "_z").drop("_z")


def usable(df: DataFrame, lang: str = "lang", score: str = "comet_score") -> DataFrame:
    """Rows with a score and a known language."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(lang).isNotNull() & (F.lower(lang) != "unknown"))


def percentile_audit(df: DataFrame, lang: str, score: str, share: float = 0.2) -> DataFrame:
    """Per language: n, mean, population deviation and the `share` quantile tau (linear between neighbours; exact, and no task holds a language's scores)."""
    per = df.groupBy(lang).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    taus = exact_quantiles(df, lang, score, share, "tau").select(F.col(lang).alias("_l"), "tau")
    return per.join(taus, F.col(lang).eqNullSafe(F.col("_l")), "left").drop("_l")


def flagged(df: DataFrame, audit: DataFrame, lang: str, score: str) -> DataFrame:
    """Rows at or below their language's tau."""
    limits = audit.select(F.col(lang).alias("_l"), "tau")
    return df.join(limits, (F.col(lang) == F.col("_l")) & (F.col(score) <= F.col("tau"))).drop("_l")


def histogram(df: DataFrame, score: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """(bin, n) over equal widths; the last bin includes `high`, bin -1 counts the scores below `low` and bin `bins` those above `high`."""
    inside = F.least(F.floor((F.col(score) - low) / ((high - low) / bins)), F.lit(bins - 1))
    b = F.when(F.col(score) < low, F.lit(-1)).when(F.col(score) > high, F.lit(bins)).otherwise(inside).cast("int")
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def sensitivity(df: DataFrame, score: str, first: float = 0.5, step: float = 0.05, steps: int = 31) -> DataFrame:
    """For k = 0.5 .. 2.0: tau = mean - k * deviation, how many scores lie at or below it, and their rate.

    All thresholds are counted in one pass of conditional sums; the grid meets only the one row of totals.
    """
    stats = df.agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sd"))
    ks = [round(first + i * step, 10) for i in range(steps)]
    joined = df.crossJoin(F.broadcast(stats))  # one row
    sums = [F.sum((F.col(score) <= F.col("mu") - F.lit(k) * F.col("sd")).cast("long")).alias(f"f{i}") for i, k in enumerate(ks)]
    one = joined.agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"), F.count("*").alias("n"), *sums)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("flagged")) for i, k in enumerate(ks)]))
    return one.select("mu", "sd", "n", grid.alias("g")).select("g.k", (F.col("mu") - F.col("g.k") * F.col("sd")).alias("tau"), "g.flagged", F.when(F.col("n") > 0, F.col("g.flagged") / F.col("n")).alias("rate"))


def knee(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The curve's point farthest from the chord between its ends, on 0-1 scales; the first of equals. Curves are grids, a few dozen rows."""
    w = Window.partitionBy()
    scaled = curve.withColumns({"_x0": F.min(x).over(w), "_x1": F.max(x).over(w), "_y0": F.min(y).over(w), "_y1": F.max(y).over(w)})
    unit = lambda c, a, b: F.when(F.col(b) > F.col(a), (F.col(c) - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    scaled = scaled.withColumns({"_u": unit(x, "_x0", "_x1"), "_v": unit(y, "_y0", "_y1")})
    ends = scaled.agg(F.min_by(F.struct("_u", "_v"), x).alias("a"), F.max_by(F.struct("_u", "_v"), x).alias("b"))
    du, dv = F.col("b._u") - F.col("a._u"), F.col("b._v") - F.col("a._v")
    length = F.sqrt(du * du + dv * dv)
    far = F.when(length > 0, F.abs(dv * (F.col("_u") - F.col("a._u")) - du * (F.col("_v") - F.col("a._v"))) / length).otherwise(0.0)
    return scaled.crossJoin(F.broadcast(ends)).withColumn("distance", far).orderBy(F.desc(F.round("distance", 12)), x).limit(1).select(x, y, "distance")


def rates_at(df: DataFrame, lang: str, score: str, taus: dict[str, float]) -> DataFrame:
    """Per language: the share of scores at or below each named threshold."""
    return df.groupBy(lang).agg(F.count("*").alias("n"), *[F.avg((F.col(score) <= t).cast("double")).alias(name) for name, t in taus.items()])


def pair_quality(pairs: DataFrame, score: str, valid: str, question: str) -> DataFrame:
    """One row: pairs, valid ones, validity rate, mean, least and largest positive score, pairs per question."""
    positive = F.when(F.col(score) > 0, F.col(score))
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col(valid).cast("long")), F.lit(0)).alias("valid"), F.avg(F.col(valid).cast("double")).alias("validity_rate"), F.avg(positive).alias("mean_score"), F.min(positive).alias("min_score"), F.max(positive).alias("max_score"), (F.count("*") / F.nullif(F.count_distinct(question), F.lit(0))).alias("pairs_per_question"))
