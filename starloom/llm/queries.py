"""Registered queries of the subpackage and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.sizes import broadcast_if_small, by_key
from starloom.functions.transforms import strip
from starloom.llm import answers, cutoffs, languages, mixing, quantiles, skeleton, tokens, truncation
from starloom.session import read_table

FRACTIONS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks once per id (the first delivery), with the language that `lang` names; a label form not listed names none."""
    tasks = read_table(spark, sf_dir, "task_records").select("task_id", "created_at", "question", strip(F.col("lang")).alias("label_form"))
    labels = read_table(spark, sf_dir, "language_labels").groupBy("label_form").agg(F.min("language").alias("given"))
    once = by_key(tasks.filter(F.col("task_id").isNotNull()), "task_id").groupBy("task_id").agg(F.min(F.struct("created_at", "question", "label_form")).alias("t"))
    return once.select("task_id", "t.question", "t.label_form").join(labels, "label_form", "left")


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = _first_tasks(spark, sf_dir)
    samples = languages.collect_samples(read_table(spark, sf_dir, "language_samples"), "language", "sample_text")
    samples = languages.learn(tasks, "task_id", "question", "given", samples)
    return tasks, languages.identify(tasks, "task_id", "question", samples).withColumnRenamed("id", "task_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of mixed-language questions, and questions in one language whose label is missing, unknown or wrong."""
    tasks, segments = _segments(spark, sf_dir)
    rows = segments.join(tasks.select("task_id", "given"), "task_id")
    return rows.filter((F.col("segments") > 1) | F.col("given").isNull() | (F.col("given") != F.col("language"))).select("task_id", "segment_no", "language")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's segments with language and confidence."""
    return _segments(spark, sf_dir)[1].drop("segment")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers with their type of defect."""
    records = read_table(spark, sf_dir, "evaluation_records")
    samples = languages.collect_samples(read_table(spark, sf_dir, "language_samples"), "language", "sample_text")
    samples = answers.learn(records, "lang", "question", "raw_output", "predicted_sql", samples)
    found = answers.judge(records, "eval_id", "question", "raw_output", "predicted_sql", "run_at", samples, read_table(spark, sf_dir, "schema_columns"))
    return found.select(F.col("id").alias("eval_id"), "defect")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers by model and defect."""
    records = read_table(spark, sf_dir, "evaluation_records").groupBy("eval_id").agg(F.min("model").alias("model"))
    return p3_found(spark, sf_dir).join(records, "eval_id").groupBy("model", "defect").agg(F.count("*").alias("answers"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sketches by dimension (lang, db), group and day of scoring."""
    scores = read_table(spark, sf_dir, "translation_scores").select("lang", "db", "comet_score", F.to_date("scored_at").alias("day"))
    sides = F.explode(F.array(F.struct(F.lit("lang").alias("dim"), F.col("lang").alias("grp")), F.struct(F.lit("db").alias("dim"), F.col("db").alias("grp"))))
    rows = scores.select("day", "comet_score", sides.alias("side"))
    return quantiles.sketches(rows, {"dim": F.col("side.dim"), "grp": F.col("side.grp"), "day": F.col("day")}, F.col("comet_score"))


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and the sketch itself per lang and per db and day: what later combinations need instead of rows."""
    whole = quantiles.merged(_daily(spark, sf_dir), ["dim", "grp", "day"])
    return quantiles.percentiles(whole.withColumn("kept", F.col("sketch")), FRACTIONS).withColumnRenamed("kept", "sketch")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the score per lang and per db, from daily sketches merged over the days."""
    return quantiles.percentiles(quantiles.merged(_daily(spark, sf_dir), ["dim", "grp"]), FRACTIONS)


def p4_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per month, from the daily sketches."""
    days = _daily(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    return quantiles.percentiles(quantiles.merged(days, ["dim", "grp", "month"]), [0.5, 0.95])


def p4_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group and fraction: whether the answer's true rank is within the stated bound; the rows are counted exactly."""
    answers = p4_percentiles(spark, sf_dir)
    names = [f"p{100 * q:g}" for q in FRACTIONS]
    long = answers.select("dim", "grp", "n", "rank_error", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("x")) for q, c in zip(FRACTIONS, names)])).alias("a")).select("dim", "grp", "n", "rank_error", "a.*")
    scores = read_table(spark, sf_dir, "translation_scores").filter(F.col("comet_score").isNotNull() & ~F.isnan("comet_score"))
    sides = F.explode(F.array(F.struct(F.lit("lang").alias("dim"), F.col("lang").alias("grp")), F.struct(F.lit("db").alias("dim"), F.col("db").alias("grp"))))
    exact = scores.select(F.col("comet_score").alias("v"), sides.alias("s")).groupBy("s.dim", "s.grp", "v").agg(F.count("*").alias("c"))
    near = exact.join(broadcast_if_small(long.withColumnsRenamed({"dim": "d", "grp": "g"})), (F.col("dim") == F.col("d")) & F.col("grp").eqNullSafe(F.col("g")))
    ranks = near.groupBy("d", "g", "q", "n", "rank_error").agg(F.sum(F.when(F.col("v") < F.col("x"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("x"), F.col("c")).otherwise(0)).alias("upto"))
    slack = F.col("rank_error") * F.col("n") + 1
    return ranks.select(F.col("d").alias("dim"), F.col("g").alias("grp"), "q", "n", ((F.col("below") - slack <= F.col("q") * F.col("n")) & (F.col("upto") + slack >= F.col("q") * F.col("n"))).alias("within"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tasks whose questions differ as strings but look the same."""
    pairs = skeleton.look_alike_pairs(read_table(spark, sf_dir, "task_records"), "task_id", "question")
    return pairs.select(F.col("id_a").alias("task_id_a"), F.col("id_b").alias("task_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose question looks like another one, with their class, its different texts and its tasks."""
    found = skeleton.look_alikes(read_table(spark, sf_dir, "task_records"), "task_id", "question")
    return found.groupBy(F.col("id").alias("task_id"), "class_id", "texts", "members").agg(F.count("*").alias("own_texts"))


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's question in its one consistent form, and whether it was changed."""
    tasks = skeleton.one_form(read_table(spark, sf_dir, "task_records"), "task_id", "question")
    return tasks.withColumn("changed", ~F.col("question").eqNullSafe(F.col("consistent")))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows at or above their lang's cutoff, ties included."""
    scores = read_table(spark, sf_dir, "translation_scores")
    chosen = cutoffs.cutoffs(scores, "lang", "comet_score", read_table(spark, sf_dir, "keep_targets"), "lang", "target_fraction")
    return cutoffs.kept_rows(scores, "lang", "comet_score", chosen)


def p6_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score cutoff, kept rows and actual fraction per lang of keep_targets."""
    out = cutoffs.cutoffs(read_table(spark, sf_dir, "translation_scores"), "lang", "comet_score", read_table(spark, sf_dir, "keep_targets"), "lang", "target_fraction")
    return out.withColumnRenamed("source", "lang")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode(tokens.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ids")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = tokens.token_counts(read_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"], "text")
    return mixing.mix(sized, "doc_id", "tokens", ["source", "lang"], read_table(spark, sf_dir, "mix_targets"), "source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken for the mixture, with their tokens and number of uses."""
    return _mixed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, tokens and repeats per source."""
    return mixing.report(_mixed(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), "source")


def p8_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of db, lang and source with seven tenths of all that it can give, in characters: each leaf's room and budget, and whether what is taken meets it.

    Many leaves are short at that budget, so their siblings and then other branches give more than their own part.
    """
    levels = ["db", "lang", "source"]
    rows = mixing.sized_rows(read_table(spark, sf_dir, "documents"), "doc_id", "n_chars", levels, read_table(spark, sf_dir, "mix_targets"), "source")
    plan = mixing.budgets(rows, levels, "source", room_share=0.7)
    taken = mixing.take(rows, plan, "doc_id", levels).groupBy(*levels).agg(F.sum(F.col("tokens") * F.col("uses")).alias("taken"))
    both = plan.join(taken.withColumnsRenamed({x: "_t_" + x for x in levels}), mixing._same(levels, "_t_"), "left")
    near = F.abs(F.coalesce("taken", F.lit(0)) - F.col("budget")) <= F.col("largest") / 2 + 1
    return both.select(*levels, F.col("tokens").alias("chars"), F.col("room").cast("long").alias("room"), F.round("budget", 3).alias("budget"), near.alias("met"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off before its end."""
    found = truncation.truncated(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", read_table(spark, sf_dir, "schema_columns"))
    return found.select(F.col("id").alias("doc_id"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    marked = documents.join(p9_found(spark, sf_dir).withColumn("cut", F.lit(1)), "doc_id", "left")
    per = marked.groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated"))
    return per.withColumn("share", F.col("truncated") / F.col("documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_segments, p3_found, p3_report, p4_daily, p4_percentiles, p4_months, p4_bound, p5_found, p5_classes, p5_consistent, p6_kept, p6_cutoffs, p7_ids, p7_round_trip, p8_mix, p8_report, p8_shortage, p9_found, p9_report)}

_SIDES = " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS grp, comet_score AS v, strftime(scored_at, '%Y-%m') AS month FROM translation_scores WHERE comet_score IS NOT NULL AND NOT isnan(comet_score)" for c in ("lang", "db"))

def _percentiles_sql(groups: str, fractions: list[float]) -> str:
    """Exact ones; sketches of groups up to k values, as all of scale 0.01 are, hold every value."""
    names = [f"p{100 * q:g}" for q in fractions]
    found = ", ".join(f"min(CASE WHEN rn >= {q} * n THEN v END) AS {name}" for q, name in zip(fractions, names))
    inner = f"SELECT {groups}, v, row_number() OVER (PARTITION BY {groups} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {groups}) AS n FROM s"
    return f"WITH s AS ({_SIDES}) SELECT {groups}, max(n) AS n, min(v) AS low, max(v) AS high, {found}, 0.0::DOUBLE AS rank_error FROM ({inner}) GROUP BY {groups}"


SQL = {
    "p4_percentiles": _percentiles_sql("dim, grp", FRACTIONS),
    "p4_months": _percentiles_sql("dim, grp, month", [0.5, 0.95]),
    "p4_bound": f"WITH s AS ({_SIDES}), g AS (SELECT dim, grp, count(*) AS n FROM s GROUP BY dim, grp) SELECT dim, grp, q, n, true AS within FROM g, (SELECT unnest([{', '.join(map(str, FRACTIONS))}])::DOUBLE AS q)",
    "p6_cutoffs": """WITH t AS (SELECT lang, max(target_fraction) AS f FROM keep_targets WHERE lang IS NOT NULL GROUP BY lang),
s AS (SELECT x.lang, x.comet_score AS v, t.f, row_number() OVER (PARTITION BY x.lang ORDER BY x.comet_score DESC) AS rn, count(*) OVER (PARTITION BY x.lang) AS n
 FROM translation_scores x JOIN t ON x.lang = t.lang WHERE x.comet_score IS NOT NULL AND NOT isnan(x.comet_score)),
c AS (SELECT lang, max(n) AS n, max(CASE WHEN rn = least(n, CAST(ceil(f * n - 1e-9) AS BIGINT)) THEN v END) AS cutoff FROM s GROUP BY lang)
SELECT t.lang, t.f AS target_fraction, coalesce(c.n, 0) AS scored, c.cutoff,
 (SELECT count(*) FROM s WHERE s.lang = t.lang AND s.v >= c.cutoff) AS kept,
 CASE WHEN c.n > 0 THEN (SELECT count(*) FROM s WHERE s.lang = t.lang AND s.v >= c.cutoff) / c.n END AS actual_fraction FROM t LEFT JOIN c ON t.lang = c.lang""",
    "p6_kept": """WITH s AS (SELECT x.*, t.f, row_number() OVER (PARTITION BY x.lang ORDER BY x.comet_score DESC) AS rn, count(*) OVER (PARTITION BY x.lang) AS n
 FROM translation_scores x JOIN (SELECT lang, max(target_fraction) AS f FROM keep_targets WHERE lang IS NOT NULL GROUP BY lang) t ON x.lang = t.lang WHERE x.comet_score IS NOT NULL AND NOT isnan(x.comet_score)),
c AS (SELECT lang, max(CASE WHEN rn = least(n, CAST(ceil(f * n - 1e-9) AS BIGINT)) THEN comet_score END) AS cutoff FROM s GROUP BY lang)
SELECT s.db, s.lang, s.pair_id, s.comet_score, s.src, s.mt, s.scored_at FROM s JOIN c ON s.lang = c.lang AND s.comet_score >= c.cutoff""",
    "p8_shortage": """WITH goals AS (SELECT source, max(target_share) AS share, max(coalesce(max_repeats, 1)) AS most FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY source),
leaf AS (SELECT db, lang, d.source, sum(n_chars)::DOUBLE AS chars, sum(n_chars)::DOUBLE * any_value(most) AS room, any_value(share) AS share FROM documents d JOIN goals g ON d.source = g.source WHERE n_chars > 0 GROUP BY db, lang, d.source),
w AS (SELECT *, share * chars / sum(chars) OVER (PARTITION BY source) AS weight FROM leaf),
n1 AS (SELECT db, sum(weight) AS weight, sum(room) AS room, 0.7 * (SELECT sum(room) FROM w) AS has FROM w GROUP BY db),
l1 AS (SELECT *, (has - coalesce(sum(room) OVER (ORDER BY room / weight, db ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room / weight, db ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n1),
b1 AS (SELECT db, coalesce(least(room, max(CASE WHEN v * weight < room THEN v END) OVER () * weight), room) AS has FROM l1),
n2 AS (SELECT w.db, lang, sum(weight) AS weight, sum(room) AS room, any_value(has) AS has FROM w JOIN b1 ON w.db IS NOT DISTINCT FROM b1.db GROUP BY w.db, lang),
l2 AS (SELECT *, (has - coalesce(sum(room) OVER (PARTITION BY db ORDER BY room / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY db ORDER BY room / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n2),
b2 AS (SELECT db, lang, coalesce(least(room, max(CASE WHEN v * weight < room THEN v END) OVER (PARTITION BY db) * weight), room) AS has FROM l2),
n3 AS (SELECT w.*, has FROM w JOIN b2 ON w.db IS NOT DISTINCT FROM b2.db AND w.lang IS NOT DISTINCT FROM b2.lang),
l3 AS (SELECT *, (has - coalesce(sum(room) OVER (PARTITION BY db, lang ORDER BY room / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY db, lang ORDER BY room / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n3)
SELECT db, lang, source, chars::BIGINT AS chars, room::BIGINT AS room, round(coalesce(least(room, max(CASE WHEN v * weight < room THEN v END) OVER (PARTITION BY db, lang) * weight), room), 3) AS budget, true AS met FROM l3""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
