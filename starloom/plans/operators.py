"""Queries of the dataflow operators: transforms, star splitting, constraints, profiling, matching, metrics, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom import catalog, match
from starloom.functions import transforms as tf
from starloom.model import ColumnSpec, FkSpec, StarSpec, TableSpec
from starloom.operators import metrics, normalize, profile, retrieval
from starloom.session import read_table
from starloom.streaming.evaluations import tumbling_counts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --- row transforms ------------------------------------------------------------------------------------------------


def valid_rows(spark, sf_dir):
    f = _t(spark, sf_dir, "fact_coliforms")
    cols = [F.col("min_fecal_coliform_mpn_per_100ml"), F.col("min_total_coliform_mpn_per_100ml")]
    return f.filter(tf.complete(cols)).select("fact_coliforms_id", "loaded_at")


def partly_given(spark, sf_dir):
    f = _t(spark, sf_dir, "fact_coliforms")
    return f.filter(tf.any_given([F.col("min_fecal_coliform_mpn_per_100ml"), F.col("min_total_coliform_mpn_per_100ml")])).groupBy("year").agg(F.count("*").alias("n"))


def extract_year(spark, sf_dir):
    d = _t(spark, sf_dir, "evaluation_records")
    return d.select("eval_id", tf.extract_year(F.col("db")).alias("y")).distinct()


def number_texts(spark, sf_dir):
    f = _t(spark, sf_dir, "fact_coliforms")
    v = F.col("min_fecal_coliform_mpn_per_100ml")
    return f.groupBy(v.alias("v")).agg(F.count("*").alias("n")).select("v", "n", tf.to_number(F.col("v")).alias("x"), tf.to_int(F.col("v")).alias("i"))


def clean_numeric(spark, sf_dir):
    f = _t(spark, sf_dir, "fact_coliforms")
    v = F.col("min_total_coliform_mpn_per_100ml")
    return f.select(v.alias("v")).distinct().select("v", tf.to_float(F.col("v")).alias("as_float"), tf.clean_numeric(F.col("v")).alias("two_places"), tf.clean_amount(F.col("v")).alias("amount"))


def map_lookup(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy(tf.lookup(F.col("o_orderstatus"), {"O": "open", "F": "finished"}, "other").alias("status")).agg(F.count("*").alias("n"))


def fiscal_time(spark, sf_dir):
    y = _t(spark, sf_dir, "dim_time")
    parts = tf.fiscal_time(F.col("year"))
    return y.select("year", *[c.alias(k) for k, c in parts.items()])


def century_months(spark, sf_dir):
    y = _t(spark, sf_dir, "dim_time")
    cmc = (F.col("year") - 1900) * 12 + 7
    return y.select("year", *[c.alias(f"cm_{k}") for k, c in tf.century_month(cmc).items()])


def composite_key(spark, sf_dir):
    s = _t(spark, sf_dir, "dim_station")
    return s.select("station_id", tf.composite_key([F.col("state_id"), F.col("station_name"), F.col("type_of_water_body")]).alias("k"))


def token_lists(spark, sf_dir):
    t = _t(spark, sf_dir, "task_records").select("task_id", "question").distinct()
    return t.select("task_id", F.array_join(tf.ascii_tokens(F.col("question")), " ").alias("tokens"))


def sql_extract(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation_records")
    return e.select("eval_id", tf.extract_sql(F.col("raw_output")).alias("statement"), tf.label_of(F.col("raw_output")).alias("label")).distinct()


def basic_sql(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation_records")
    return e.select("eval_id", tf.basic_sql(F.col("predicted_sql")).alias("ok")).distinct()


def model_slug(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation_records")
    return e.groupBy(tf.slug(F.col("model")).alias("model")).agg(F.count("*").alias("n"))


# --- star splitting ------------------------------------------------------------------------------------------------

WIDE = ["r_name", "n_name", "c_mktsegment", "o_orderdate", "o_orderstatus", "o_totalprice"]
STAR = StarSpec(
    dimensions=(
        TableSpec("DIM_REGION", (ColumnSpec(0, "REGION"),), (0,), "REGION_ID"),
        TableSpec("DIM_NATION", (ColumnSpec(1, "NATION"),), (1,), "NATION_ID", foreign_keys=(FkSpec("REGION_ID", "DIM_REGION", "REGION_ID"),)),
        TableSpec("DIM_TIME", (ColumnSpec(3, "YEAR", "extract_year"),), (3,), "YEAR", 3, "extract_year"),
        TableSpec("DIM_SEGMENT", (ColumnSpec(2, "SEGMENT", "lowercase"),), (2,), "SEGMENT_ID"),
    ),
    facts=(TableSpec("FACT_ORDER", (ColumnSpec(4, "STATUS"), ColumnSpec(5, "PRICE")), (), "FACT_ORDER_ID", foreign_keys=(FkSpec("NATION_ID", "DIM_NATION", "NATION_ID"), FkSpec("YEAR", "DIM_TIME", "YEAR"), FkSpec("SEGMENT_ID", "DIM_SEGMENT", "SEGMENT_ID"))),),
)


def _wide(spark, sf_dir) -> DataFrame:
    o, c, n, r = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    year = F.year("o_orderdate").cast("string").alias("o_orderdate")
    return joined.select(F.col("o_orderkey").alias("_pos"), "r_name", "n_name", "c_mktsegment", year, "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"))


def dim_dedup_surrogate(spark, sf_dir):
    out = normalize.split(_wide(spark, sf_dir), STAR, only={"DIM_NATION"})["DIM_NATION"]
    return out.select(F.col("NATION_ID").cast("bigint").alias("nation_id"), F.col("REGION_ID").cast("bigint").alias("region_id"), F.col("NATION").alias("nation"))


def dim_natural_key(spark, sf_dir):
    return normalize.split(_wide(spark, sf_dir), STAR, only={"DIM_TIME"})["DIM_TIME"].select(F.col("YEAR").cast("bigint").alias("year"))


def fact_fk_resolution(spark, sf_dir):
    out = normalize.split(_wide(spark, sf_dir), STAR, only={"FACT_ORDER"})["FACT_ORDER"]
    return out.select(*[F.col(c).cast("bigint").alias(c.lower()) for c in ("FACT_ORDER_ID", "NATION_ID", "YEAR", "SEGMENT_ID")], F.col("STATUS").alias("status"), F.col("PRICE").cast("double").alias("price"))


def star_round_trip(spark, sf_dir):
    """The split joined together again equals the cleaned rows: counts per combination."""
    tables = normalize.split(_wide(spark, sf_dir), STAR)
    back = normalize.rejoin(tables, STAR, "FACT_ORDER")
    return back.groupBy(F.col("NATION").alias("nation"), F.col("SEGMENT").alias("segment"), F.col("STATUS").alias("status")).agg(F.count("*").alias("n"))


def unpivot_measures(spark, sf_dir):
    f = _t(spark, sf_dir, "fact_coliforms").select("fact_coliforms_id", "min_fecal_coliform_mpn_per_100ml", "min_total_coliform_mpn_per_100ml")
    return normalize.unpivot(f, ["fact_coliforms_id"], ["min_fecal_coliform_mpn_per_100ml", "min_total_coliform_mpn_per_100ml"], "measure", "value").groupBy("measure").agg(F.count("*").alias("n"))


def hierarchy_levels(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3)).alias("p"))
    return normalize.hierarchy(n, "k", "p")


# --- latest picks, joins, constraints ------------------------------------------------------------------------------


def latest_per_key(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return metrics.latest(e.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


def pair_semi_join(spark, sf_dir):
    t, e = _t(spark, sf_dir, "task_records"), _t(spark, sf_dir, "evaluation_records")
    return metrics.with_keys(e.select("eval_id", "pair_id"), t.select("pair_id").distinct(), "pair_id").distinct()


def unknown_pairs(spark, sf_dir):
    t, e = _t(spark, sf_dir, "task_records"), _t(spark, sf_dir, "evaluation_records")
    return catalog.orphans(e.select("eval_id", "pair_id").distinct(), "pair_id", t.select("pair_id").distinct(), "pair_id")


def source_translation_join(spark, sf_dir):
    t = _t(spark, sf_dir, "task_records").filter(F.col("lang") == "English").groupBy("db", "pair_id").agg(F.count("*").alias("tasks"))
    s = _t(spark, sf_dir, "translation_scores").groupBy("db", "pair_id").agg(F.count("*").alias("scores"))
    return metrics.source_with_translation(t, s, ["db", "pair_id"])


def pk_duplicates(spark, sf_dir):
    return catalog.duplicate_keys(_t(spark, sf_dir, "fact_coliforms"), ["fact_coliforms_id"])


def fk_orphans(spark, sf_dir):
    f, s = _t(spark, sf_dir, "fact_coliforms"), _t(spark, sf_dir, "dim_station")
    return catalog.orphans(f.select("fact_coliforms_id", "station_id"), "station_id", s.filter("station_id % 7 <> 0"), "station_id").groupBy("station_id").agg(F.count("*").alias("n"))


def null_keys(spark, sf_dir):
    return catalog.null_keys(_t(spark, sf_dir, "dim_station"), ["state_id", "station_code"]).select("station_id")


# --- profiling -----------------------------------------------------------------------------------------------------


def column_profile(spark, sf_dir):
    return profile.profile(_t(spark, sf_dir, "dim_station").drop("station_code")).select("column", "rows", "nulls", "distinct", "longest")


def inferred_types(spark, sf_dir):
    d = _t(spark, sf_dir, "dim_station")
    s = d.select(*[F.col(c).cast("string") for c in d.columns])
    return spark.createDataFrame(sorted(profile.infer_types(s).items()), "column string, type string")


def value_frequency(spark, sf_dir):
    return profile.frequent_values(_t(spark, sf_dir, "part"), "p_brand", 10)


def sample_values(spark, sf_dir):
    return profile.sample_values(_t(spark, sf_dir, "dim_station"), "type_of_water_body", 4)


def value_search(spark, sf_dir):
    return profile.value_search(_t(spark, sf_dir, "dim_state"), "state", "ta")


def nearest_value(spark, sf_dir):
    wanted = _t(spark, sf_dir, "dim_state").select(F.concat(F.col("state"), F.lit("x")).alias("w"))
    return profile.nearest_values(wanted, "w", _t(spark, sf_dir, "dim_state"), "state")


# --- matching ------------------------------------------------------------------------------------------------------


def em_canonical(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation_records").select("eval_id", "gold_sql", "predicted_sql").distinct()
    return match.rescored(e, F.col("gold_sql"), F.col("predicted_sql")).select("eval_id", "em_new")


def em_changes(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation_records").select("eval_id", "model", "lang", "em", "ex", "gold_sql", "predicted_sql").distinct()
    return metrics.summarize_files(match.rescored(e, F.col("gold_sql"), F.col("predicted_sql")), ["model", "lang"])


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("gold")).unionByName(b.exceptAll(a).withColumn("side", F.lit("pred")))


def ex_match_multiset(spark, sf_dir):
    """Rows in which two aggregates differ, as multisets."""
    l = _t(spark, sf_dir, "lineitem")
    a = l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    b = l.filter("l_quantity <> 13").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return _differences(a, b)


def ex_outcomes(spark, sf_dir):
    """Execution match of statement pairs over whole tables."""
    for t in ("nation", "region", "orders", "customer"):
        _t(spark, sf_dir, t).createOrReplaceTempView(t)
    cases = [
        ("counts", "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(1) FROM orders GROUP BY o_orderstatus"), ("joined", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"),
        ("many", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"), ("sorted", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM orders ORDER BY -o_totalprice, o_orderkey"),
        ("same", "SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE true"), ("ordered", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC"),
        ("unordered", "SELECT n_name FROM nation", "SELECT n_name FROM nation ORDER BY n_name DESC"), ("multiset", "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation"), ("broken", "SELECT n_name FROM nation", "SELECT nope FROM nation"),
    ]
    return spark.createDataFrame([(name, match.execution_match(spark, g, p, 60).match) for name, g, p in cases], "name string, ex int")


# --- metrics -------------------------------------------------------------------------------------------------------


def _evaluations(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "evaluation_records").select("eval_id", "db", "model", "lang", "em", "ex").distinct()


def macro_micro(spark, sf_dir):
    e = _evaluations(spark, sf_dir).withColumn("em_new", F.col("em"))
    files = metrics.summarize_files(e, ["db", "model", "lang"])
    out = metrics.macro_micro(files.select("model", "lang", "rows", "ex_mean", F.col("em_new_mean").alias("em_mean")), ["model", "lang"], ["em_mean", "ex_mean"])
    return out.select("model", "lang", "files", "rows", *[F.round(c, 9).alias(c) for c in ("macro_em_mean", "macro_ex_mean", "micro_em_mean", "micro_ex_mean")])


def em_ex_by_language(spark, sf_dir):
    return metrics.counts_text(_evaluations(spark, sf_dir), ["lang"])


def sampled_pairs(spark, sf_dir):
    """A hundred pair ids by seeded hash, and their rows in every language (sampling is the feature)."""
    t = _t(spark, sf_dir, "task_records")
    return metrics.with_keys(t.select("pair_id", "task_id").distinct(), metrics.sample_keys(t, "pair_id", 100), "pair_id")


def _scores(spark, sf_dir) -> DataFrame:
    return metrics.usable(_t(spark, sf_dir, "translation_scores"))


def score_means(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("comet_score"), 9).alias("mean"), F.count("*").alias("n"))


def percentile_tau_audit(spark, sf_dir):
    a = metrics.percentile_audit(_scores(spark, sf_dir), "lang", "comet_score")
    return a.select("lang", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("tau", 9).alias("tau"))


def review_rows(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return metrics.flagged(s, metrics.percentile_audit(s, "lang", "comet_score"), "lang", "comet_score").groupBy("lang").agg(F.count("*").alias("flagged"))


def score_histogram(spark, sf_dir):
    return metrics.histogram(_scores(spark, sf_dir), "comet_score", 0.0, 1.0, 30)


def threshold_sensitivity(spark, sf_dir):
    return metrics.sensitivity(_scores(spark, sf_dir), "comet_score").select("k", F.round("tau", 9).alias("tau"), "flagged", F.round("rate", 9).alias("rate"))


def knee_point(spark, sf_dir):
    k = metrics.knee(metrics.sensitivity(_scores(spark, sf_dir), "comet_score"), "k", "rate")
    return k.select("k", F.round("rate", 9).alias("rate"), F.round("distance", 9).alias("distance"))


def threshold_rates(spark, sf_dir):
    r = metrics.rates_at(_scores(spark, sf_dir), "lang", "comet_score", {"strict": 0.5, "lenient": 0.7})
    return r.select("lang", "n", F.round("strict", 9).alias("strict"), F.round("lenient", 9).alias("lenient"))


def difficulty_distribution(spark, sf_dir):
    return _t(spark, sf_dir, "task_records").select("task_id", "difficulty").distinct().groupBy("difficulty").agg(F.count("*").alias("n"))


def pair_quality(spark, sf_dir):
    t = _t(spark, sf_dir, "task_records").select("task_id", "similarity_score", "original_question_id", tf.basic_sql(F.col("sql")).alias("ok")).distinct()
    q = metrics.pair_quality(t, "similarity_score", "ok", "original_question_id")
    return q.select("pairs", "valid", *[F.round(c, 9).alias(c) for c in ("validity_rate", "mean_score", "min_score", "max_score", "pairs_per_question")])


# --- retrieval -----------------------------------------------------------------------------------------------------


def cosine_topk(spark, sf_dir):
    """For each stated query vector (ids divisible by 50) its five nearest, of all vectors."""
    e = _t(spark, sf_dir, "embeddings")
    return retrieval.cosine_top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


def token_jaccard_topk(spark, sf_dir):
    """For each stated query task (ids divisible by 50) the three most similar tasks of other databases, among all tasks in any script."""
    t = _t(spark, sf_dir, "task_records").filter("question is not null").groupBy("task_id").agg(F.min("db").alias("db"), F.min("question").alias("question"))
    out = retrieval.examples(t.filter("task_id % 50 = 0"), t, "db", "question", "task_id", 3)
    return out.select("target_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def diversified_topk(spark, sf_dir):
    """Per language: the best-scored pair of each database, three databases, two pairs each."""
    s = _scores(spark, sf_dir).groupBy("lang", "db", "pair_id").agg(F.max("comet_score").alias("score"))
    out = retrieval.diversified(s, "lang", "db", "score", "pair_id", 3, 2)
    return out.select("lang", "db", "pair_id", F.round("score", 9).alias("score"), F.col("rank_in_db").cast("bigint").alias("rank_in_db"), F.col("db_rank").cast("bigint").alias("db_rank"))


def near_duplicates(spark, sf_dir):
    """Tasks that ask an earlier question of the database again, nearly word for word; statements, which differ in all tasks, are compared by their skeleton's name."""
    t = _t(spark, sf_dir, "task_records").filter("question is not null and skeleton_id is not null").groupBy("task_id").agg(F.min(F.struct("db", "question")).alias("x")).select("task_id", "x.*")
    return retrieval.near_duplicates(t, "db", "task_id", "question", "question").withColumnRenamed("id", "task_id")


def event_windows(spark, sf_dir):
    return tumbling_counts(_t(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


_NAMES = """valid_rows partly_given extract_year number_texts clean_numeric map_lookup fiscal_time century_months composite_key token_lists sql_extract basic_sql model_slug
dim_dedup_surrogate dim_natural_key fact_fk_resolution star_round_trip unpivot_measures hierarchy_levels latest_per_key pair_semi_join unknown_pairs source_translation_join pk_duplicates
fk_orphans null_keys column_profile inferred_types value_frequency sample_values value_search nearest_value em_canonical em_changes ex_match_multiset ex_outcomes macro_micro em_ex_by_language
sampled_pairs score_means percentile_tau_audit review_rows score_histogram threshold_sensitivity knee_point threshold_rates difficulty_distribution pair_quality cosine_topk token_jaccard_topk
diversified_topk near_duplicates event_windows""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_BAD = "('', 'null', 'na', 'n/a', 'none', '-')"
_VALID = lambda c: f"lower(trim(coalesce({c}, ''))) NOT IN {_BAD}"
_WIDE = "wide AS (SELECT o_orderkey AS pos, r_name, n_name, c_mktsegment, year(o_orderdate) AS y, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_DIMS = _WIDE + ", reg AS (SELECT r_name, row_number() OVER (ORDER BY min(pos)) AS region_id FROM wide GROUP BY r_name), nat AS (SELECT w.r_name, w.n_name, row_number() OVER (ORDER BY min(pos)) AS nation_id FROM wide w GROUP BY w.r_name, w.n_name), seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(pos)) AS segment_id FROM wide GROUP BY c_mktsegment)"
_S = "s AS (SELECT * FROM translation_scores WHERE comet_score IS NOT NULL AND NOT isnan(comet_score) AND lang IS NOT NULL AND lower(lang) <> 'unknown')"
_E = "e AS (SELECT DISTINCT eval_id, db, model, lang, em, ex FROM evaluation_records)"
_GRID = "grid AS (SELECT round(0.5 + i * 0.05, 10)::DOUBLE AS k FROM range(31) t(i)), st AS (SELECT avg(comet_score) AS mu, stddev_pop(comet_score) AS sd, count(*) AS n FROM s), sens AS (SELECT k, mu - k * sd AS tau, (SELECT count(*) FROM s WHERE comet_score <= mu - k * sd) AS flagged, n FROM grid, st)"
_NUM = "CASE WHEN regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(v) AS DOUBLE) END"

_WS = "E' \\t\\n\\r\\f\\x0B'"
_BARE = f"replace(trim(v, {_WS}), ',', '')"
#: In these tables no pair of statements is equal by its rules only (aliases, order of conditions), so equal plain texts give the same matches.
_PLAIN = lambda c: f"lower(trim(regexp_replace(regexp_replace({c}, '[\"''`;]', '', 'g'), '\\s+', ' ', 'g')))"
_EM = f"CASE WHEN trim(coalesce(g, '')) = '' OR trim(coalesce(p, '')) = '' THEN 0 ELSE ({_PLAIN('g')} = {_PLAIN('p')})::INTEGER END"
_BAGS = [
    ("same", "SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE true"), ("unordered", "SELECT n_name FROM nation", "SELECT n_name FROM nation ORDER BY n_name DESC"), ("multiset", "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation"),
    ("counts", "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(1) FROM orders GROUP BY o_orderstatus"), ("joined", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"),
    ("many", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"),
]
_LISTS = [
    ("ordered", "SELECT list(n_name ORDER BY n_name) FROM nation", "SELECT list(n_name ORDER BY n_name DESC) FROM nation"),
    ("sorted", "SELECT list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FROM orders", "SELECT list(o_orderkey ORDER BY -o_totalprice, o_orderkey) FROM orders"),
]

SQL = {
    "valid_rows": f"SELECT fact_coliforms_id, loaded_at FROM fact_coliforms WHERE {_VALID('min_fecal_coliform_mpn_per_100ml')} AND {_VALID('min_total_coliform_mpn_per_100ml')}",
    "partly_given": "SELECT year, count(*) AS n FROM fact_coliforms WHERE trim(coalesce(min_fecal_coliform_mpn_per_100ml, '')) <> '' OR trim(coalesce(min_total_coliform_mpn_per_100ml, '')) <> '' GROUP BY year",
    "extract_year": "SELECT DISTINCT eval_id, regexp_extract(coalesce(db, ''), '(\\d{4})', 1) AS y FROM evaluation_records",
    "number_texts": f"SELECT v, n, x, CASE WHEN x IS NULL THEN '' ELSE CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR) END AS i FROM (SELECT v, n, {_NUM} AS x FROM (SELECT min_fecal_coliform_mpn_per_100ml AS v, count(*) AS n FROM fact_coliforms GROUP BY 1))",
    "map_lookup": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "fiscal_time": "SELECT year, year AS start_year, year + 1 AS end_year, 'FY' || year || '-' || lpad(CAST((year + 1) % 100 AS VARCHAR), 2, '0') AS label, (year // 10 * 10) || 's' AS decade, year < 2017 AS pre_gst, year IN (2020, 2021) AS covid FROM dim_time",
    "century_months": "SELECT year, year AS cm_year, 7 AS cm_month FROM dim_time",
    "composite_key": "SELECT station_id, coalesce(CAST(state_id AS VARCHAR), '') || '|' || trim(coalesce(station_name, '')) || '|' || trim(coalesce(type_of_water_body, '')) AS k FROM dim_station",
    "token_lists": "SELECT DISTINCT task_id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM task_records",
    "model_slug": "SELECT replace(replace(replace(coalesce(model, ''), '/', '_'), '-', '_'), '.', '_') AS model, count(*) AS n FROM evaluation_records GROUP BY 1",
    "basic_sql": "SELECT DISTINCT eval_id, contains(l, 'select') AND contains(l, 'from') AND length(replace(l, '(', '')) = length(replace(l, ')', '')) AND NOT contains(l, 'col_') AND NOT contains(l, 'table_') AS ok FROM (SELECT eval_id, lower(coalesce(predicted_sql, '')) AS l FROM evaluation_records)",
    "dim_dedup_surrogate": f"WITH {_DIMS} SELECT nation_id, region_id, n_name AS nation FROM nat JOIN reg USING (r_name)",
    "dim_natural_key": f"WITH {_DIMS} SELECT DISTINCT CAST(y AS BIGINT) AS year FROM wide",
    "fact_fk_resolution": f"WITH {_DIMS} SELECT row_number() OVER (ORDER BY pos) AS fact_order_id, nation_id, CAST(y AS BIGINT) AS year, segment_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS price FROM wide JOIN nat USING (r_name, n_name) JOIN seg USING (c_mktsegment)",
    "star_round_trip": f"WITH {_WIDE} SELECT n_name AS nation, lower(c_mktsegment) AS segment, o_orderstatus AS status, count(*) AS n FROM wide GROUP BY 1, 2, 3",
    "unpivot_measures": "SELECT 'min_fecal_coliform_mpn_per_100ml' AS measure, count(*) AS n FROM fact_coliforms WHERE trim(coalesce(min_fecal_coliform_mpn_per_100ml, '')) <> '' UNION ALL SELECT 'min_total_coliform_mpn_per_100ml', count(*) FROM fact_coliforms WHERE trim(coalesce(min_total_coliform_mpn_per_100ml, '')) <> ''",
    "hierarchy_levels": "WITH RECURSIVE h(k, root, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1 UNION ALL SELECT CAST(n_nationkey AS BIGINT), root, level + 1 FROM nation JOIN h ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = h.k) SELECT k, root, level FROM h",
    "latest_per_key": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "pair_semi_join": "SELECT DISTINCT eval_id, pair_id FROM evaluation_records WHERE pair_id IN (SELECT pair_id FROM task_records WHERE pair_id IS NOT NULL)",
    "unknown_pairs": "SELECT DISTINCT eval_id, pair_id FROM evaluation_records WHERE pair_id IS NOT NULL AND pair_id NOT IN (SELECT pair_id FROM task_records WHERE pair_id IS NOT NULL)",
    "source_translation_join": "SELECT t.db, t.pair_id, tasks, scores FROM (SELECT db, pair_id, count(*) AS tasks FROM task_records WHERE lang = 'English' GROUP BY db, pair_id) t JOIN (SELECT db, pair_id, count(*) AS scores FROM translation_scores GROUP BY db, pair_id) s ON t.db = s.db AND t.pair_id = s.pair_id",
    "pk_duplicates": "SELECT fact_coliforms_id, count(*) AS n FROM fact_coliforms GROUP BY 1 HAVING count(*) > 1",
    "fk_orphans": "SELECT station_id, count(*) AS n FROM fact_coliforms WHERE station_id IS NOT NULL AND station_id NOT IN (SELECT station_id FROM dim_station WHERE station_id % 7 <> 0) GROUP BY 1",
    "null_keys": "SELECT station_id FROM dim_station WHERE state_id IS NULL OR station_code IS NULL",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", max(length(CAST({c} AS VARCHAR)))::INTEGER AS longest FROM dim_station" for c in ("station_name", "type_of_water_body", "state_id", "station_id")),
    "value_frequency": "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "sample_values": "SELECT DISTINCT type_of_water_body AS value FROM dim_station WHERE type_of_water_body IS NOT NULL ORDER BY 1 LIMIT 4",
    "value_search": "SELECT DISTINCT state AS value FROM dim_state WHERE state ILIKE '%ta%'",
    "ex_match_multiset": "WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity <> 13 GROUP BY 1, 2) SELECT *, 'gold' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'pred' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "ex_outcomes": " UNION ALL ".join([*[f"SELECT '{name}' AS name, CAST(NOT EXISTS (SELECT * FROM (({g}) EXCEPT ALL ({p})) UNION ALL SELECT * FROM (({p}) EXCEPT ALL ({g}))) AS INTEGER) AS ex" for name, g, p in _BAGS], *[f"SELECT '{name}', CAST(({g}) = ({p}) AS INTEGER)" for name, g, p in _LISTS], "SELECT 'broken', 0"]),
    "em_canonical": f"SELECT eval_id, {_EM} AS em_new FROM (SELECT DISTINCT eval_id, gold_sql AS g, predicted_sql AS p FROM evaluation_records)",
    "em_changes": f"SELECT model, lang, count(*) AS rows, avg(em) AS em_old_mean, avg(em_new) AS em_new_mean, avg(ex) AS ex_mean, coalesce(sum((em <> em_new)::INT), 0)::BIGINT AS em_changed_rows FROM (SELECT *, {_EM} AS em_new FROM (SELECT DISTINCT eval_id, model, lang, em, ex, gold_sql AS g, predicted_sql AS p FROM evaluation_records)) GROUP BY model, lang",
    "sql_extract": f"SELECT DISTINCT eval_id, trim(regexp_replace(trim(regexp_replace(coalesce(raw_output, ''), '```(sql)?', '', 'gi'), {_WS}), '^sql\\s*:\\s*', '', 'i'), {_WS}) AS statement, CASE WHEN contains(raw_output, 'EASY') THEN 'EASY' WHEN contains(raw_output, 'NON-NESTED') THEN 'NON-NESTED' ELSE 'NESTED' END AS label FROM evaluation_records",
    "clean_numeric": f"WITH d AS (SELECT DISTINCT min_total_coliform_mpn_per_100ml AS v FROM fact_coliforms), x AS (SELECT v, {_NUM} AS x, {_NUM.replace('trim(v)', _BARE)} AS y FROM d) SELECT v, coalesce(CAST(x AS VARCHAR), '') AS as_float, coalesce(CAST(round(x, 2) AS VARCHAR), '') AS two_places, CASE WHEN {_VALID('v')} AND y IS NOT NULL THEN regexp_replace(regexp_replace(CAST(CAST(y AS DECIMAL(38,2)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') ELSE '' END AS amount FROM x",
    "inferred_types": " UNION ALL ".join([f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'VARCHAR(255)' ELSE 'BIGINT' END AS type FROM dim_station" for c in ("station_id", "state_id")] + ["SELECT 'station_code', CASE WHEN count(station_code) = 0 THEN 'VARCHAR(255)' ELSE 'DOUBLE PRECISION' END FROM dim_station"] + [f"SELECT '{c}', (SELECT coalesce(min('VARCHAR(' || s || ')') FILTER (WHERE s = (SELECT min(s) FROM unnest([10, 20, 30, 50, 100, 200, 255, 500, 1000]) u(s) WHERE s >= need)), 'TEXT') FROM unnest([10, 20, 30, 50, 100, 200, 255, 500, 1000]) v(s)) FROM (SELECT floor(max(length(trim({c}, {_WS}))) * 1.2) + 10 AS need FROM dim_station)" for c in ("station_name", "type_of_water_body")]),
    "sampled_pairs": "WITH k AS (SELECT pair_id FROM (SELECT DISTINCT pair_id FROM task_records WHERE pair_id IS NOT NULL) ORDER BY md5('7|' || pair_id), pair_id LIMIT 100) SELECT DISTINCT pair_id, task_id FROM task_records WHERE pair_id IN (SELECT pair_id FROM k)",
    "near_duplicates": "WITH t AS (SELECT task_id, x.db AS db, regexp_extract_all(lower(x.question), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS w FROM (SELECT task_id, min({'db': db, 'question': question}) AS x FROM task_records WHERE question IS NOT NULL AND skeleton_id IS NOT NULL GROUP BY task_id)) SELECT task_id FROM (SELECT *, min(task_id) OVER (PARTITION BY db, w) AS first FROM t WHERE len(w) > 0) WHERE task_id > first",
    "macro_micro": f"WITH {_E}, f AS (SELECT db, model, lang, count(*) AS rows, avg(em) AS em_mean, avg(ex) AS ex_mean FROM e GROUP BY 1, 2, 3) SELECT model, lang, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, round(avg(em_mean), 9) AS macro_em_mean, round(avg(ex_mean), 9) AS macro_ex_mean, round(sum(em_mean * rows) / sum(CASE WHEN em_mean IS NOT NULL THEN rows END), 9) AS micro_em_mean, round(sum(ex_mean * rows) / sum(CASE WHEN ex_mean IS NOT NULL THEN rows END), 9) AS micro_ex_mean FROM f GROUP BY 1, 2",
    "em_ex_by_language": f"WITH {_E} SELECT lang, coalesce(sum(em), 0)::BIGINT || '/' || count(*) AS em, coalesce(sum(ex), 0)::BIGINT || '/' || count(*) AS ex FROM e GROUP BY lang",
    "score_means": f"WITH {_S} SELECT lang, round(avg(comet_score), 9) AS mean, count(*) AS n FROM s GROUP BY lang",
    "percentile_tau_audit": f"WITH {_S} SELECT lang, count(*) AS n, round(avg(comet_score), 9) AS mean, round(stddev_pop(comet_score), 9) AS std, round(quantile_cont(comet_score, 0.2), 9) AS tau FROM s GROUP BY lang",
    "review_rows": f"WITH {_S}, a AS (SELECT lang, quantile_cont(comet_score, 0.2) AS tau FROM s GROUP BY lang) SELECT s.lang, count(*) AS flagged FROM s JOIN a ON s.lang = a.lang AND comet_score <= tau GROUP BY 1",
    "score_histogram": f"WITH {_S} SELECT CASE WHEN comet_score < 0 THEN -1 WHEN comet_score > 1 THEN 30 ELSE CAST(least(floor((comet_score - 0.0) / ((1.0 - 0.0) / 30)::DOUBLE), 29) AS INTEGER) END AS bin, count(*) AS n FROM s GROUP BY 1",
    "threshold_sensitivity": f"WITH {_S}, {_GRID} SELECT k, round(tau, 9) AS tau, flagged, round(flagged / n, 9) AS rate FROM sens",
    "knee_point": f"WITH {_S}, {_GRID}, r AS (SELECT k, flagged / n AS rate FROM sens), u AS (SELECT k, rate, (k - 0.5) / 1.5 AS x, (rate - min(rate) OVER ()) / (max(rate) OVER () - min(rate) OVER ()) AS y FROM r), ends AS (SELECT arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x1, arg_max(y, k) AS y1 FROM u) SELECT k, round(rate, 9) AS rate, round(d, 9) AS distance FROM (SELECT k, rate, abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d FROM u, ends) ORDER BY round(d, 12) DESC, k LIMIT 1",
    "threshold_rates": f"WITH {_S} SELECT lang, count(*) AS n, round(avg(CASE WHEN comet_score <= 0.5 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS strict, round(avg(CASE WHEN comet_score <= 0.7 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS lenient FROM s GROUP BY lang",
    "difficulty_distribution": "SELECT difficulty, count(*) AS n FROM (SELECT DISTINCT task_id, difficulty FROM task_records) GROUP BY difficulty",
    "pair_quality": "WITH t AS (SELECT DISTINCT task_id, similarity_score, original_question_id, lower(coalesce(sql, '')) AS l FROM task_records), q AS (SELECT *, contains(l, 'select') AND contains(l, 'from') AND length(replace(l, '(', '')) = length(replace(l, ')', '')) AND NOT contains(l, 'col_') AND NOT contains(l, 'table_') AS ok FROM t) SELECT count(*) AS pairs, count(CASE WHEN ok THEN 1 END) AS valid, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS validity_rate, round(avg(CASE WHEN similarity_score > 0 THEN similarity_score END), 9) AS mean_score, round(min(CASE WHEN similarity_score > 0 THEN similarity_score END), 9) AS min_score, round(max(CASE WHEN similarity_score > 0 THEN similarity_score END), 9) AS max_score, round(count(*) / count(DISTINCT original_question_id), 9) AS pairs_per_question FROM q",
    "cosine_topk": "WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 9) AS score FROM embeddings i JOIN embeddings q ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id) SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 5",
    "token_jaccard_topk": "WITH t AS (SELECT task_id, min(db) AS db, list_distinct(list_filter(regexp_split_to_array(lower(min(question)), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')) AS w FROM task_records WHERE question IS NOT NULL GROUP BY task_id), p AS (SELECT a.task_id AS target_id, b.task_id AS id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) AS score FROM t a JOIN t b ON a.task_id % 50 = 0 AND a.db <> b.db WHERE len(list_intersect(a.w, b.w)) > 0) SELECT target_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 3",
    "diversified_topk": f"WITH {_S}, g AS (SELECT lang, db, pair_id, max(comet_score) AS score FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY lang, db ORDER BY score DESC, pair_id) AS rank_in_db FROM g), b AS (SELECT lang, db, row_number() OVER (PARTITION BY lang ORDER BY score DESC, pair_id) AS db_rank FROM r WHERE rank_in_db = 1) SELECT r.lang, r.db, pair_id, round(score, 9) AS score, rank_in_db, db_rank FROM r JOIN b ON r.lang = b.lang AND r.db = b.db WHERE rank_in_db <= 2 AND db_rank <= 3",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
