"""Queries of sources, sinks, the catalogue, text helpers and profiling rules, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom import catalog, match, query, synth
from starloom.functions import prose
from starloom.functions import transforms as tf
from starloom.lineage import ensure_checkpoint_dir
from starloom.model import ColumnSpec, FkSpec, SchemaInfo, StarSpec, TableInfo, TableSpec
from starloom.operators import metrics, normalize, profile, retrieval
from starloom.plans.relational import register
from starloom.session import read_table as _t
from starloom.sources import tables

#: Tables that serve as a package to write and read again.
PACKAGE = ("region", "nation", "supplier")


def _folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def _schema(spark: SparkSession, sf_dir: str, names=PACKAGE) -> SchemaInfo:
    kinds = {"string": "VARCHAR(255)", "double": "DOUBLE PRECISION", "int": "INTEGER", "bigint": "BIGINT"}
    return SchemaInfo("package", {n: TableInfo(n, [(c, kinds.get(k, "TEXT")) for c, k in _t(spark, sf_dir, n).dtypes]) for n in names})


# --- sources and sinks ---------------------------------------------------------------------------------------------


def csv_wide_scan(spark, sf_dir):
    """A table written as CSV and read as text cells."""
    path = _folder(spark)
    tables.write_csv(_t(spark, sf_dir, "dim_station").select("station_id", "state_id", "station_name", "type_of_water_body"), path)
    return tables.wide_csv(spark, path)


def csv_typed_scan(spark, sf_dir):
    """A table written as CSV and read with the types of its DDL."""
    path = _folder(spark)
    tables.write_csv(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    table = catalog.parse_create_table("CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR(50), s_nationkey BIGINT REFERENCES nation(n_nationkey), s_acctbal DOUBLE PRECISION)")
    return tables.table_csv(spark, path, table)


def csv_header(spark, sf_dir):
    path = _folder(spark)
    tables.write_csv(_t(spark, sf_dir, "customer"), path, single=True)
    return spark.createDataFrame([(i, c) for i, c in enumerate(tables.header(path), 1)], "ordinal_position int, column_name string")


def ddl_scan(spark, sf_dir):
    """Definitions written as DDL.csv, read and parsed again."""
    path = f"{_folder(spark)}.ddl"
    tables.write_ddl_csv(_schema(spark, sf_dir), path)
    found = tables.ddl_csv(path, "package")
    return catalog.information_schema(spark, found)["columns"].select("table_name", "column_name", "ordinal_position")


def json_lines_scan(spark, sf_dir):
    """Tasks written as JSON lines and read as tasks."""
    path = _folder(spark)
    tables.write_json_lines(_t(spark, sf_dir, "task_records").select("question", "sql", "pair_id", "original_question_id", "schema_used", "skeleton_id", "difficulty", "similarity_score"), path)
    back = tables.tasks(spark, path)
    return back.groupBy("difficulty", "skeleton_id").agg(F.count("*").alias("n"), F.count("gold_sql").alias("statements"), F.coalesce(F.sum(F.when(F.col("schema_used").isNotNull(), F.size("schema_used"))), F.lit(0)).cast("bigint").alias("columns_used"))


def path_columns(spark, sf_dir):
    """Database, model, language and time stamp from the paths of evaluation files."""
    e = _t(spark, sf_dir, "evaluation_records").filter("db is not null and model is not null and lang is not null")
    stamp = F.date_format("run_at", "yyyyMMdd_HHmmss")
    path = F.concat(F.lit("/data/eval_files_oneshot_"), tf.slug(F.col("model")), F.lit("/"), F.col("db"), F.lit("_text2sql_"), stamp, F.lit("_"), F.lower("lang"), F.lit("_evaluated.jsonl"))
    return e.select("eval_id", *[c.alias(k) for k, c in tf.path_parts(path).items()]).distinct()


def catalog_columns(spark, sf_dir):
    """Tables made in Spark's catalogue from their definitions, listed from there."""
    database = f"package_{uuid.uuid4().hex[:8]}"
    for table in _schema(spark, sf_dir).tables.values():
        catalog.create_spark_table(spark, database, table)
    found = catalog.from_spark(spark, database)
    rows = [(t.name, c, i) for t in found.tables.values() for i, (c, _) in enumerate(t.columns, 1)]
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")


def appended_rows(spark, sf_dir):
    """A table emptied and filled again, text cells cast to its types and '' as null."""
    database = f"load_{uuid.uuid4().hex[:8]}"
    catalog.create_spark_table(spark, database, TableInfo("station", [("station_id", "BIGINT"), ("station_name", "TEXT"), ("station_code", "DOUBLE PRECISION")]))
    stations = _t(spark, sf_dir, "dim_station").select("station_id", F.coalesce("station_name", F.lit("")).alias("station_name"), F.col("station_code").cast("string"))
    tables.append_table(stations, f"{database}.station", most=1)
    tables.truncate(spark, f"{database}.station")
    tables.append_table(stations, f"{database}.station")
    out = spark.createDataFrame(spark.table(f"{database}.station").groupBy().agg(F.count("*"), F.count("station_name"), F.count("station_code"), F.sum("station_id")).collect(), "n bigint, names bigint, codes bigint, ids bigint")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


CHECKED = [
    {"name": "nations", "sql": "SELECT n_name, n_regionkey FROM nation", "complexity": "easy", "category": "scan"},
    {"name": "grouped", "sql": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", "complexity": "medium", "category": "aggregate"},
    {"name": "none", "sql": "SELECT n_name FROM nation WHERE n_nationkey < 0", "complexity": "easy", "category": "filter"},
    {"name": "broken", "sql": "SELECT nope FROM nation", "complexity": "easy", "category": "scan"},
]


def validation_run(spark, sf_dir):
    """Four statements run by themselves: success, rows and columns."""
    register(spark, sf_dir, ("nation", "orders"))
    runs = query.validate(spark, CHECKED, _folder(spark))
    return spark.createDataFrame([(r.name, r.success, r.rows, r.columns) for r in runs], "name string, success boolean, rows bigint, columns int")


def executable_statements(spark, sf_dir):
    """Whether each of the four runs and returns a row."""
    register(spark, sf_dir, ("nation", "orders"))
    return spark.createDataFrame([(q["name"], query.executable(spark, q["sql"])[0]) for q in CHECKED], "name string, ok boolean")


def result_files(spark, sf_dir):
    """Results written as files, one of them an `error` row, and read again: header and rows."""
    register(spark, sf_dir, ("nation", "orders"))
    rows, base = [], _folder(spark)
    for q in CHECKED:
        done, _ = query.save_result(spark, q["sql"], f"{base}/{q['name']}")
        back = spark.read.csv(f"{base}/{q['name']}", header=True)
        rows.append((q["name"], done, len(back.columns), back.count()))
    return spark.createDataFrame(rows, "name string, success boolean, columns int, rows bigint")


# --- rows and texts ------------------------------------------------------------------------------------------------


def presence_filter(spark, sf_dir):
    """Stations with a name and a kind of water body; rows that repeat the header are none."""
    d = _t(spark, sf_dir, "dim_station").select(F.col("station_id").cast("string"), "station_name", "type_of_water_body")
    headed = d.unionByName(d.select(F.lit("station_id").alias("station_id"), F.lit("station_name").alias("station_name"), F.lit("kind").alias("type_of_water_body")))
    return tf.present(headed, ["station_name", "type_of_water_body"], ("station_name", "station_name"), 3)


def ordinal_columns(spark, sf_dir):
    """Columns by position, trimmed and renamed; a position beyond the row gives ''."""
    return tf.by_ordinal(_t(spark, sf_dir, "dim_station").select("station_id", "station_name", "type_of_water_body"), [(1, "name"), (0, "key"), (9, "none")])


def state_fields(spark, sf_dir):
    """Several fields by one key, with a default for the keys that the map lacks."""
    known = {"O": ("open", "1"), "F": ("finished", "2")}
    o = _t(spark, sf_dir, "orders").select(tf.lookup_fields(F.col("o_orderstatus"), known, ("status", "tier"), ("other", "9")).alias("x"))
    return o.groupBy("x.status", "x.tier").agg(F.count("*").alias("n"))


def stripped_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tf.cell_text(F.col("text")).alias("cell"))


def short_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tf.short_text(F.col("text")).alias("head"))


def word_bigrams(spark, sf_dir):
    """Pairs of neighbouring words of the statements' text."""
    t = _t(spark, sf_dir, "task_records").select("task_id", F.regexp_replace(F.lower(tf.text_of(F.col("sql"))), "[^a-z0-9_]+", " ").alias("s")).distinct()
    return t.select("task_id", F.array_join(tf.bigrams(tf.word_list(F.col("s"))), "|").alias("pairs"))


def distinct_columns(spark, sf_dir):
    """The first three distinct columns that each task uses, in their order."""
    t = _t(spark, sf_dir, "task_records").select("task_id", "schema_used").distinct()
    return t.select("task_id", F.array_join(tf.first_distinct(F.col("schema_used"), 3), ",").alias("columns")).distinct()


def prose_statements(spark, sf_dir):
    """Each task's statement found again in a sentence around it."""
    t = _t(spark, sf_dir, "task_records").filter("sql is not null").select("task_id", F.regexp_replace(F.trim("sql"), r"\s*;\s*\z", "").alias("s")).distinct()
    said = F.concat(F.lit("The SQL query that answers this is "), F.col("s"), F.lit(";\nIt counts all rows. SELECT nothing else."))
    return t.select("task_id", prose.statement_of(said).alias("statement")).distinct()


def prose_fields(spark, sf_dir):
    """A field of the JSON object inside prose with a fenced block."""
    p = _t(spark, sf_dir, "part")
    said = F.concat(F.lit("Here it is {draft}:\n```json\n"), F.to_json(F.struct("p_brand", F.struct("p_size").alias("more"))), F.lit("\n```\nDone."))
    return p.select("p_partkey", prose.json_field(said, "p_brand").alias("brand"), F.get_json_object(prose.json_field(said, "more"), "$.p_size").cast("int").alias("size"))


# --- profiling, joins, retrieval -----------------------------------------------------------------------------------


def csv_types(spark, sf_dir):
    """Types of the columns of `orders`, from its CSV."""
    path = _folder(spark)
    tables.write_csv(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.year("o_orderdate").alias("o_when")), path)
    return spark.createDataFrame(sorted(profile.infer_types(tables.wide_csv(spark, path)).items()), "column string, type string")


def simple_types(spark, sf_dir):
    """NUMBER, DATE or TEXT for the columns of `nation`, as a sample for prompts holds them."""
    sample = tables.table_sample(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")
    return spark.createDataFrame(list(zip(sample["column_names"], sample["column_types"])), "column string, type string")


def name_types(spark, sf_dir):
    """Types by the names of all columns of the benchmark's schemas."""
    return _t(spark, sf_dir, "schema_columns").select("column_name").distinct().select("column_name", profile.name_type(F.col("column_name")).alias("type"))


def prune_decisions(spark, sf_dir):
    return profile.prune_decisions(_t(spark, sf_dir, "schema_columns"), "db", "table_name")


def schema_merge(spark, sf_dir):
    """Fact tables whole, `dim_state` dropped, of other tables their keys and names: the columns left."""
    rows = _t(spark, sf_dir, "schema_columns").select("db", "table_name", "column_name").distinct().collect()  # metadata
    out = []
    for db in sorted({r.db for r in rows}):
        columns: dict[str, list[str]] = {}
        for r in sorted(rows, key=lambda r: r.column_name):
            if r.db == db:
                columns.setdefault(r.table_name, []).append(r.column_name)
        chosen = {t: "keep_all" if t.startswith("fact_") else "drop_all" if t == "dim_state" else [c for c in cs if c.endswith("_name")] + ["unknown_column"] for t, cs in columns.items()}
        keys = {t: [c for c in cs if c.endswith("_id")] for t, cs in columns.items()}
        out += [(db, t, c) for t, cs in profile.merge_selection(columns, chosen, keys).items() for c in cs]
    return spark.createDataFrame(out, "db string, table_name string, column_name string")


def prompt_values(spark, sf_dir):
    """Sample values for prompts of the columns of `dim_station` that may be shown."""
    d = _t(spark, sf_dir, "dim_station").select("station_id", F.col("station_code").cast("string"), "station_name", "type_of_water_body")
    found = profile.prompt_values(d, {"station_id": "BIGINT", "station_code": "DOUBLE PRECISION"})
    return spark.createDataFrame([(c, v) for c, vs in found.items() for v in vs], "column string, value string")


def administrative_places(spark, sf_dir):
    """Distinct states and stations over the tables that hold them."""
    given = {"dim_state": _t(spark, sf_dir, "dim_state"), "dim_station": _t(spark, sf_dir, "dim_station")}
    return catalog.distinct_places(given, {"state": ("state",), "station": ("station_name",)})


def required_evidence(spark, sf_dir):
    """Tasks that have evidence: the latest document of their pair, if it is usable."""
    d = _t(spark, sf_dir, "documents").filter("pair_id is not null").withColumn("evidence", F.col("text"))
    known = tables.evidence_map(d.withColumn("at", F.struct("added_at", "doc_id")), "at")
    return metrics.with_evidence(_t(spark, sf_dir, "task_records").select("task_id", "pair_id").distinct(), known, "pair_id", required=True)


def positional_zip(spark, sf_dir):
    """Customers and suppliers of equal place."""
    c, s = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "supplier").select("s_suppkey")
    return metrics.zip_by_position(c, s, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


def best_above(spark, sf_dir):
    """Per language and database the three best-scored pairs with 0.8 at least."""
    s = metrics.usable(_t(spark, sf_dir, "translation_scores")).groupBy("lang", "db", "pair_id").agg(F.max("comet_score").alias("score"))
    return retrieval.top_k(s, ["lang", "db"], "score", 3, ["pair_id"], 0.8).select("lang", "db", "pair_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def one_shot_pick(spark, sf_dir):
    """One task of another database for the database of the first task."""
    t = _t(spark, sf_dir, "task_records").select("task_id", "db").distinct()
    target = t.orderBy("task_id").first()["db"]
    return retrieval.one_shot(t, "db", target, "task_id").select("task_id", "db")


def ex_match_ordered(spark, sf_dir):
    """Places at which two orders of the orders give different rows."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    a = match.positions(match._kept(o.orderBy("o_orderpriority", "o_orderkey").select("o_orderkey"), False)).select("_i", F.col("c0").alias("gold"))
    b = match.positions(match._kept(o.orderBy("o_orderpriority", "o_custkey", "o_orderkey").select("o_orderkey"), False)).select("_i", F.col("c0").alias("pred"))
    return a.join(b, "_i").filter("gold <> pred").groupBy((F.floor(F.col("_i") / 100)).cast("bigint").alias("hundred")).agg(F.count("*").alias("n"), F.sum("gold").cast("bigint").alias("gold"), F.sum("pred").cast("bigint").alias("pred"))


DERIVED = StarSpec(
    dimensions=(TableSpec("DIM_SEGMENT", (ColumnSpec(0, "SEGMENT"),), (0,), "SEGMENT_ID", derived_columns=(ColumnSpec(None, "SMALL", "lowercase", "SEGMENT"), ColumnSpec(0, "AGAIN", "uppercase"))),),
    facts=(TableSpec("FACT_CUSTOMER", (ColumnSpec(1, "BALANCE"),), (), "FACT_CUSTOMER_ID", foreign_keys=(FkSpec("SEGMENT_ID", "DIM_SEGMENT", "SEGMENT_ID"),), derived_columns=(ColumnSpec(None, "WHOLE", "to_int", "BALANCE"),)),),
)


def derived_columns(spark, sf_dir):
    """A fact with a column worked out from another, and its dimension with two."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_pos"), "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"))
    built = normalize.split(c, DERIVED)
    both = built["FACT_CUSTOMER"].join(built["DIM_SEGMENT"], "SEGMENT_ID")
    return both.groupBy(F.col("SMALL").alias("small"), F.col("AGAIN").alias("again")).agg(F.count("*").alias("n"), F.sum(F.col("WHOLE").cast("bigint")).alias("whole"))


def sample_rows(spark, sf_dir):
    """The first rows by key, written as a JSON sample and read again."""
    path = f"{_folder(spark)}/nation.json"
    tables.sample_json(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"])
    back = tables.table_samples(spark, path)
    return back.select("table_name", (F.col("place") + 1).alias("place"), F.col("cells")["n_name"].alias("n_name"))


def markdown_rows(spark, sf_dir):
    lines = tables.markdown(_t(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")


def query_folder(spark, sf_dir):
    """Query files with their notes, written and read again."""
    folder = _folder(spark)
    for q in CHECKED:
        tables.write_text(f"{folder}/{q['name']}.sql", f"-- Complexity: {q['complexity']}\n-- Category: {q['category']}\n{q['sql']};\n")
    return spark.createDataFrame([(q["name"], q["complexity"], q["category"], q["sql"].strip().rstrip(";")) for q in tables.query_files(folder)], "name string, complexity string, category string, statement string")


def appended_results(spark, sf_dir):
    """Results written by the first batch and added to by the others."""
    path, e = _folder(spark), _t(spark, sf_dir, "evaluation_records").select("eval_id", "db", "em")
    for i in range(3):
        tables.append_results(e.filter(F.col("eval_id") % 3 == i), path, first=i == 0)
    return spark.read.schema("eval_id bigint, db string, em int").json(path).groupBy("db").agg(F.count("*").alias("n"), F.sum("em").alias("hits"))


def yaml_schema(spark, sf_dir):
    """Columns with types and keys from a YAML schema of three tables."""
    path, lines = f"{_folder(spark)}/schema.yaml", []
    for part, names in (("dimension_tables", ("region", "nation")), ("fact_tables", ("supplier",))):
        lines.append(f"{part}:")
        for n in names:
            key, *others = _t(spark, sf_dir, n).columns
            lines += [f"  {n}:", f"    key_column: {key}", "    columns:", *[f"      - {{target_name: {c}}}" for c in others]]
    tables.write_text(path, "\n".join(lines) + "\n")
    found = tables.schema_config(path)
    return spark.createDataFrame([(t.name.lower(), c.lower(), k, c in t.primary_key) for t in found.tables.values() for c, k in t.columns], "table_name string, column_name string, type string, is_key boolean")


def _linked(spark, sf_dir) -> SchemaInfo:
    """The order tables, each column that is named like another table's first column referring to it."""
    schema = _schema(spark, sf_dir, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    first = {t.columns[0][0].partition("_")[2]: t for t in schema.tables.values() if t.name != "lineitem"}
    for t in schema.tables.values():
        t.foreign_keys = [(c, to.name, to.columns[0][0]) for c, _ in t.columns if (to := first.get(c.partition("_")[2])) and to is not t]
    return schema


def reference_walk(spark, sf_dir):
    """Tables that `nation` reaches over references, either way."""
    return spark.createDataFrame([(t,) for t in catalog.walk(catalog.neighbours(_linked(spark, sf_dir)), "nation")], "table_name string")


def schema_statistics(spark, sf_dir):
    found = catalog.statistics(_linked(spark, sf_dir), {n: _t(spark, sf_dir, n).count() for n in ("region", "nation", "supplier")})
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


def _benchmark(spark, sf_dir) -> dict[str, SchemaInfo]:
    """The benchmark's schemas; keys of fact tables refer to the dimension with the same key."""
    out: dict[str, SchemaInfo] = {}
    for r in _t(spark, sf_dir, "schema_columns").distinct().orderBy("db", "table_name", "column_name").collect():  # metadata
        tables_ = out.setdefault(r.db, SchemaInfo(r.db)).tables
        tables_.setdefault(r.table_name, TableInfo(r.table_name, [])).columns.append((r.column_name, r.data_type))
    for schema in out.values():
        dims = {c: t.name for t in schema.tables.values() if t.name.startswith("dim_") for c, _ in t.columns if c == f"{t.name.removeprefix('dim_')}_id"}
        for t in schema.tables.values():
            t.foreign_keys = [(c, dims[c], c) for c, _ in t.columns if t.name.startswith("fact_") and c in dims]
    return out


def unsafe_statements(spark, sf_dir):
    """Columns of the benchmark's schemas whose mean may not be taken."""
    out = [(s.database, t.name, c) for s in _benchmark(spark, sf_dir).values() for t in s.tables.values() for c, _ in t.columns if synth.unsafe_uses(f"SELECT AVG(x.{c}) FROM {t.name} x", s)]
    return spark.createDataFrame(out, "db string, table_name string, column_name string")


def invalid_joins(spark, sf_dir):
    """Joins of two tables on a column of the same name that no reference covers."""
    out = []
    for s in _benchmark(spark, sf_dir).values():
        for a in s.tables.values():
            for b in s.tables.values():
                for c in {n for n, _ in a.columns} & {n for n, _ in b.columns} if a.name < b.name else ():
                    if catalog.invalid_joins(f"SELECT 1 FROM {a.name} x JOIN {b.name} AS y ON x.{c} = y.{c}", s):
                        out.append((s.database, a.name, b.name, c))
    return spark.createDataFrame(out, "db string, left_table string, right_table string, column_name string")


def own_transform(spark, sf_dir):
    """A transform registered under a name and used by it."""
    tf.register_transform("backwards", lambda c: F.reverse(tf.strip(tf.text_of(c))))
    return _t(spark, sf_dir, "nation").select("n_nationkey", tf.transformed(F.col("n_name"), "backwards").alias("name"))


def generated_texts(spark, sf_dir):
    """Texts that the stand-in model gives for each nation's prompt."""
    prompts = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Describe the nation "), "n_name").alias("prompt"))
    rules = [(r"nation (A\w*)", r"An early one: \1"), (r"nation (\w+)", r"\1 it is")]
    return synth.generate_column(prompts, "prompt", "answer", lambda: synth.Stub(rules)).select("n_nationkey", "answer")


class _Vowels:
    def encode(self, text: str) -> list[float]:
        return [text.count(v) for v in "aeo"]


def vector_similarity(spark, sf_dir):
    """Cosine of two names' vectors by an encoder that is handed in."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return retrieval.similarity(p, "a", "b", "score", _Vowels).select("p_partkey", F.round("score", 9).alias("score"))


def weighted_scores(spark, sf_dir):
    """Weighted lexical similarity of the words in Latin letters of each question and the one before it."""
    t = _t(spark, sf_dir, "task_records").filter("question is not null").groupBy("task_id").agg(F.min("question").alias("q"))
    t = t.select("task_id", F.regexp_replace(F.lower("q"), "[^a-z0-9_]+", " ").alias("q"))
    n = normalize.dense_numbers(t, ["task_id"], "place")
    pairs = n.join(n.select((F.col("place") + 1).alias("place"), F.col("q").alias("before")), "place")
    return pairs.select("task_id", F.round(retrieval.weighted_lexical(F.col("q"), F.col("before")), 9).alias("score"))


_NAMES = """sample_rows markdown_rows query_folder appended_results yaml_schema reference_walk schema_statistics unsafe_statements invalid_joins own_transform generated_texts vector_similarity weighted_scores csv_wide_scan csv_typed_scan csv_header ddl_scan json_lines_scan path_columns catalog_columns appended_rows validation_run executable_statements result_files presence_filter
ordinal_columns state_fields stripped_texts short_texts word_bigrams distinct_columns prose_statements prose_fields csv_types simple_types name_types prune_decisions schema_merge prompt_values
administrative_places required_evidence positional_zip best_above one_shot_pick ex_match_ordered derived_columns""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_WS = "E' \\t\\n\\r\\f\\x0B'"
_LISTED = "SELECT table_name, column_name, ordinal_position::INTEGER AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier')"
_MONEY_SQL = " OR ".join(f"contains(l, '{w}')" for w in profile.MONEY)
_GROUPED = "(SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders))"

_ORDER_TABLES = "('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')"
_EDGES = f"c AS (SELECT table_name AS t, column_name AS col, split_part(column_name, '_', 2) AS k, ordinal_position AS p FROM information_schema.columns WHERE table_name IN {_ORDER_TABLES}), e AS (SELECT a.t AS a, a.col, b.t AS b FROM c a JOIN c b ON a.k = b.k AND b.p = 1 AND b.t <> 'lineitem' AND a.t <> b.t)"
_LIST_SQL = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_JACCARD = lambda a, b: f"(CASE WHEN len(list_distinct({a} || {b})) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) ELSE 0 END)"

SQL = {
    "sample_rows": "SELECT 'nation' AS table_name, row_number() OVER (ORDER BY n_nationkey)::INTEGER AS place, n_name FROM nation ORDER BY n_nationkey LIMIT 5",
    "markdown_rows": "SELECT 0::BIGINT AS place, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
    "query_folder": " UNION ALL ".join(f"SELECT '{q['name']}' AS name, '{q['complexity']}' AS complexity, '{q['category']}' AS category, '{q['sql']}' AS statement" for q in CHECKED),
    "appended_results": "SELECT db, count(*) AS n, sum(em)::BIGINT AS hits FROM evaluation_records WHERE eval_id IS NOT NULL GROUP BY db",
    "yaml_schema": "SELECT table_name, column_name, CASE WHEN ordinal_position = 1 THEN 'BIGINT' WHEN ends_with(column_name, '_id') THEN 'BIGINT' WHEN contains(column_name, 'balance') THEN 'DOUBLE PRECISION' ELSE 'VARCHAR(255)' END AS type, ordinal_position = 1 AS is_key FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier')",
    "reference_walk": f"WITH RECURSIVE {_EDGES}, r(t) AS (SELECT 'nation' UNION SELECT CASE WHEN e.a = r.t THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.t OR e.b = r.t) SELECT t AS table_name FROM r",
    "schema_statistics": f"WITH {_EDGES} SELECT 'tables' AS name, count(DISTINCT t)::DOUBLE AS value FROM c UNION ALL SELECT 'columns', count(*) FROM c UNION ALL SELECT 'foreign_keys', count(*) FROM e UNION ALL SELECT 'fk_density', round((SELECT count(*) FROM e) / (SELECT count(DISTINCT t) FROM c), 2) UNION ALL SELECT 'rows', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)",
    "unsafe_statements": "SELECT DISTINCT db, table_name, column_name FROM schema_columns WHERE NOT regexp_matches(lower(data_type), '^(bigint|integer|int|smallint|double|numeric|decimal|real|float)')",
    "invalid_joins": "WITH c AS (SELECT DISTINCT db, table_name AS t, column_name AS c FROM schema_columns) SELECT a.db, a.t AS left_table, b.t AS right_table, a.c AS column_name FROM c a JOIN c b ON a.db = b.db AND a.c = b.c AND a.t < b.t WHERE NOT ((a.t LIKE 'fact!_%' ESCAPE '!' AND b.t = 'dim_' || regexp_replace(b.c, '_id$', '') AND ends_with(b.c, '_id')) OR (b.t LIKE 'fact!_%' ESCAPE '!' AND a.t = 'dim_' || regexp_replace(a.c, '_id$', '') AND ends_with(a.c, '_id')))",
    "own_transform": "SELECT n_nationkey, reverse(trim(n_name)) AS name FROM nation",
    "generated_texts": "SELECT n_nationkey, CASE WHEN n_name ILIKE 'a%' THEN 'An early one: ' || regexp_extract(n_name, '^\\w+') ELSE regexp_extract(n_name, '^\\w+') || ' it is' END AS answer FROM nation",
    "vector_similarity": "WITH v AS (SELECT p_partkey, " + ", ".join(f"length({c}) - length(replace({c}, '{x}', '')) AS {n}{x}" for n, c in (("a", "lower(p_name)"), ("b", "lower(p_type)")) for x in "aeo") + " FROM part) SELECT p_partkey, round(CASE WHEN (aa + ae + ao) > 0 AND (ba + be + bo) > 0 THEN (aa * ba + ae * be + ao * bo) / (sqrt(aa * aa + ae * ae + ao * ao) * sqrt(ba * ba + be * be + bo * bo)) ELSE 0 END, 9) AS score FROM v",
    "weighted_scores": f"WITH t AS (SELECT task_id, list_filter(regexp_split_to_array(lower(min(question)), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM task_records WHERE question IS NOT NULL GROUP BY task_id), u AS (SELECT task_id, w, list_filter(w, lambda x: NOT list_contains({_LIST_SQL(retrieval.STOP_WORDS)}, x)) AS c, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM t), d AS (SELECT *, list_filter(c, lambda x: list_contains({_LIST_SQL(retrieval.DOMAIN_WORDS)}, x)) AS d FROM u), p AS (SELECT *, lag(c) OVER o AS c2, lag(d) OVER o AS d2, lag(g) OVER o AS g2 FROM d WINDOW o AS (ORDER BY task_id)) SELECT task_id, round(CASE WHEN len(c) = 0 OR len(c2) = 0 THEN 0 WHEN len(d) + len(d2) > 0 THEN 0.4 * {_JACCARD('c', 'c2')} + 0.35 * {_JACCARD('d', 'd2')} + 0.25 * {_JACCARD('g', 'g2')} ELSE (0.4 * {_JACCARD('c', 'c2')} + 0.25 * {_JACCARD('g', 'g2')}) / 0.65 END, 9)::DOUBLE AS score FROM p WHERE c2 IS NOT NULL",
    "csv_wide_scan": "SELECT CAST(station_id AS VARCHAR) AS station_id, coalesce(CAST(state_id AS VARCHAR), '') AS state_id, coalesce(station_name, '') AS station_name, coalesce(type_of_water_body, '') AS type_of_water_body FROM dim_station",
    "csv_typed_scan": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, nullif(s_name, '') AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "csv_header": "SELECT ordinal_position::INTEGER AS ordinal_position, column_name FROM information_schema.columns WHERE table_name = 'customer'",
    "ddl_scan": _LISTED,
    "catalog_columns": _LISTED,
    "json_lines_scan": "SELECT difficulty, skeleton_id, count(*) AS n, count(sql) AS statements, coalesce(sum(len(schema_used)), 0)::BIGINT AS columns_used FROM task_records GROUP BY 1, 2",
    "path_columns": "SELECT DISTINCT eval_id, db, replace(replace(replace(model, '/', '_'), '-', '_'), '.', '_') AS model, lower(lang) AS language, strftime(run_at, '%Y%m%d_%H%M%S') AS timestamp FROM evaluation_records WHERE db IS NOT NULL AND model IS NOT NULL AND lang IS NOT NULL",
    "appended_rows": "SELECT count(*) AS n, count(nullif(station_name, '')) AS names, count(station_code) AS codes, sum(station_id)::BIGINT AS ids FROM dim_station",
    "validation_run": f"SELECT 'nations' AS name, true AS success, (SELECT count(*) FROM nation) AS rows, 2 AS columns UNION ALL SELECT 'grouped', true, {_GROUPED}, 3 UNION ALL SELECT 'none', true, (SELECT count(*) FROM nation WHERE n_nationkey < 0), 1 UNION ALL SELECT 'broken', false, NULL, NULL",
    "executable_statements": f"SELECT 'nations' AS name, (SELECT count(*) FROM nation) > 0 AS ok UNION ALL SELECT 'grouped', {_GROUPED} > 0 UNION ALL SELECT 'none', (SELECT count(*) FROM nation WHERE n_nationkey < 0) > 0 UNION ALL SELECT 'broken', false",
    "result_files": f"SELECT 'nations' AS name, true AS success, 2 AS columns, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'grouped', true, 3, {_GROUPED} UNION ALL SELECT 'none', true, 1, (SELECT count(*) FROM nation WHERE n_nationkey < 0) UNION ALL SELECT 'broken', false, 1, 1",
    "presence_filter": f"SELECT CAST(station_id AS VARCHAR) AS station_id, station_name, type_of_water_body FROM dim_station WHERE trim(coalesce(station_name, ''), {_WS}) NOT IN ('', 'station_name') AND trim(coalesce(type_of_water_body, ''), {_WS}) <> ''",
    "ordinal_columns": f"SELECT trim(coalesce(station_name, ''), {_WS}) AS name, CAST(station_id AS VARCHAR) AS key, '' AS none FROM dim_station",
    "state_fields": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'other' END AS status, CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '2' ELSE '9' END AS tier, count(*) AS n FROM orders GROUP BY 1, 2",
    "stripped_texts": f"SELECT doc_id, trim(text, {_WS}) AS cell FROM documents",
    "short_texts": "SELECT doc_id, left(text, 100) AS head FROM documents",
    "word_bigrams": "WITH w AS (SELECT DISTINCT task_id, list_filter(regexp_split_to_array(lower(coalesce(sql, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM task_records) SELECT task_id, array_to_string(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs FROM w",
    "distinct_columns": "SELECT DISTINCT task_id, array_to_string(list_filter(schema_used, lambda x, i: list_position(schema_used, x) = i)[1:3], ',') AS columns FROM task_records",
    "prose_statements": "SELECT DISTINCT task_id, regexp_replace(trim(sql), '\\s*;\\s*$', '') AS statement FROM task_records WHERE sql IS NOT NULL",
    "prose_fields": "SELECT p_partkey, p_brand AS brand, p_size::INTEGER AS size FROM part",
    "csv_types": "SELECT 'o_orderkey' AS \"column\", CASE WHEN max(o_orderkey) <= 1 THEN 'SMALLINT' WHEN max(o_orderkey) BETWEEN 1900 AND 2100 THEN 'INTEGER' ELSE 'BIGINT' END AS type FROM orders UNION ALL SELECT 'o_totalprice', 'DOUBLE PRECISION' FROM orders HAVING count(o_totalprice) > 0 UNION ALL SELECT 'o_orderstatus', CASE WHEN max(length(o_orderstatus)) * 1.2 + 10 <= 20 THEN 'VARCHAR(20)' ELSE 'other' END FROM orders UNION ALL SELECT 'o_orderdate', CASE WHEN count(o_orderdate) > 0 THEN 'DATE' END FROM orders UNION ALL SELECT 'o_when', CASE WHEN max(year(o_orderdate)) BETWEEN 1900 AND 2100 THEN 'INTEGER' ELSE 'BIGINT' END FROM orders",
    "simple_types": "SELECT column_name AS \"column\", CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'NUMBER' ELSE 'TEXT' END AS type FROM information_schema.columns WHERE table_name = 'nation' AND column_name IN ('n_nationkey', 'n_name', 'n_regionkey')",
    "name_types": f"SELECT column_name, CASE WHEN ends_with(l, '_id') OR l = 'id' THEN 'BIGINT' WHEN contains(l, 'year') THEN 'INTEGER' WHEN contains(l, 'is_') OR contains(l, 'has_') OR contains(l, 'flag') THEN 'SMALLINT' WHEN {_MONEY_SQL} THEN 'DOUBLE PRECISION' ELSE 'VARCHAR(255)' END AS type FROM (SELECT DISTINCT column_name, lower(column_name) AS l FROM schema_columns)",
    "prune_decisions": "SELECT db, count(*) AS columns, count(*) / count(DISTINCT table_name) <= 6 AND count(*) <= 30 AS keep_all FROM schema_columns GROUP BY db",
    "schema_merge": "SELECT DISTINCT db, table_name, column_name FROM schema_columns WHERE starts_with(table_name, 'fact_') OR (table_name <> 'dim_state' AND (ends_with(column_name, '_name') OR ends_with(column_name, '_id')))",
    "prompt_values": "WITH v AS (SELECT 'station_code' AS c, CAST(station_code AS VARCHAR) AS v FROM dim_station UNION ALL SELECT 'station_name', station_name FROM dim_station UNION ALL SELECT 'type_of_water_body', type_of_water_body FROM dim_station), r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS rn FROM v WHERE v IS NOT NULL GROUP BY c, v), ok AS (SELECT c FROM r WHERE rn <= 11 GROUP BY c HAVING NOT bool_or(length(trim(v)) > 50 OR (contains(v, '@') AND contains(v, '.')) OR contains(v, 'http://') OR contains(v, 'https://'))) SELECT c AS \"column\", v AS value FROM r WHERE rn <= 6 AND c IN (SELECT c FROM ok)",
    "administrative_places": "SELECT 'state' AS level, count(DISTINCT upper(trim(state))) AS n FROM dim_state WHERE trim(state) <> '' UNION ALL SELECT 'station', count(DISTINCT upper(trim(station_name))) FROM dim_station WHERE trim(station_name) <> ''",
    "required_evidence": "WITH l AS (SELECT pair_id, text AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY added_at DESC, doc_id DESC) AS rn FROM documents WHERE pair_id IS NOT NULL) WHERE rn = 1) SELECT DISTINCT t.task_id, t.pair_id, l.evidence FROM task_records t JOIN l ON t.pair_id = l.pair_id WHERE l.evidence IS NOT NULL AND trim(l.evidence) <> '' AND lower(trim(l.evidence)) <> 'false;'",
    "positional_zip": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS z FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS z FROM supplier) USING (z)",
    "best_above": "WITH g AS (SELECT lang, db, pair_id, max(comet_score) AS score FROM translation_scores WHERE comet_score IS NOT NULL AND NOT isnan(comet_score) AND lang IS NOT NULL AND lower(lang) <> 'unknown' GROUP BY 1, 2, 3) SELECT lang, db, pair_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, db ORDER BY score DESC, pair_id) AS rank FROM g WHERE score >= 0.8) WHERE rank <= 3",
    "one_shot_pick": "SELECT task_id, db FROM (SELECT DISTINCT task_id, db FROM task_records) WHERE db <> (SELECT arg_min(db, task_id) FROM task_records) ORDER BY md5('7|' || task_id), task_id LIMIT 1",
    "ex_match_ordered": "WITH a AS (SELECT o_orderkey AS gold, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS i FROM orders), b AS (SELECT o_orderkey AS pred, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) - 1 AS i FROM orders) SELECT (i // 100)::BIGINT AS hundred, count(*) AS n, sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred FROM a JOIN b USING (i) WHERE gold <> pred GROUP BY 1",
    "derived_columns": "SELECT lower(c_mktsegment) AS small, upper(c_mktsegment) AS again, count(*) AS n, sum(trunc(CAST(c_acctbal AS DECIMAL(18,2))))::BIGINT AS whole FROM customer GROUP BY 1, 2",
}
