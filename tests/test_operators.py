"""Transforms, splitting, profiling, metrics, retrieval, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from starloom.functions import transforms as tf
from starloom.model import StarSpec
from starloom.operators import metrics, normalize, profile, retrieval
from starloom.sources import tables
from starloom.streaming import evaluations

from conftest import rows


def one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")
    return [r[0] for r in df.select(make(F.col("v")).alias("o")).collect()]


def test_transforms(spark):
    assert one(spark, ["x", " NA ", None, "-", "", "none", "0"], tf.is_valid) == [True, False, False, False, False, False, True]
    assert one(spark, ["Calendar 2001, 1999", "12", None], tf.extract_year) == ["2001", "", ""]
    assert one(spark, ["x 1831 2011", "abc "], tf.extract_year_19_20) == ["2011", "abc"]
    assert one(spark, ["1.9", "-1.9", "1e5", "nan", "inf", "1d", "1_000", "x", None, " 7 "], tf.to_int) == ["1", "-1", "100000", "", "", "", "1000", "", "", "7"]
    assert one(spark, ["100000000", "1e16", "2", "x"], tf.to_float) == ["100000000.0", "1e+16", "2.0", ""]
    assert one(spark, ["2.675", "0.125", "3", "x"], tf.clean_numeric) == ["2.67", "0.12", "3.0", ""]
    assert one(spark, ["1,234.567", "10.00", "-", "100", "0.10"], tf.clean_amount) == ["1234.57", "10", "", "100", "0.1"]
    assert one(spark, ["O", "X", None], lambda c: tf.lookup(c, {"O": "open"}, "other")) == ["open", "other", "other"]
    assert one(spark, ["```sql\nSELECT 1\n```", "SQL: SELECT 2", None], tf.extract_sql) == ["SELECT 1", "SELECT 2", ""]
    assert one(spark, ["A EASY one", "NON-NESTED", "NESTED", ""], tf.label_of) == ["EASY", "NON-NESTED", "NESTED", "NESTED"]
    assert one(spark, ["Ab-c 1", "हिंदी", None], tf.ascii_tokens) == [["ab", "c", "1"], [], []]
    assert one(spark, ["हिंदी में"], tf.unicode_tokens) == [["हिंदी", "में"]]
    assert one(spark, ["a b c", "a", ""], lambda c: tf.bigrams(tf.word_list(c))) == [["a b", "b c"], [], []]
    assert one(spark, [1285, 12, -2], lambda c: F.concat_ws("/", *[x.cast("string") for x in tf.century_month(c).values()]), "int") == ["2007/1", "1900/12", ""]
    p = "x/eval_files_oneshot_qwen_8b/DB_A_text2sql_20260312_003121_tamil_evaluated.jsonl"
    assert one(spark, [p], lambda c: F.concat_ws(";", *tf.path_parts(c).values())) == ["DB_A;qwen_8b;tamil;20260312_003121"]


CONFIG = {
    "dimension_tables": {
        "DIM_STATE": {"key_column": "STATE_ID", "columns": [{"source_index": 0, "target_name": "STATE", "transform": "uppercase"}], "dedup_columns": [0]},
        "DIM_STATION": {"key_column": "STATION_ID", "columns": [{"source_index": 1, "target_name": "STATION"}], "dedup_columns": [1], "foreign_keys": [{"column": "STATE_ID", "references": "DIM_STATE"}]},
        "DIM_TIME": {"key_column": "YEAR", "key_source_index": 2, "key_transform": "extract_year", "columns": [{"source_index": 2, "target_name": "LABEL"}], "dedup_columns": [2], "derived_columns": [{"target_name": "Y2", "source_column": "LABEL", "transform": "extract_year"}]},
    },
    "fact_tables": {"FACT": {"key_column": "FACT_ID", "columns": [{"source_index": 3, "target_name": "V"}], "foreign_keys": [{"column": "STATION_ID", "references": "DIM_STATION"}, {"column": "YEAR", "references": "DIM_TIME"}]}},
}


def test_split(spark):
    spec = StarSpec.from_config(CONFIG)
    assert spec.errors(["a"] * 4) == [] and spec.errors(["a"])
    cells = [("Goa", "A|1", "Year 2001", "1"), ("Goa", "A|1", "Year 2002", "2"), ("Bihar", "A|1", "none yet", "3"), ("Goa", "B", "Year 2001", "NA"), ("Goa", "B", "Year 2001", "4"), ("Goa", "", "Year 2001", "5")]
    wide = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "_pos long, `s t` string, station string, year string, v string")
    out = normalize.split(wide, spec)
    assert rows(out["DIM_STATE"]) == [("1", "GOA"), ("2", "BIHAR")]
    # the same name in two states is two stations
    assert rows(out["DIM_STATION"]) == [("1", "1", "A|1"), ("2", "2", "A|1"), ("3", "1", "B")]
    # an invalid natural key falls back to the counter
    assert rows(out["DIM_TIME"]) == [("2001", "Year 2001", "2001"), ("2002", "Year 2002", "2002"), ("3", "none yet", "")]
    assert rows(out["FACT"]) == [("1", "1", "2001", "1"), ("2", "1", "2002", "2"), ("3", "2", "3", "3"), ("4", "3", "2001", "4")]
    assert "Y2" not in normalize.split(wide, spec, strict_reference=True)["DIM_TIME"].columns
    back = normalize.rejoin(out, spec, "FACT").select("STATION", "LABEL", "V")
    assert rows(back) == sorted([(c[1], c[2], c[3]) for c in cells if c[3] != "NA" and c[1]], key=str)


def test_dense_numbers_are_dense(spark):
    values = random.Random(1).sample(range(10_000), 500)
    out = normalize.dense_numbers(spark.createDataFrame([(v,) for v in values], "k long"), ["k"], "n").orderBy("k").collect()
    assert [r.n for r in out] == list(range(1, 501))


def test_hierarchy_and_unpivot(spark):
    h = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 77)], "k int, p int")
    assert rows(normalize.hierarchy(h, "k", "p")) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (9, 9, 1)]
    u = spark.createDataFrame([(1, "5", None), (2, " ", "6")], "i int, a string, b string")
    assert rows(normalize.unpivot(u, ["i"], ["a", "b"], "m", "v")) == [(1, "a", "5"), (2, "b", "6")]


def test_hierarchy_of_any_depth(spark):
    """A chain of 50 levels under one root; a cycle with a node below it is an error, and so is one that a repeated key hangs on a root."""
    chain = [(1, None), *((i, i - 1) for i in range(2, 51))]
    assert sorted(map(tuple, normalize.hierarchy(spark.createDataFrame(chain, "k int, p int"), "k", "p").collect())) == [(i, 1, i) for i in range(1, 51)]
    with pytest.raises(ValueError):
        normalize.hierarchy(spark.createDataFrame([*chain[:3], (60, 61), (61, 60), (62, 61)], "k int, p int"), "k", "p")
    with pytest.raises(ValueError):
        normalize.hierarchy(spark.createDataFrame([(1, None), (1, 2), (2, 1)], "k int, p int"), "k", "p", often=3)


TYPES = {
    "X_ID": (["a"], "BIGINT"), "THIS_ONE": (["a"], "SMALLINT"), "BIRTH_YEAR": (["Calendar 2001"], "INTEGER"), "AMOUNT": (["5"], "DOUBLE PRECISION"), "B": (["0", "1"], "SMALLINT"), "Y": (["1950", "2011"], "INTEGER"),
    "TOTAL_N": (["5", "7000"], "DOUBLE PRECISION"), "N": (["5", "7000"], "BIGINT"), "F": (["1.5"], "DOUBLE PRECISION"), "NEG": (["-1", "0"], "BIGINT"), "E": (["1e5"], "BIGINT"), "NANS": (["nan"], "VARCHAR(20)"),
    "D": (["2001-02-03 x"], "DATE"), "S8": (["a" * 8], "VARCHAR(20)"), "S75": (["a" * 75], "VARCHAR(100)"), "S900": (["a" * 900], "TEXT"), "EMPTY": (["", None], "VARCHAR(255)"),
}


def test_type_inference(spark):
    n = max(len(v) for v, _ in TYPES.values())
    data = [tuple(v[i] if i < len(v) else "" for v, _ in TYPES.values()) for i in range(n)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in TYPES))
    assert profile.infer_types(df) == {c: t for c, (_, t) in TYPES.items()}
    assert profile.infer_from_name("flag_year") == "INTEGER" and profile.key_type("YEAR") == "INTEGER"


def test_profile_helpers(spark):
    df = spark.createDataFrame([("Goa", 1), ("Goa", 2), ("Bihar", None), (None, 4)], "s string, n int")
    assert rows(profile.frequent_values(df, "s", 1)) == [("Goa", 2)]
    assert rows(profile.nearest_values(spark.createDataFrame([("Gao",)], "w string"), "w", df, "s"))[0][:2] == ("Gao", "Goa")
    assert profile.keep_all_columns({"a": ["x"] * 6}) and not profile.keep_all_columns({"a": ["x"] * 7})
    assert profile.merge_selection({"a": ["k", "x", "y"], "b": ["k"]}, {"a": ["x", "zz"], "b": "drop_all"}, {"a": ["k"]}) == {"a": ["k", "x"]}
    assert "s" in profile.prompt_values(df, {"s": "VARCHAR(20)"})


def test_metrics(spark):
    e = spark.createDataFrame([("f1", 1, 1), ("f1", 0, 1), ("f1", 0, 0), ("f2", 1, 1)], "f string, em int, ex int").withColumn("em_new", F.col("em"))
    files = metrics.summarize_files(e, ["f"]).withColumn("g", F.lit(1))
    m = metrics.macro_micro(files, ["g"], ["ex_mean"]).first()
    assert round(m.macro_ex_mean, 6) == round((2 / 3 + 1) / 2, 6) and m.micro_ex_mean == 0.75
    assert rows(metrics.counts_text(e, ["f"])) == [("f1", "1/3", "2/3"), ("f2", "1/1", "1/1")]
    assert rows(metrics.latest(spark.createDataFrame([(1, 5, "a"), (1, 6, None), (2, None, "c")], "k int, t int, v string"), ["k"], ["t"])) == [(1, 6, None), (2, None, "c")]
    s = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", 7.0)] * 3 + [("Unknown", 1.0), (None, 1.0), ("a", None), ("a", float("nan"))], "lang string, comet_score double")
    audit = metrics.percentile_audit(metrics.usable(s), "lang", "comet_score")
    assert [(r.lang, r.n, r.tau) for r in audit.orderBy("lang").collect()] == [("a", 5, 1.8), ("b", 3, 7.0)]
    assert metrics.flagged(s, audit, "lang", "comet_score").count() == 4
    # constant scores: no spread, the first point is the knee
    k = metrics.knee(metrics.sensitivity(s.filter("lang = 'b'"), "comet_score"), "k", "rate").first()
    assert (k.k, k.distance) == (0.5, 0.0)
    keys = metrics.sample_keys(s.withColumn("id", F.monotonically_increasing_id()), "id", 3)
    assert keys.count() == 3 and rows(keys) == rows(metrics.sample_keys(s.withColumn("id", F.monotonically_increasing_id()), "id", 3))
    z = metrics.zip_by_position(spark.createDataFrame([(3, "c"), (1, "a")], "i int, x string"), spark.createDataFrame([(9, "z"), (8, "y")], "j int, w string"), "i", "j")
    assert sorted((r.x, r.w) for r in z.collect()) == [("a", "y"), ("c", "z")]


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    top = retrieval.cosine_top_k(v.filter("id = 1"), v, "id", "v", 2)
    assert [(r.id, r.rank) for r in top.orderBy("rank").collect()] == [(2, 1), (3, 2)]
    q = spark.createDataFrame([("a b", "a b"), ("population of state", "state population total")], "x string, y string")
    strict, sane = [[r[0] for r in q.select(retrieval.weighted_lexical(F.col("x"), F.col("y"), s)).collect()] for s in (True, False)]
    assert strict[0] == 0.65 and sane[0] == 1.0 and strict[1] == sane[1]
    t = spark.createDataFrame([(1, "d", "list the villages near goa with many wells now", "select 1 from t"), (2, "d", "list the villages near goa with many wells now", "select 1 from t"), (3, "e", "list the villages near goa with many wells now", "select 1 from t"), (4, "d", "something else", "select 2")], "id int, db string, q string, s string")
    assert rows(retrieval.near_duplicates(t, "db", "id", "q", "s")) == [(2,)]
    assert retrieval.near_duplicates(t.limit(0), "db", "id", "q", "s").count() == 0
    assert retrieval.greedy_duplicates([(1,), (1,), (2,)], lambda a, b: float(a == b)) == [(1,), (2,)]
    assert retrieval.schema_values("wells in 'Goa'", [("t", "wells"), ("t", "x")], 1) == [("t", "wells", "Goa")]


def test_near_duplicates_of_dropped_pairs_stay(spark):
    """Texts of 60 words, each shifted by one word, are near their two neighbours only."""
    text = lambda at: " ".join(f"w{i}" for i in range(at, at + 60))
    near = lambda a, b: float(abs(a[1] - b[1]) <= 1)
    for order in ([0, 1, 2], [4, 1, 0, 3, 2, 7, 6, 5, 8]):
        pairs = list(enumerate(order))
        dropped = sorted((i,) for i, _ in set(pairs) - set(retrieval.greedy_duplicates(pairs, near)))
        t = spark.createDataFrame([(i, "d", text(at), "select 1 from t") for i, at in pairs], "id int, db string, q string, s string")
        assert rows(retrieval.near_duplicates(t, "db", "id", "q", "s")) == dropped


def test_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,b,b\n1,"x, ""y""",\n2,"two\nlines"\n')
    w = tables.wide_csv(spark, str(tmp_path / "w.csv"))
    assert rows(w) == [("1", 'x, "y"', ""), ("2", "two\nlines", "")]
    (tmp_path / "t.jsonl").write_text(json.dumps({"pair_id": "p", "sql": "SELECT 1", "schema_used": ["a"]}) + "\n\n")
    assert tables.tasks(spark, str(tmp_path / "t.jsonl")).first().gold_sql == "SELECT 1"
    folder = tmp_path / "eval_files_oneshot_m"
    folder.mkdir()
    (folder / "DB_text2sql_20260101_000000_hindi_evaluated.jsonl").write_text(json.dumps({"pair_id": "p", "sql": "S", "em": 1, "ex": 0}) + "\n")
    r = tables.evaluation_files(spark, str(tmp_path)).first()
    assert (r.db, r.model, r.language, r.gold_sql) == ("DB", "m", "hindi", "S")
    tables.write_csv(w, str(tmp_path / "out"), single=True)
    assert rows(tables.wide_csv(spark, str(tmp_path / "out")))[0] == ("1", 'x, "y"', "")
    tables.sample_json(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), str(tmp_path / "s.json"), ["k"], 1)
    assert json.loads((tmp_path / "s.json").read_text()) == [{"k": 1, "v": "a"}]
    assert tables.table_sample(spark.createDataFrame([(3.0, "x")], "n double, s string"), "t")["sample_rows"] == [{"n": 3, "s": "x"}]
    (tmp_path / "DDL.csv").write_text('table_name,description,DDL\nt,"a table","CREATE TABLE t (a BIGINT, b VARCHAR(9), PRIMARY KEY (a));"\n')
    schema = tables.ddl_csv(str(tmp_path / "DDL.csv"))
    assert schema.tables["t"].description == "a table"
    (tmp_path / "t.csv").write_text("a,b\n1,\nx,y\n")
    assert rows(tables.table_csv(spark, str(tmp_path / "t.csv"), schema.tables["t"])) == [(1, None), (None, "y")]
    assert "| a | b |" in tables.markdown(spark.createDataFrame([(1, None)], "a int, b string"))


def test_stream(spark, tmp_path):
    folder = tmp_path / "in" / "eval_files_oneshot_m"
    folder.mkdir(parents=True)
    write = lambda i: (folder / f"DB_text2sql_2026010{i}_000000_hindi_evaluated.jsonl").write_text(json.dumps({"pair_id": str(i), "em": i % 2, "ex": 1}) + "\n")
    write(1)
    for n in (1, 2):
        q = evaluations.append_rows(evaluations.evaluation_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        write(n + 1)
    assert evaluations.running_metrics(spark.read.parquet(str(tmp_path / "out")), ["model"]).first().rows == 2


@pytest.mark.parametrize("name", ["literacy_rate", "census_q13", "fact_fk_resolution", "percentile_tau_audit", "p1_found"])
def test_registered_queries_match_duckdb(spark, data, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    import glob
    import os

    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, data)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    norm = lambda v: round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    assert sorted((tuple(map(norm, r)) for r in got.select(*names).collect()), key=str) == sorted((tuple(map(norm, r)) for r in cursor.fetchall()), key=str)


def test_examples_score_few_pairs_and_lose_none(spark, monkeypatch):
    """Texts of shared words in all degrees of likeness: the answers are those of all pairs, and few pairs are scored."""
    rng, scored, of = random.Random(3), [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda pairs, *a: scored.append(pairs.count()) or of(pairs, *a))
    rows = []
    for i in range(600):
        words = [f"all{x}" for x in range(8)] + [f"g{i // 6}x{x}" for x in range(12)] + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 6))]
        rng.shuffle(words)
        rows.append((i, None if i % 97 == 0 else f"d{rng.randrange(4)}", " ".join(words[: rng.choice([3, 18, 25])])))
    rows += [(700, "d1", ""), (701, "d2", None), (702, "d9", "ALL1 own"), (703, "d9", "only here")]
    pool = spark.createDataFrame(rows, "id long, db string, q string")
    target = spark.createDataFrame([r for r in rows if r[0] % 5 == 0 or r[0] > 699] + [(900, "d1", "all1 of no number"), (901, "d1", "nothing known")], "id long, db string, q string")
    got = sorted((r.target_id, r.id, r.rank, r.score) for r in retrieval.examples(target, pool, "db", "q", "id", 3).collect())
    sets, expected = {r.id: (r.db, set((r.q or "").lower().split())) for r in pool.collect() + target.collect()}, []
    for t in target.collect():
        (d, a), found = sets[t.id], []
        for i, *_ in rows:
            e, b = sets[i]
            if d and e and d != e and a & b:
                found.append((-round(len(a & b) / len(a | b), 9), i))
        expected += [(t.id, i, n, -s) for n, (s, i) in enumerate(sorted(found)[:3], 1)]
    assert got == sorted(expected)
    assert sum(scored[:-1]) < 20_000 and len(scored) == 5
