"""Dialect, catalogue, matching and query runs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom import catalog, match, query, synth
from starloom.dialect import statements, strip_comment_lines, to_spark
from starloom.model import SchemaInfo


@pytest.mark.parametrize(
    ("pg", "spark_sql"),
    [
        ('SELECT "a" FROM t', "SELECT `a` FROM t"), ("SELECT x::text, CAST(y AS double precision)", "SELECT x::string, CAST(y AS double)"), ("SELECT z::numeric", "SELECT z::decimal(38,18)"), ("SELECT z::numeric(10,2)", "SELECT z::decimal(10,2)"),
        ("SELECT a FROM t ORDER BY a, b DESC", "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST"), ("SELECT a FROM t ORDER BY a NULLS FIRST", "SELECT a FROM t ORDER BY a NULLS FIRST"),
        ("SELECT rank() OVER (PARTITION BY b ORDER BY f(a, c) DESC) FROM t", "SELECT rank() OVER (PARTITION BY b ORDER BY f(a, c) DESC NULLS FIRST) FROM t"), ("SELECT a FROM t ORDER BY a FETCH FIRST 3 ROWS ONLY", "SELECT a FROM t ORDER BY a NULLS LAST LIMIT 3"),
        ("SELECT 'order by a::text' FROM information_schema.tables;", "SELECT 'order by a::text' FROM information_schema_tables"), ("SELECT a -- order by b\nFROM t", "SELECT a -- order by b\nFROM t"),
    ],
)
def test_dialect(pg, spark_sql):
    assert to_spark(pg) == spark_sql


def test_integer_division_is_opt_in():
    assert to_spark("SELECT 7 / 2") == "SELECT 7 / 2"
    assert "div" in to_spark("SELECT 7 / 2", integer_division=True)


def test_scripts():
    assert statements("SELECT ';'; -- a;b\nSELECT 2;;") == ["SELECT ';'", "-- a;b\nSELECT 2"]
    assert strip_comment_lines("-- Complexity: 3\n-- Category: x y\nSELECT 1;") == ("SELECT 1", {"complexity": "3", "category": "x y"})


@given(st.lists(st.sampled_from(["a", "'x;y'", ";", " ", "--c\n", "(", ")", '"q"', "1.5"]), max_size=30))
@settings(max_examples=60, deadline=None)
def test_rewriting_never_fails_and_keeps_strings(parts):
    text = " ".join(parts)
    assert to_spark(text).count("'x;y'") == text.strip().rstrip(";").count("'x;y'")


DDL = """DROP TABLE IF EXISTS dim_state CASCADE; CREATE TABLE dim_state (state_id BIGINT PRIMARY KEY, state VARCHAR(50));
CREATE TABLE dim_station (station_id BIGINT, state_id BIGINT REFERENCES dim_state(state_id), name TEXT, PRIMARY KEY (station_id));
CREATE TABLE fact (fact_id BIGINT, station_id BIGINT, v DOUBLE PRECISION, PRIMARY KEY (fact_id), FOREIGN KEY (station_id) REFERENCES dim_station(station_id)); CREATE TABLE lone (x INTEGER)"""


def schema() -> SchemaInfo:
    return catalog.parse_script(DDL, "db")


def test_catalog():
    s = schema()
    assert {t.name: t.primary_key for t in s.tables.values()} == {"dim_state": ["state_id"], "dim_station": ["station_id"], "fact": ["fact_id"], "lone": ["x"]}
    assert s.edges() == [("dim_station", "state_id", "dim_state", "state_id"), ("fact", "station_id", "dim_station", "station_id")]
    assert catalog.components(s) == [{"dim_state", "dim_station", "fact"}, {"lone"}]
    again = catalog.parse_script("\n".join(catalog.create_table(t) for t in s.tables.values()))
    assert again.edges() == s.edges()
    assert catalog.sync_foreign_keys(s, [("lone", "station_id", "dim_station", "station_id")]) and not catalog.sync_foreign_keys(s, [("lone", "station_id", "dim_station", "station_id")])
    assert len(catalog.constraint_name("fk", "a" * 60, "b" * 60)) == 63
    with pytest.raises(ValueError):
        catalog.sync_foreign_keys(s, [("lone", "x; drop", "fact", "fact_id")])
    assert catalog.invalid_joins("SELECT 1 FROM fact f JOIN dim_station s ON f.station_id = s.station_id JOIN dim_state d ON f.v = d.state_id", s) == [("fact", "v", "dim_state", "state_id")]
    assert catalog.statistics(s)["tables"] == 4


def test_checks_and_views(spark):
    views = catalog.information_schema(spark, schema())
    assert spark.sql(to_spark("SELECT count(*) FROM information_schema.columns")).first()[0] == views["columns"].count() == 9
    df = spark.createDataFrame([(1, 5), (1, None), (None, 6)], "k int, p int")
    assert [tuple(r) for r in catalog.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert catalog.null_keys(df, ["k", "p"]).count() == 2
    assert [r.p for r in catalog.orphans(df, "p", spark.createDataFrame([(5,)], "p int"), "p").collect()] == [6]
    assert catalog.execute_script(spark, "SELECT 1; SELECT nope FROM nowhere; SELECT 2")[1][1]


def test_spark_tables(spark):
    t = schema().tables["fact"]
    catalog.create_spark_table(spark, "StarTest", t)
    assert [c.name for c in spark.catalog.listColumns("startest.fact")] == ["fact_id", "station_id", "v"]
    spark.sql("DROP DATABASE startest CASCADE")


PAIRS = [
    ("SELECT a FROM t WHERE x=1 AND y=2", "select A from T where 2=y and 1=x", 1), ("SELECT a FROM t GROUP BY a, b", "SELECT a FROM t GROUP BY b, a", 1), ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a ASC NULLS LAST", 1),
    ("SELECT s.a FROM dim_state s", "SELECT x.a FROM dim_state AS x", 1), ("SELECT t.a FROM t", "SELECT a FROM t", 0), ("SELECT a FROM t WHERE s = 'Assam'", "SELECT a FROM t WHERE s ILIKE 'Assam'", 0), ("SELECT a FROM t WHERE s = 'A'", "SELECT a FROM t WHERE s = 'a'", 0),
    ("SELECT a AS x FROM t", "SELECT a AS y FROM t", 0), ("SELECT a FROM t JOIN u ON t.i=u.i", "SELECT a FROM u JOIN t ON t.i=u.i", 0), ("WITH q AS (SELECT 1 AS a) SELECT a FROM q", "WITH z AS (SELECT 1 AS a) SELECT a FROM z", 1), ("no sql (", "No  SQL (;", 1), ("SELECT 1", "", 0),
]


@pytest.mark.parametrize(("gold", "predicted", "expected"), PAIRS)
def test_exact_match(gold, predicted, expected):
    assert match.exact_match(gold, predicted) == match.exact_match(predicted, gold) == expected
    if gold:
        assert match.exact_match(gold, gold) == 1


def test_execution_match(spark):
    spark.createDataFrame([(1, None), (1, "b"), (2, "c")], "a int, b string").createOrReplaceTempView("m")
    ex = lambda g, p: match.execution_match(spark, g, p, 60)
    assert ex("SELECT a, b FROM m", "SELECT a AS z, b FROM m ORDER BY 1 DESC").match == 1
    assert ex("SELECT a FROM m ORDER BY a", "SELECT a FROM m ORDER BY a DESC").match == 0
    assert ex("SELECT a FROM m", "SELECT DISTINCT a FROM m").match == 0
    assert ex("SELECT a FROM m WHERE a > 9", "SELECT a FROM m WHERE a > 8").match == 1
    assert ex("SELECT a FROM m", "SELECT a, b FROM m").match == 0
    assert ex("SELECT a FROM m", None).error == "Empty prediction"
    assert ex("SELECT x FROM m", "SELECT a FROM m").error.startswith("Gold SQL Error") and ex("SELECT a FROM m", "SELEC").error.startswith("Pred SQL Error")
    assert match.plan_match(spark, "SELECT a AS p FROM m", "SELECT a AS q FROM m")


def test_runs(spark, tmp_path):
    qs = [{"name": "a", "sql": "SELECT 1 AS x", "complexity": "1"}, {"name": "b", "sql": "SELECT nope", "complexity": "1"}]
    runs = query.validate(spark, qs, str(tmp_path))
    assert [r.success for r in runs] == [True, False] and (tmp_path / "a").is_dir()
    assert tuple(query.report(spark, runs).select("queries", "passed", "failed").first()) == (2, 1, 1)
    assert query.executable(spark, "SELECT 1 WHERE false") == (False, "no rows")
    assert len(query.run_script(spark, "SELECT 1; SELECT 2")) == 2


def test_synthesis(spark):
    assert synth.shares(10, {"easy": 1, "medium": 1, "hard": 1}) == {"easy": 4, "medium": 3, "hard": 3}
    assert [synth.type_of(s) for s in ("SELECT a FROM t", "SELECT a FROM t WHERE b", "SELECT a FROM t ORDER BY a LIMIT 1", "SELECT count(*) FROM t", "SELECT 1 FROM a UNION SELECT 2 FROM b")] == ["Scan", "Filter", "TopSort", "Aggregate", "Union"]
    assert synth.unsafe_uses("SELECT avg(s.name) FROM dim_station s WHERE s.state_id > 3 AND s.name = 5", schema()) == ["avg(s.name)", "s.name = 5"]
    df = synth.generate_column(spark.createDataFrame([("say hi",), (None,)], "p string"), "p", "out", lambda: synth.Stub([("hi", "hello")]))
    assert sorted((r.p or "", r.out) for r in df.collect()) == [("", ""), ("say hi", "hello")]
