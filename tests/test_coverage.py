"""Queries of sources, sinks, catalogue and text helpers against their reference SQL; what no SQL can say of them."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from starloom import catalog, match, query, synth
from starloom.functions import transforms as tf
from starloom.model import SchemaInfo, TableInfo
from starloom.operators import metrics, retrieval
from starloom.operators.ordered import exact_quantiles
from starloom.plans import coverage
from starloom.sources import tables


@pytest.fixture(scope="module")
def engine(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(v):
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.mark.parametrize("name", sorted(coverage.QUERIES))
def test_agrees_with_reference_sql(spark, data, engine, name):
    df = coverage.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    found = engine.execute(coverage.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_sinks_and_their_errors(spark, tmp_path):
    catalog.create_spark_table(spark, "sinks", TableInfo("t", [("k", "BIGINT"), ("v", "DOUBLE PRECISION"), ("s", "TEXT")]))
    assert not catalog.create_database(spark, "SINKS")
    rows = spark.createDataFrame([("1", "2.5", ""), ("2", "", "x")], "K string, v string, s string")
    assert tables.append_table(rows, "sinks.t") == 2 and sorted(map(tuple, spark.table("sinks.t").collect())) == [(1, 2.5, None), (2, None, "x")]
    assert tables.append_table(rows.drop("s"), "sinks.t", most=1) == 1
    with pytest.raises(Exception):  # noqa: B017 - a cell that isn't a number aborts
        tables.append_table(spark.createDataFrame([("x",)], "k string"), "sinks.t")
    with pytest.raises(ValueError):
        tables.append_table(spark.createDataFrame([(1,)], "other int"), "sinks.t")
    assert tables.truncate(spark, "sinks.t") is None and spark.table("sinks.t").count() == 0 and tables.truncate(spark, "sinks.none")
    spark.sql("DROP DATABASE sinks CASCADE")
    tables.write_json_lines(rows, str(tmp_path / "j"), without=("s",), metadata={"n": 2})
    assert sorted(spark.read.json(str(tmp_path / "j")).columns) == ["K", "v"] and tables.text_file(str(tmp_path / "j.metadata")) == '{"n": 2}'
    assert query.save_result(spark, "SELECT nope", str(tmp_path / "e"))[0] is False and spark.read.csv(str(tmp_path / "e"), header=True).columns == ["error"]
    with pytest.raises(ValueError):
        tables.markdown(spark.range(5), most=4)


def test_tables_of_a_folder(spark, tmp_path):
    for name in ("one", "two"):
        tables.write_ddl_csv(SchemaInfo(name, {"a": TableInfo("a", [("k", "BIGINT"), ("n", "VARCHAR(20)")])}), str(tmp_path / f"pack_{name}" / "DDL.csv"))
    assert catalog.create_tables(spark, str(tmp_path), dry_run=True) == {"pack_one": ["a"], "pack_two": ["a"]}
    assert not spark.catalog.databaseExists("pack_one")
    catalog.create_tables(spark, str(tmp_path))
    assert spark.table("pack_two.a").columns == ["k", "n"]
    for name in ("one", "two"):
        spark.sql(f"DROP DATABASE pack_{name} CASCADE")


def test_keys_of_a_yaml_schema(spark, tmp_path):
    path = str(tmp_path / "s.yaml")
    tables.write_text(path, "dimension_tables:\n  - name: dim_a\n    key_column: a_id\n    columns: [{target_name: year, source_index: 0}]\nfact_tables:\n  fact_b:\n    columns: [{target_name: amount}]\n    foreign_keys: [{column: a_id, references: dim_a}, {column: x}, {column: c_id, references: dim_c}]\n")
    keys, links = tables.key_contract(path)
    assert keys == {"DIM_A": "A_ID", "FACT_B": "FACT_B_ID"} and links == [("FACT_B", "A_ID", "DIM_A", "A_ID"), ("FACT_B", "C_ID", "DIM_C", "C_ID")]
    found = tables.schema_config(path)
    assert dict(found.tables["FACT_B"].columns) == {"FACT_B_ID": "BIGINT", "A_ID": "BIGINT", "C_ID": "BIGINT", "amount": "DOUBLE PRECISION"} and dict(found.tables["DIM_A"].columns)["year"] == "INTEGER"
    registry = SchemaInfo("d", {"DIM_A": found.tables["DIM_A"], "FACT_B": TableInfo("FACT_B", [("FACT_B_ID", "BIGINT")])})
    first = catalog.sync_foreign_keys(registry, links[:1])
    assert first and catalog.sync_foreign_keys(registry, links[:1]) == []


def test_lookups_evidence_and_fallbacks(spark):
    df = spark.createDataFrame([("a", "p"), ("z", "q"), (None, None)], "k string, pair string")
    assert [tuple(r) for r in df.select(tf.lookup_fields(F.col("k"), {"a": ("1", "2")}, ("x", "y"), ("0", "0")).alias("f")).select("f.*").collect()] == [("1", "2"), ("0", "0"), ("0", "0")]
    evidence = spark.createDataFrame([("p", "yes"), ("q", "false;")], "pair string, evidence string")
    assert metrics.with_evidence(df, evidence, "pair").count() == 3 and metrics.with_evidence(df, evidence, "pair", required=True).count() == 1
    assert [r[0] for r in spark.createDataFrame([(["b", "a", "b", None],), (None,)], "v array<string>").select(tf.first_distinct(F.col("v"), 2)).collect()] == [["b", "a"], None]

    class Broken:
        def encode(self, text):
            raise RuntimeError

    pair = spark.createDataFrame([("many wells here", "many wells there"), ("x", None)], "a string, b string")
    plain = [r.s for r in retrieval.similarity(pair, "a", "b", "s").collect()]
    assert [r.s for r in retrieval.similarity(pair, "a", "b", "s", Broken).collect()] == plain and plain[0] > 0.5
    one, other = synth.Stub(), synth.Stub()
    assert synth.Clients(one).for_questions() is one and synth.Clients(one, other).for_questions() is other


def test_quantiles_and_positions_over_partitions(spark):
    rows = [(g, (i * 7919) % 1009 / 7) for g in ("a", None) for i in range(500)] + [("b", 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r.q for r in exact_quantiles(df, "g", "x", 0.2, "q").collect()}
    values = sorted(x for g, x in rows if g == "a")
    assert got["b"] == 3.0 and abs(got["a"] - (values[99] + 0.8 * (values[100] - values[99]))) < 1e-9 and got[None] == got["a"]
    places = match.positions(match._kept(spark.range(100).repartition(5).orderBy(F.desc("id")), False))
    assert sorted((r._i, r.c0) for r in places.collect()) == [(i, 99 - i) for i in range(100)]
    spark.range(4).createOrReplaceTempView("four")
    slow = match.execution_match(spark, "SELECT id FROM four", "SELECT id / (id - id) FROM four")
    assert slow.match == 0 and slow.error.startswith("Pred SQL Error")
    assert match.execution_match(spark, "SELECT id / (id - id) FROM four", "SELECT id FROM four").error.startswith("Gold SQL Error")


def test_broadcasts_are_checked_in_rows_and_bytes(spark):
    from starloom.functions.sizes import broadcast_if_small

    hinted = lambda df, **k: "broadcast" in broadcast_if_small(df, **k)._jdf.queryExecution().logical().toString()
    df = spark.createDataFrame([(i, "x" * 100, [1, 2], {"a": "b"}, (1, "z")) for i in range(10)], "i int, s string, a array<int>, m map<string,string>, t struct<x:int,y:string>")
    assert hinted(df) and hinted(df, rows=10) and not hinted(df, rows=9) and not hinted(df, most_bytes=1000)
    assert hinted(df.limit(0)) and hinted(spark.createDataFrame([(None, None)], "s string, a array<string>"))
