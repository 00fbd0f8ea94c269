"""Design notes and generated prose."""

from pyspark.sql import functions as F

from starloom.functions.prose import json_field, json_object, statement, statement_of
from starloom.sources.markdown import find_column, read_design

NOTE = """# Design
## DIMENSION TABLES
### **DIM_STATE**
**Purpose:** places
**Columns (2):**
- `STATE_ID` (BIGINT, PK)
- `state` (VARCHAR)
### DIM_STATION
- `STATION_ID` (BIGINT PK)
- `STATE_ID` (BIGINT, FK → DIM_STATE)
- `name` (VARCHAR)
## FACT TABLES
### FACT_X
- `STATION_ID` (BIGINT, FK -> DIM_STATION)
- `ph` (DOUBLE)
## COLUMN MAPPING
| Original Column | Source Index | Data Type | Mapped To Table | Mapped Column(s) | Notes |
|---|---|---|---|---|---|
| Station Name | 2 | text | DIM_STATION | NAME | |
| pH value | - | num | FACT_X, FACT_Y | PH | |
"""


def test_design_note():
    spec = read_design(NOTE, ["state", "pH value", "Station Name"])
    assert [(t.name, t.key, t.dedup_columns) for t in spec.dimensions] == [("DIM_STATE", "STATE_ID", (0,)), ("DIM_STATION", "STATION_ID", (2,))]
    fact = spec.facts[0]
    assert (fact.key, [(c.source_index, c.target) for c in fact.columns], fact.foreign_keys[0].references) == ("FACT_X_ID", [(1, "PH")], "DIM_STATION")
    assert spec.descriptions["DIM_STATE"] == "places" and spec.errors(["a", "b", "c"]) == []
    assert [find_column(x, ["A_B", "a b", "xyz"]) for x in ("a_b", "A-B", "y", "q")] == [0, 0, 2, None]


def test_json_in_prose(spark):
    assert json_object('{"a": 1}') == {"a": 1} and json_object('x ```json\n{"a": 2}\n``` y') == {"a": 2} and json_object('so {"a": {"b": 3}} it is') == {"a": {"b": 3}} and json_object("[1]") is None and json_object(None) is None
    df = spark.createDataFrame([('{"a": [1, 2]}',), ('{"a": "x"}',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(json_field(F.col("t"), "a")).collect()] == ["[1, 2]", "x", None, None]


def test_statement_in_prose(spark):
    assert statement("Here:\n```sql\nSELECT a\nFROM t\n```\nDone.") == "SELECT a\nFROM t"
    assert statement("SQL: SELECT a FROM t; more") == "SELECT a FROM t"
    assert statement("SELECT a FROM (\nvalues x\n) q\nThis is it.") == "SELECT a FROM (\nvalues x\n) q"
    assert statement("With pleasure, no.") is None and statement("") is None
    assert statement("Answer: SELECT a FROM t") == "SELECT a FROM t"
    assert statement("The SQL query that answers this is SELECT t.a FROM t. It counts rows.") == "SELECT t.a FROM t"
    assert statement("the sql query is select a from t where b = 'x. Y'") == "select a from t where b = 'x. Y'"
    assert statement("You could use `select 1.5 from t` here.") == "select 1.5 from t"
    assert statement("First ```sql\nWITH y AS (SELECT 1)\nSELECT * FROM y\n``` then ```SELECT 2```") == "WITH y AS (SELECT 1)\nSELECT * FROM y"
    assert statement("SELECT a,\nb\nFROM t\nExplanation: none") == "SELECT a,\nb\nFROM t"
    assert statement("SELECT a FROM t WHERE x > 1 Note: all") == "SELECT a FROM t WHERE x > 1"
    assert statement("Please select the rows from the list.") is None
    assert json_object('```\n{"a": 1}\n```\nor\n```json\n{"a": 5}') == {"a": 5}
    assert spark.createDataFrame([("SELECT 1",), (None,)], "t string").select(statement_of("t")).first()[0] == "SELECT 1"
