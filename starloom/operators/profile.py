"""Type inference and profiling: one aggregate pass over all columns, then rules on the driver."""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.sizes import broadcast_if_small
from starloom.functions.transforms import strip, text_of, to_number

#: Name patterns (substrings) and VARCHAR sizes.
FLAGS = ("is_", "has_", "flag", "_flag")
MONEY = (
    "amount", "balance", "fund", "expenditure", "disbursement", "outlay",
    "surplus", "deficit", "loan", "debt", "repayment", "discharge",
    "deposit", "advance", "remittance", "investment", "reserve",
    "provident", "contingency", "suspense", "lakhs", "crores", "rupees",
    "inr", "revenue", "capital", "services", "development", "settlement",
)
NUMERIC_KINDS = ("INTEGER", "REAL", "NUMERIC", "FLOAT", "INT", "BIGINT", "SMALLINT")
DECIMAL_WORDS = ("total", "sum", "count", "amount", "value", "number")
SIZES = (10, 20, 30, 50, 100, 200, 255, 500, 1000)


def varchar(longest: int) -> str:
    """VARCHAR with a fifth and ten characters of room, in fixed steps; TEXT beyond."""
    need = int(longest * 1.2) + 10
    return next((f"VARCHAR({n})" for n in SIZES if need <= n), "TEXT")


def is_id(name: str) -> bool:
    return name.lower().endswith("_id") or name.lower() == "id"


def is_flag(name: str) -> bool:
    return any(p in name.lower() for p in FLAGS)


def is_year(name: str) -> bool:
    return "year" in name.lower()


def is_money(name: str) -> bool:
    return any(p in name.lower() for p in MONEY)


@dataclass
class ColumnFacts:
    given: int
    numeric: bool
    point: bool
    negative: bool
    largest: float | None
    longest: int
    dates: bool


def column_facts(df: DataFrame) -> dict[str, ColumnFacts]:
    """What the rules need, for all columns in one aggregate; the date test looks at every given value."""
    aggs = []
    for i, c in enumerate(df.columns):
        t = strip(text_of(F.col(f"`{c}`")))
        n, given = to_number(t), strip(text_of(F.col(f"`{c}`"))) != ""
        usable = n.isNotNull() & ~F.isnan(n)
        aggs += [
            F.sum(given.cast("long")).alias(f"g{i}"), F.coalesce(F.min(F.when(given, usable)), F.lit(True)).alias(f"n{i}"), F.coalesce(F.max(F.when(given, t.contains("."))), F.lit(False)).alias(f"p{i}"),
            F.coalesce(F.max(F.when(given & usable, n < 0)), F.lit(False)).alias(f"m{i}"), F.max(F.when(given & usable, F.abs(n))).alias(f"x{i}"), F.coalesce(F.max(F.length(t)), F.lit(0)).alias(f"l{i}"),
            F.coalesce(F.min(F.when(given, t.rlike(r"^\d{4}-\d{2}-\d{2}"))), F.lit(False)).alias(f"d{i}"),
        ]
    row = df.agg(*aggs).first()
    return {c: ColumnFacts(row[f"g{i}"] or 0, row[f"n{i}"], row[f"p{i}"], row[f"m{i}"], row[f"x{i}"], row[f"l{i}"], row[f"d{i}"]) for i, c in enumerate(df.columns)}


def infer_type(name: str, facts: ColumnFacts) -> str:
    """Order of the rules: empty, id, flag, year, money, then the values."""
    if not facts.given:
        return "VARCHAR(255)"
    for test, kind in ((is_id, "BIGINT"), (is_flag, "SMALLINT"), (is_year, "INTEGER"), (is_money, "DOUBLE PRECISION")):
        if test(name):
            return kind
    if facts.numeric:
        if facts.point:
            return "DOUBLE PRECISION"
        if facts.largest is not None and facts.largest <= 1 and not facts.negative:
            return "SMALLINT"
        if facts.largest is not None and 1900 <= facts.largest <= 2100 and not facts.negative:
            return "INTEGER"
        return "DOUBLE PRECISION" if any(w in name.lower() for w in DECIMAL_WORDS) else "BIGINT"
    return "DATE" if facts.dates else varchar(facts.longest)


def infer_from_name(name: str) -> str:
    """For columns that the data lacks; the order is id, year, flag, money."""
    for test, kind in ((is_id, "BIGINT"), (is_year, "INTEGER"), (is_flag, "SMALLINT"), (is_money, "DOUBLE PRECISION")):
        if test(name):
            return kind
    return "VARCHAR(255)"


def name_type(c: Column) -> Column:
    """infer_from_name for a column of names."""
    low = F.lower(c)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(low.endswith("_id") | (low == "id"), "BIGINT").when(low.contains("year"), "INTEGER").when(any_of(FLAGS), "SMALLINT").when(any_of(MONEY), "DOUBLE PRECISION").otherwise("VARCHAR(255)")


def key_type(name: str) -> str:
    return "INTEGER" if is_year(name) else "BIGINT"


def infer_types(df: DataFrame) -> dict[str, str]:
    return {c: infer_type(c, f) for c, f in column_facts(df).items()}


def simple_types(head: DataFrame) -> dict[str, str]:
    """NUMBER, DATE or TEXT for each column of a small head."""
    facts = column_facts(head)
    return {c: "TEXT" if not f.given else "NUMBER" if f.numeric else "DATE" if f.dates else "TEXT" for c, f in facts.items()}


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct, longest, smallest, largest): one pass, exact distinct counts by Expand."""
    parts = []
    for c in df.columns:
        t = F.col(f"`{c}`").cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), t.alias("v")))
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"), F.max(F.length("v")).alias("longest"), F.min("v").alias("smallest"), F.max("v").alias("largest"))


def frequent_values(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Values by falling frequency, then by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def sample_values(df: DataFrame, column: str, most: int = 6) -> DataFrame:
    """The first distinct values that aren't null."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().orderBy("value").limit(most)


def value_search(df: DataFrame, column: str, part: str, most: int | None = None) -> DataFrame:
    """Distinct values that contain `part`, whatever the case; its wildcards are wildcards."""
    found = df.select(F.col(column).alias("value")).filter(F.col("value").ilike(f"%{part}%")).distinct().orderBy("value")
    return found.limit(most) if most else found


def prompt_values(df: DataFrame, kinds: dict[str, str], most: int = 6, distinct_limit: int = 10) -> dict[str, list]:
    """Sample values for prompts: no keys, ids, e-mail or url columns, no columns with addresses or long texts, no numbers with many values."""
    out = {}
    for c in df.columns:
        low = c.lower()
        if low.endswith(("id", "email", "url")):
            continue
        values = [r[0] for r in frequent_values(df, c, max(most, distinct_limit + 1)).select("value").collect()]
        if kinds.get(c, "").upper() in NUMERIC_KINDS and len(values) > distinct_limit:
            continue
        if any(isinstance(v, str) and (len(v.strip()) > 50 or "@" in v and "." in v or "http://" in v or "https://" in v) for v in values):
            continue
        out[c] = values[:most]
    return out


def _ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, 0 to 1."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)])


def nearest_values(wanted: DataFrame, wanted_col: str, values: DataFrame, value_col: str) -> DataFrame:
    """For each wanted text the value with the highest ratio (ties: the smallest value). The values, a column's distinct ones, are the stated set that is broadcast if small."""
    pool = broadcast_if_small(values.select(F.col(value_col).alias("value")).filter("value is not null").distinct(), 10_000)
    pairs = wanted.select(F.col(wanted_col).alias("wanted")).distinct().join(pool)
    scored = pairs.withColumn("ratio", sequence_ratio("wanted", "value"))
    best = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("ratio"), "value"))
    return scored.withColumn("_r", best).filter("_r = 1").drop("_r")


def keep_all_columns(columns_by_table: dict[str, list[str]]) -> bool:
    """Small schemas aren't pruned: at most six columns a table on average and thirty in all."""
    counts = [len(c) for c in columns_by_table.values()]
    return bool(counts) and sum(counts) / len(counts) <= 6 and sum(counts) <= 30


def prune_decisions(columns: DataFrame, database: str, table: str) -> DataFrame:
    """(`database`, `columns`, `keep_all`) of every database, from one row a column: `keep_all_columns` in the cluster."""
    per = columns.groupBy(database).agg(F.count("*").alias("columns"), F.count_distinct(table).alias("_tables"))
    return per.select(database, "columns", ((F.col("columns") / F.col("_tables") <= 6) & (F.col("columns") <= 30)).alias("keep_all"))


def merge_selection(columns: dict[str, list[str]], chosen: dict[str, list[str] | str], keys: dict[str, list[str]]) -> dict[str, list[str]]:
    """keep_all, drop_all or a list of columns per table; keys stay, unknown names go."""
    out = {}
    for table, have in columns.items():
        pick = chosen.get(table, "keep_all")
        if pick == "drop_all":
            continue
        wanted = have if pick == "keep_all" else [c for c in have if c in set(pick) | set(keys.get(table, ()))]
        if wanted:
            out[table] = wanted
    return out
