"""Scalar transforms and predicates as column expressions; Python runs only where its number formatting is the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a missing value, in lower case.
MISSING = ("", "null", "na", "n/a", "none", "-")


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def text_of(c: Column) -> Column:
    """The cell as text, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_valid(c: Column) -> Column:
    return ~F.lower(strip(text_of(c))).isin(*MISSING)


def complete(columns: list[Column]) -> Column:
    """All of the columns hold valid values."""
    return reduce(lambda a, b: a & b, map(is_valid, columns), F.lit(True))


def any_given(columns: list[Column]) -> Column:
    """At least one of the columns is neither null nor blank."""
    return reduce(lambda a, b: a | b, (strip(text_of(c)) != "" for c in columns), F.lit(False))


def present(df: DataFrame, required: list[str], header: tuple[str, str] | None = None, least_cells: int = 0) -> DataFrame:
    """Rows that hold all `required` cells and `least_cells` given ones, without repeated header rows (`header`: a column and the text it has there)."""
    keep = reduce(lambda a, b: a & b, (strip(text_of(F.col(c))) != "" for c in required), F.lit(True))
    if header:
        keep &= strip(text_of(F.col(header[0]))) != header[1]
    if least_cells:
        keep &= reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in df.columns)) >= least_cells
    return df.filter(keep)


def first_distinct(values: Column, most: int | None = None) -> Column:
    """Distinct elements in the order in which they come first, `most` of them at most; null has none."""
    seen = F.array_distinct(values)
    return seen if most is None else F.slice(seen, 1, most)


def extract_year(c: Column) -> Column:
    """The first four digits in a row, else ''."""
    return F.regexp_extract(text_of(c), r"(\d{4})", 1)


def extract_year_19_20(c: Column) -> Column:
    """A year of the 20th or 21st century as a word of its own, else the trimmed text."""
    found = F.regexp_extract(text_of(c), r"\b((?:19|20)\d{2})\b", 1)
    return F.when(found != "", found).otherwise(strip(text_of(c)))


def to_number(c: Column) -> Column:
    t = strip(text_of(c))
    readable = t.rlike(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$")
    return F.when(readable, F.regexp_replace(t, "_", "").try_cast("double"))


def to_int(c: Column) -> Column:
    """Truncated toward zero, as text; '' if it isn't a finite number."""
    n = to_number(c)
    finite = F.when(~F.isnan(n) & (F.abs(n) < 9e18), n)
    return F.coalesce(F.when(finite >= 0, F.floor(finite)).otherwise(F.ceil(finite)).cast("string"), F.lit(""))


@F.pandas_udf(T.StringType())
def _python_float(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "" if v is None or pd.isna(v) else repr(float(v)))


@F.pandas_udf(T.StringType())
def _python_round2(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "" if v is None or pd.isna(v) else repr(round(float(v), 2)))


def to_float(c: Column) -> Column:
    """The number in Python's shortest form ('100000000.0', '1e+16'), else ''."""
    return _python_float(to_number(c))


def clean_numeric(c: Column) -> Column:
    """Rounded to two places half to even on the binary value, in Python's form, else ''."""
    return _python_round2(to_number(c))


def clean_amount(c: Column) -> Column:
    """Amounts: commas out, two places, no trailing zeros or point; '' if invalid."""
    plain = F.regexp_replace(strip(text_of(c)), ",", "")
    rounded = F.round(to_number(plain), 2).cast("decimal(38,2)").cast("string")
    short = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(is_valid(c) & to_number(plain).isNotNull() & ~F.isnan(to_number(plain)), short).otherwise("")


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "extract_year": extract_year,
    "uppercase": lambda c: strip(F.upper(text_of(c))),
    "lowercase": lambda c: strip(F.lower(text_of(c))),
    "strip": lambda c: strip(text_of(c)),
    "to_int": to_int,
    "to_float": to_float,
    "clean_numeric": clean_numeric,
}


def register_transform(name: str, build: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = build


def transformed(c: Column, name: str | None) -> Column:
    return strip(text_of(c)) if not name else TRANSFORMS[name](strip(text_of(c)))


def by_ordinal(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """Columns by position, trimmed and renamed; positions beyond the row give ''."""
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[(strip(text_of(F.col(f"_c{i}"))) if i < len(df.columns) else F.lit("")).alias(target) for i, target in columns])


def lookup(c: Column, values: Mapping[str, str], default: str | None = None) -> Column:
    """A small fixed map with a default; large maps belong in a join."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default) if default is not None else c)


def lookup_fields(c: Column, values: Mapping[str, tuple[str, ...]], names: tuple[str, ...], default: tuple[str, ...]) -> Column:
    """Several fields by one key, as a struct with `names`: a small fixed map of tuples, and a default tuple for keys it lacks."""
    pick = lambda fields: F.struct(*[F.lit(x).alias(n) for n, x in zip(names, fields, strict=True)])
    pairs = F.create_map(*[x for key, fields in values.items() for x in (F.lit(key), pick(fields))])
    return F.coalesce(F.try_element_at(pairs, c), pick(default))


def fiscal_time(year: Column) -> dict[str, Column]:
    """Parts of the fiscal year that starts in `year` (a number)."""
    y = year.cast("int")
    return {
        "start_year": y,
        "end_year": y + 1,
        "label": F.concat(F.lit("FY"), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")),
        "decade": F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s")),
        "pre_gst": y < 2017,
        "covid": y.isin(2020, 2021),
    }


def century_month(cmc: Column) -> dict[str, Column]:
    """Year and month of a century-month code; codes below 1 (special values) give null."""
    c = F.when(cmc.cast("int") >= 1, cmc.cast("int"))
    return {"year": (F.floor((c - 1) / 12) + 1900).cast("int"), "month": ((c - 1) % 12 + 1).cast("int")}


def composite_key(columns: list[Column]) -> Column:
    """Trimmed parts with '|' between them. A struct of the parts keeps a '|' inside a part apart; see `struct_key`."""
    return F.concat_ws("|", *[strip(text_of(c)) for c in columns])


def struct_key(columns: list[Column]) -> Column:
    return F.struct(*[strip(text_of(c)).alias(f"k{i}") for i, c in enumerate(columns)])


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9; other scripts have no tokens (strict behaviour)."""
    return F.filter(F.split(F.lower(text_of(c)), r"[^a-z0-9]+"), lambda x: x != "")


def unicode_tokens(c: Column) -> Column:
    """Lower-case runs of letters, marks and digits of any script."""
    return F.filter(F.split(F.lower(text_of(c)), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    # zipping two slices reads `words` a few times; indexing inside a lambda would work it out again for every element
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def extract_sql(c: Column) -> Column:
    """The statement of an answer: without fences and an `SQL:` label."""
    bare = F.regexp_replace(text_of(c), r"(?i)```(?:sql)?", "")
    return strip(F.regexp_replace(strip(bare), r"(?i)^sql\s*:\s*", ""))


def label_of(c: Column) -> Column:
    """EASY, NON-NESTED or NESTED, by the first that the text holds."""
    t = text_of(c)
    return F.when(t.contains("EASY"), "EASY").when(t.contains("NON-NESTED"), "NON-NESTED").otherwise("NESTED")


def slug(c: Column) -> Column:
    return F.translate(text_of(c), "/-.", "___")


def path_parts(path: Column) -> dict[str, Column]:
    """Database, model, language and time stamp of an evaluation file's path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.jsonl?$", "")
    folder = F.element_at(F.split(path, "/"), -2)
    return {
        "db": F.regexp_extract(stem, r"^(.*?)_text2sql", 1),
        "model": F.when(folder.rlike("^eval_files_oneshot_.+"), F.regexp_replace(folder, "^eval_files_oneshot_", "")).otherwise("default"),
        "language": F.when(F.regexp_extract(stem, r"\d{8}_\d{6}_(.*?)_?evaluated$", 1) != "", F.regexp_extract(stem, r"\d{8}_\d{6}_(.*?)_?evaluated$", 1)).otherwise("english"),
        "timestamp": F.regexp_extract(stem, r"(\d{8}_\d{6})", 1),
    }


def short_text(c: Column, most: int = 100) -> Column:
    return F.left(c.cast("string"), F.lit(most))


def cell_text(c: Column) -> Column:
    """str(v).strip(); null stays null."""
    return strip(c.cast("string"))


def balanced(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("("), F.lit("")))) == (F.length(c) - F.length(F.replace(c, F.lit(")"), F.lit(""))))


def basic_sql(c: Column) -> Column:
    """SELECT and FROM are there, parentheses balance, and no placeholder name is left."""
    low = F.lower(text_of(c))
    return low.contains("select") & low.contains("from") & balanced(low) & ~low.contains("col_") & ~low.contains("table_")
