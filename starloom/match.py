"""Do two statements agree: exact match of canonical text, execution match of results, and match of Spark's plans."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.dialect import to_spark, tokens
from starloom.functions.transforms import cell_text
from starloom.lineage import cut

_CLAUSES = frozenset("select from where group having order limit offset union intersect except on join inner left right full cross natural using fetch window qualify".split())
_NOT_ALIAS = _CLAUSES | {"as", "and", "or", "set", "values", "when", "then", "else", "end", "asc", "desc", "outer", "lateral"}


def plain_text(sql: str) -> str:
    """Fallback form: lower case, no quotes or semicolons, single spaces."""
    return re.sub(r"\s+", " ", re.sub(r"[\"'`;]", "", sql or "")).strip().lower()


class _Unreadable(Exception):
    pass


def _words(sql: str) -> list[str]:
    out = []
    for kind, text in tokens(sql.strip().rstrip(";")):
        if kind in ("space", "comment"):
            continue
        if kind == "quoted":
            out.append(text[1:-1].lower())
        elif kind == "string":
            out.append(text)
        else:
            out.append(text.lower())
    if not out or out[0] not in ("select", "with", "(") or ";" in out:
        raise _Unreadable
    # a.b.c keeps its last two names
    i = 0
    while i + 4 < len(out):
        if out[i + 1] == "." and out[i + 3] == "." and re.match(r"\w", out[i]):
            del out[i : i + 2]
        else:
            i += 1
    return out


def _tree(words: list[str]) -> list:
    stack: list[list] = [[]]
    for w in words:
        if w == "(":
            stack.append([])
        elif w == ")":
            if len(stack) == 1:
                raise _Unreadable
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(w)
    if len(stack) > 1:
        raise _Unreadable
    return stack[0]


def _name(x) -> bool:
    return isinstance(x, str) and bool(re.match(r"[^\W\d]\w*$", x)) and x not in _NOT_ALIAS


class _Names:
    """Names of common table expressions and table aliases, numbered as they are met, over the whole statement."""

    def __init__(self) -> None:
        self.ctes: dict[str, str] = {}
        self.aliases: dict[str, str] = {}

    def find(self, part: list) -> list:
        """The part with an alias after every table; subqueries in the order of the text."""
        out, i, in_from = [], 0, False
        while i < len(part):
            x = part[i]
            if _name(x) and i + 2 < len(part) and part[i + 1] == "as" and isinstance(part[i + 2], list) and part[i + 2][:1] in (["select"], ["with"]):
                self.ctes.setdefault(x, f"cte{len(self.ctes) + 1}")
                out += [x, "as", self.find(part[i + 2])]
                i += 3
                continue
            if isinstance(x, list):
                out.append(self.find(x))
                i += 1
                if in_from and out[-1][:1] in (["select"], ["with"]):
                    i = self._alias(part, i, out, None)
                continue
            if x in _CLAUSES:
                in_from = x in ("from", "join") or in_from and x in ("inner", "left", "right", "full", "cross", "natural")
            out.append(x)
            i += 1
            if x in ("from", "join") or (x == "," and in_from):
                if i < len(part) and _name(part[i]):
                    table = [part[i]]
                    i += 1
                    if i + 1 < len(part) and part[i] == ".":
                        table = [part[i + 1]]
                        i += 2
                    out += table
                    i = self._alias(part, i, out, table[0])
        return out

    def _alias(self, part: list, i: int, out: list, table: str | None) -> int:
        if i < len(part) and part[i] == "as":
            i += 1
        if i < len(part) and _name(part[i]):
            alias = part[i]
            i += 1
        else:
            alias = table
        if alias:
            self.aliases.setdefault(alias, f"t{len(self.aliases) + 1}")
            out += ["as", self.aliases[alias]]
        return i

    def apply(self, part: list) -> list:
        out = []
        for i, x in enumerate(part):
            if isinstance(x, list):
                out.append(self.apply(x))
            elif x in self.ctes and not (i + 1 < len(part) and part[i + 1] == "."):
                out.append(self.ctes[x])
            elif x in self.aliases and i + 1 < len(part) and part[i + 1] == ".":
                out.append(self.aliases[x])
            else:
                out.append(x)
        return out


def _text(x) -> str:
    return "( " + " ".join(map(_text, x)) + " )" if isinstance(x, list) else x


def _split(part: list, word: str) -> list[list]:
    """Operands between `word` outside CASE and BETWEEN."""
    out, cases, between = [[]], 0, False
    for x in part:
        if x == "case":
            cases += 1
        elif x == "end":
            cases -= 1
        elif x == "between":
            between = True
        if x == word and not cases:
            if word == "and" and between:
                between = False
            else:
                out.append([])
                continue
        out[-1].append(x)
    return out


def _condition(part: list) -> list:
    ors = []
    for o in _split(part, "or"):
        ands = []
        for a in _split(o, "and"):
            a = [_clauses(x, False) if isinstance(x, list) else x for x in a]
            if a.count("=") == 1 and not {"<", ">", "!", "case"} & {x for x in a if isinstance(x, str)}:
                at = a.index("=")
                left, right = a[:at], a[at + 1 :]
                if left and left[0] != "not" and " ".join(map(_text, right)) < " ".join(map(_text, left)):
                    left, right = right, left
                a = [*left, "=", *right]
            ands.append(a)
        ands.sort(key=lambda a: " ".join(map(_text, a)))
        ors.append([x for i, a in enumerate(ands) for x in (["and"] if i else []) + a])
    ors.sort(key=lambda a: " ".join(map(_text, a)))
    return [x for i, o in enumerate(ors) for x in (["or"] if i else []) + o]


def _order_items(part: list) -> list:
    out = []
    for i, item in enumerate(_split(part, ",")):
        item = [_clauses(x, False) if isinstance(x, list) else x for x in item]
        down = "desc" in item
        tail = [x for x in item if isinstance(x, str)][-2:]
        if tail == ["nulls", "first" if down else "last"]:
            item = item[:-2]
        item = [x for x in item if x != "asc"]
        out += ([","] if i else []) + item
    return out


def _clauses(part: list, top: bool) -> list:
    """Canonical form of one level: conditions sorted, default orders dropped, the top level's GROUP BY sorted."""
    if not isinstance(part, list):
        return part
    pieces, current = [], ["", []]
    i = 0
    while i < len(part):
        x = part[i]
        if isinstance(x, str) and x in _CLAUSES:
            pieces.append(current)
            head = x
            if x in ("group", "order") and i + 1 < len(part) and part[i + 1] == "by":
                head = f"{x} by"
                i += 1
            current = [head, []]
        else:
            current[1].append(x)
        i += 1
    pieces.append(current)
    out = []
    for head, body in pieces:
        if head:
            out += head.split()
        if head in ("where", "having", "on"):
            out += _condition(body)
        elif head == "order by":
            out += _order_items(body)
        elif head == "group by" and top:
            items = sorted(([_clauses(x, False) if isinstance(x, list) else x for x in g] for g in _split(body, ",")), key=lambda g: " ".join(map(_text, g)))
            out += [x for k, g in enumerate(items) for x in ([","] if k else []) + g]
        elif head == "" and not pieces[1:] and ("and" in body or "or" in body):
            out += _condition(body)
        else:
            out += [_clauses(x, False) if isinstance(x, list) else x for x in body]
    return out


def canonical(sql: str) -> str:
    """Canonical text of a statement; raises for text that cannot be read as one."""
    names = _Names()
    tree = names.find(_tree(_words(sql)))
    tree = names.apply(tree)
    return " ".join(map(_text, _clauses(tree, True)))


def exact_match(gold: str | None, predicted: str | None) -> int:
    """1 if the canonical texts agree; if either cannot be read, 1 if the plain texts do. An empty prediction never matches."""
    if not (predicted or "").strip() or not (gold or "").strip():
        return 0
    try:
        return int(canonical(gold) == canonical(predicted))
    except _Unreadable:
        return int(plain_text(gold) == plain_text(predicted))


@F.pandas_udf(T.IntegerType())
def exact_match_of(gold: pd.Series, predicted: pd.Series) -> pd.Series:
    """Statements that repeat in a batch are read once."""
    seen: dict[str, str] = {}

    def form(sql: str) -> str:
        if sql not in seen:
            try:
                seen[sql] = canonical(sql)
            except _Unreadable:
                seen[sql] = ""
        return seen[sql]

    def one(g: str | None, p: str | None) -> int:
        if not (p or "").strip() or not (g or "").strip():
            return 0
        return int(form(g) == form(p)) if form(g) and form(p) else int(plain_text(g) == plain_text(p))

    return pd.Series([one(g, p) for g, p in zip(gold, predicted)], dtype="int32")


def ordered(gold_sql: str) -> bool:
    """Whether order counts: the gold text says ORDER BY anywhere, inside OVER too."""
    return "order by" in (gold_sql or "").lower()


def _cells(df: DataFrame, text: bool) -> DataFrame:
    cells = [cell_text(F.col(f"c{i}")) if text else F.col(f"c{i}") for i in range(len(df.columns))]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])


def _kept(df: DataFrame, text: bool) -> DataFrame:
    """The cells of a result, written once, with a number that grows in the order in which the query gives its rows."""
    return cut(_cells(df, text).withColumn("_m", F.monotonically_increasing_id()))


def _same(gold: DataFrame, predicted: DataFrame) -> bool:
    both = gold.withColumn("_n", F.lit(1)).union(predicted.withColumn("_n", F.lit(-1)))
    return both.groupBy(*[c for c in both.columns if c != "_n"]).agg(F.sum("_n").alias("d")).filter("d <> 0").isEmpty()


def positions(kept: DataFrame) -> DataFrame:
    """Rows with their place `_i` in the result, from 0: the place in a partition after the rows of the partitions before it."""
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_here"))  # one row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"))
    return kept.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_i", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_m")


def same_rows(gold: DataFrame, predicted: DataFrame, text: bool = True) -> bool:
    """Multiset equality by position of the columns, decided in the cluster: each distinct row's counts are compared in one shuffle."""
    return len(gold.columns) == len(predicted.columns) and _same(_cells(gold, text), _cells(predicted, text))


def same_sequence(gold: DataFrame, predicted: DataFrame, text: bool = True) -> bool:
    """Equality row by row, in the order in which the queries give them."""
    return len(gold.columns) == len(predicted.columns) and _same(positions(_kept(gold, text)), positions(_kept(predicted, text)))


@dataclass
class Outcome:
    match: int
    error: str | None = None


def with_timeout(spark: SparkSession, seconds: float, action):
    """Runs `action` in a job group of its own that a timer cancels; other queries go on."""
    context, group = spark.sparkContext, f"starloom-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "query under a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.interruptOnCancel", None)


def execution_match(spark: SparkSession, gold_sql: str, predicted_sql: str | None, seconds: float = 5.0, text: bool = True) -> Outcome:
    """Runs both statements, each within `seconds` of its own and with its own errors, and compares the results they wrote."""
    if not (predicted_sql or "").strip():
        return Outcome(0, "Empty prediction")
    kept = {}
    for name, sql in (("Gold", gold_sql), ("Pred", predicted_sql)):
        try:
            df = spark.sql(to_spark(sql or ""))
            kept[name] = with_timeout(spark, seconds, lambda df=df: _kept(df, text))
        except Exception as error:  # noqa: BLE001 - the message is the result
            return Outcome(0, f"{name} SQL Error: {str(error).splitlines()[0]}")
    gold, predicted, in_order = kept["Gold"], kept["Pred"], ordered(gold_sql)
    if len(gold.columns) != len(predicted.columns):
        same = False
    elif in_order:
        same = _same(positions(gold), positions(predicted))
    else:
        same = _same(gold.drop("_m"), predicted.drop("_m"))
    return Outcome(int(same), None if same else f"Mismatch (Order matters: {in_order})")


def plan_match(spark: SparkSession, gold_sql: str, predicted_sql: str) -> bool:
    """Whether Spark's canonical plans are the same: another notion than exact match (aliases don't count, names of CTEs and group order do)."""
    return spark.sql(to_spark(gold_sql)).sameSemantics(spark.sql(to_spark(predicted_sql)))


def rescored(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Evaluation rows with `em_new`, the exact match as computed here: equal texts agree at once, and only the others are brought to canonical form."""
    g, p = F.coalesce(gold, F.lit("")), F.coalesce(predicted, F.lit(""))
    known = F.when((F.btrim(p) == "") | (F.btrim(g) == ""), F.lit(0)).when(g == p, F.lit(1))
    return df.withColumn("em_new", F.coalesce(known, exact_match_of(F.when(known.isNull(), g), F.when(known.isNull(), p))))
