"""Fifty analytical queries over a census star, as pipelines of steps.

A query is a list of steps over the census rows: sums by key, computed columns, filters, windows, joins of earlier results, sorting and
limits. The same steps are run as DataFrame operations here and rendered as nested SQL for the check. The star comes from the order
tables: a location is a customer with nation and region, a census row an order, its details the sums over the order's lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import read_table

#: Measures of a census row as sums over its lines: (name, condition); each comes as _total, _male and _female.
MEASURES = {
    "population": "true", "population_0_6": "l_discount < 0.03", "sc_population": "l_tax < 0.02", "st_population": "l_tax > 0.06", "literate": "l_returnflag <> 'N'", "illiterate": "l_returnflag = 'N'",
    "working": "l_linenumber <= 3", "non_workers": "l_linenumber > 3", "main_workers": "l_linenumber <= 2", "marginal_workers": "l_linenumber = 3", "cultivators": "l_linenumber <= 2 AND l_discount < 0.03",
    "agri_labourers": "l_linenumber <= 2 AND l_discount >= 0.03 AND l_discount < 0.05", "household_industry": "l_linenumber <= 2 AND l_discount >= 0.05 AND l_discount < 0.08", "other_workers": "l_linenumber <= 2 AND l_discount >= 0.08",
    "m_cultivators": "l_linenumber = 3 AND l_discount < 0.03", "m_agri_labourers": "l_linenumber = 3 AND l_discount >= 0.03 AND l_discount < 0.05", "m_household_industry": "l_linenumber = 3 AND l_discount >= 0.05 AND l_discount < 0.08",
    "m_other_workers": "l_linenumber = 3 AND l_discount >= 0.08",
}
PLACE = {"state": "r_name", "district": "n_name", "sub_district": "c_mktsegment", "village": "c_name"}
LEVEL = "CASE WHEN c_acctbal < 0 THEN 'TOWN' ELSE 'VILLAGE' END"
RESIDENCE = "CASE o_orderstatus WHEN 'O' THEN 'Urban' WHEN 'F' THEN 'Rural' ELSE 'Mixed' END"


def _line_sums() -> dict[str, str]:
    out = {"households": "CAST(count(*) AS BIGINT)"}
    for name, condition in MEASURES.items():
        for suffix, extra in (("total", ""), ("male", " AND l_linestatus = 'O'"), ("female", " AND l_linestatus <> 'O'")):
            out[f"{name}_{suffix}"] = f"sum(CASE WHEN {condition}{extra} THEN CAST(l_quantity AS BIGINT) ELSE 0 END)"
    return out


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("c_custkey").alias("location_id"), *[F.col(v).alias(k) for k, v in PLACE.items()], F.expr(LEVEL).alias("location_level"))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations, census rows and all details; what a query doesn't use is pruned from the one pass over the lines."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(e).alias(k) for k, e in _line_sums().items()])
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("census_id"), F.col("o_custkey").alias("location_id"), F.year("o_orderdate").alias("census_year"), F.expr(RESIDENCE).alias("residence_type"))
    return orders.join(lines, F.col("census_id") == F.col("l_orderkey")).join(locations(spark, sf_dir), "location_id").drop("l_orderkey")


_SQL_LOCATIONS = "SELECT c_custkey AS location_id, " + ", ".join(f"{v} AS {k}" for k, v in PLACE.items()) + f", {LEVEL} AS location_level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SQL_LINES = "SELECT l_orderkey, " + ", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in _line_sums().items()) + " FROM lineitem GROUP BY l_orderkey"
SQL_SOURCES = f"loc AS ({_SQL_LOCATIONS}), lin AS ({_SQL_LINES}), cen AS (SELECT o_orderkey AS census_id, year(o_orderdate) AS census_year, {RESIDENCE} AS residence_type, lin.*, loc.* FROM orders JOIN lin ON o_orderkey = l_orderkey JOIN loc ON o_custkey = loc.location_id)"


@dataclass
class Pipe:
    """Steps over a source; every step can be run on a DataFrame and written as SQL."""

    source: str = "census"
    steps: list[tuple] = field(default_factory=list)

    def _with(self, *step) -> Pipe:
        return Pipe(self.source, [*self.steps, step])

    def sums(self, *by: str, **exprs: str) -> Pipe:
        return self._with("group", by, {k: f"CAST(sum({e}) AS BIGINT)" for k, e in exprs.items()})

    def group(self, *by: str, **aggs: str) -> Pipe:
        return self._with("group", by, aggs)

    def calc(self, **exprs: str) -> Pipe:
        return self._with("calc", exprs)

    def where(self, condition: str) -> Pipe:
        return self._with("where", condition)

    def pick(self, *columns: str) -> Pipe:
        return self._with("pick", columns)

    def join(self, other: Pipe, *on: str, how: str = "inner") -> Pipe:
        return self._with("join", other, on, how)

    def top(self, n: int | None, *order: str) -> Pipe:
        return self._with("top", n, order)

    def merged(self) -> Pipe:
        """The same with one aggregation a grain: sums of the same rows by the same key, joined by that key, are taken in one pass."""
        out: list[tuple] = []
        for kind, *args in self.steps:
            if kind == "join":
                other, on, how = args[0].merged(), *args[1:]
                plain = len(other.steps) == 1 and other.source == self.source and other.steps[0][:2] == ("group", tuple(on)) and how == "inner"
                if plain and on and out and out[0][:2] == ("group", tuple(on)) and all(k in ("calc", "where") for k, *_ in out[1:]):
                    taken = {*out[0][2], *(name for k, *a in out[1:] if k == "calc" for name in a[0])}
                    if taken.isdisjoint(other.steps[0][2]):
                        out[0] = ("group", tuple(on), out[0][2] | other.steps[0][2])
                        continue
                out.append(("join", other, on, how))
            else:
                out.append((kind, *args))
        return Pipe(self.source, out)

    def run(self, source: Callable[[str], DataFrame]) -> DataFrame:
        df = source(self.source)
        for kind, *args in self.steps:
            if kind == "group":
                by, aggs = args
                df = df.groupBy(*by).agg(*[F.expr(e).alias(k) for k, e in aggs.items()])
            elif kind == "calc":
                df = df.select("*", *[F.expr(e).alias(k) for k, e in args[0].items()])
            elif kind == "where":
                df = df.filter(args[0])
            elif kind == "pick":
                df = df.select(*args[0])
            elif kind == "join":
                other, on, how = args
                right = other.run(source)
                df = df.join(right, list(on), how) if on else df.crossJoin(F.broadcast(right))  # without keys the right side is one row of totals
            else:
                n, order = args
                df = df.orderBy(*[F.expr(o.removesuffix(" desc")).desc_nulls_last() if o.endswith(" desc") else F.expr(o).asc_nulls_last() for o in order])
                df = df.limit(n) if n else df
        return df

    def sql(self) -> str:
        text = f"SELECT * FROM {'loc' if self.source == 'locations' else 'cen'}"
        for kind, *args in self.steps:
            if kind == "group":
                by, aggs = args
                text = "SELECT " + ", ".join([*by, *[f"{e} AS {k}" for k, e in aggs.items()]]) + f" FROM ({text})" + (f" GROUP BY {', '.join(by)}" if by else "")
            elif kind == "calc":
                text = "SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in args[0].items()) + f" FROM ({text})"
            elif kind == "where":
                text = f"SELECT * FROM ({text}) WHERE {args[0]}"
            elif kind == "pick":
                text = f"SELECT {', '.join(args[0])} FROM ({text})"
            elif kind == "join":
                other, on, how = args
                text = f"SELECT * FROM ({text}) {'CROSS' if not on else how.upper()} JOIN ({other.sql()})" + (f" USING ({', '.join(on)})" if on else "")
            else:
                n, order = args
                text = f"SELECT * FROM ({text}) ORDER BY {', '.join(o + ' NULLS LAST' for o in order)}" + (f" LIMIT {n}" if n else "")
        return text


def ratio(top: str, bottom: str, times: float = 100, digits: int = 2) -> str:
    """A guarded ratio, rounded: null where the denominator is 0."""
    return f"round(CAST({top} AS DOUBLE) * {times} / nullif({bottom}, 0), {digits})"


def over(function: str, order: str = "", by: str = "", as_long: bool = True) -> str:
    spec = f"{function} OVER ({f'PARTITION BY {by} ' if by else ''}{f'ORDER BY {order}' if order else ''})"
    return f"CAST({spec} AS BIGINT)" if as_long else spec


rows, places = Pipe("census"), Pipe("locations")
S, SD = ("state",), ("state", "district")
_pop = dict(population="population_total")
_literacy = rows.sums(*S, literate="literate_total", assessed="literate_total + illiterate_total")
_occupations = ("cultivators", "agri_labourers", "household_industry", "other_workers")


def _gender_rates(by: tuple[str, ...]) -> Pipe:
    base = rows.sums(*by, male="working_male", female="working_female", male_pop="population_male", female_pop="population_female")
    return base.calc(male_rate=ratio("male", "male_pop"), female_rate=ratio("female", "female_pop")).calc(gap="round(male_rate - female_rate, 6)").pick(*by, "male_rate", "female_rate", "gap")


def _residence_literacy(kind: str, prefix: str) -> Pipe:
    base = rows.where(f"residence_type = '{kind}'").sums(*S, ml="literate_male", fl="literate_female", mp="population_male", fp="population_female")
    return base.calc(**{f"{prefix}_male": ratio("ml", "mp"), f"{prefix}_female": ratio("fl", "fp")}).pick("state", f"{prefix}_male", f"{prefix}_female")


_occupation = rows.sums(*S, **{o: f"{o}_total + m_{o}_total" for o in _occupations}, workers="working_total")
_economy = _occupation.calc(**{f"{o}_pct": ratio(o, "workers") for o in _occupations}, agri="cultivators + agri_labourers", other="household_industry + other_workers").calc(agri_pct=ratio("agri", "workers"), other_sector_pct=ratio("other", "workers"), economy="CASE WHEN agri > other * 2 THEN 'Highly Agricultural' WHEN agri > other THEN 'Agricultural' WHEN other > agri * 2 THEN 'Highly Non-Agricultural' ELSE 'Mixed' END")
_village_people = rows.where("location_level = 'VILLAGE'").sums("state", "district", "sub_district", "village", population="population_total", households="households")
_sub_districts = _village_people.group("state", "district", "sub_district", villages="CAST(count(*) AS BIGINT)", total="CAST(sum(population) AS BIGINT)", mean="avg(population)", least="min(population)", most="max(population)")

#: The workload: number -> (complexity 1-5, area, steps).
WORKLOAD: dict[int, tuple[int, str, Pipe]] = {
    1: (1, "Population", places.group(*S, n="CAST(count(*) AS BIGINT)").top(None, "n desc", "state")),
    2: (1, "Population", rows.sums("residence_type", total_households="households")),
    3: (1, "Population", places.group("location_level", n="CAST(count(*) AS BIGINT)").top(None, "n desc", "location_level")),
    4: (1, "Literacy", rows.sums(literate="literate_total", illiterate="illiterate_total")),
    5: (1, "Employment", rows.sums(workers="working_total", non_workers="non_workers_total")),
    6: (1, "Caste", rows.sums(sc="sc_population_total", st="st_population_total")),
    7: (1, "Population", rows.group("census_year", n="CAST(count(*) AS BIGINT)").calc(year_no="CAST(census_year AS BIGINT)").pick("year_no", "n")),
    8: (1, "Employment", rows.sums(**{o: f"{o}_total" for o in _occupations})),
    9: (1, "Geography", places.group(*S, districts="CAST(count(DISTINCT district) AS BIGINT)").top(10, "districts desc", "state")),
    10: (1, "Population", rows.sums(everyone="population_total", male="population_male", female="population_female")),
    11: (2, "Population", rows.sums(*S, **_pop).top(None, "population desc", "state")),
    12: (2, "Population", rows.sums(*SD, total_households="households").top(20, "total_households desc", "state", "district")),
    13: (2, "Literacy", rows.sums(*S, literate="literate_total", illiterate="illiterate_total").calc(rate=ratio("literate", "literate + illiterate")).top(None, "rate desc", "state")),
    14: (2, "Caste", rows.sums(*S, sc="sc_population_total", st="st_population_total", **_pop).top(None, "st desc", "state")),
    15: (2, "Employment", rows.sums(*S, workers="working_total", non_workers="non_workers_total").calc(rate=ratio("workers", "workers + non_workers")).top(None, "rate desc", "state")),
    16: (2, "Population", rows.sums("state", "residence_type", **_pop).top(None, "state", "residence_type")),
    17: (2, "Literacy", rows.sums(*S, male="literate_male", female="literate_female").calc(male_to_female=ratio("male", "female", 1)).top(None, "male_to_female desc", "state")),
    18: (2, "Employment", rows.sums(*S, cultivators="cultivators_total", labourers="agri_labourers_total").top(None, "cultivators desc", "state")),
    19: (2, "Population", rows.sums(*S, children="population_0_6_total", **_pop).calc(child_pct=ratio("children", "population")).top(None, "child_pct desc", "state")),
    20: (2, "Employment", rows.sums(*S, main="main_workers_total", marginal="marginal_workers_total").top(None, "main desc", "state")),
    21: (2, "Caste", rows.sums(*SD, st="st_population_total", **_pop).where("st > 0").calc(st_pct=ratio("st", "population")).pick(*SD, "st", "st_pct").top(20, "st_pct desc", "state", "district")),
    22: (2, "Geography", places.group(*SD, sub_districts="CAST(count(DISTINCT sub_district) AS BIGINT)", villages="CAST(count(DISTINCT village) AS BIGINT)").top(20, "villages desc", "state", "district")),
    23: (2, "Population", rows.sums(*S, male="population_male", female="population_female").calc(sex_ratio=ratio("female", "male", 1000, 0)).top(None, "sex_ratio desc", "state")),
    24: (2, "Employment", rows.sums(*S, **{f"marginal_{o}": f"m_{o}_total" for o in _occupations}).top(None, "marginal_cultivators desc", "state")),
    25: (2, "Literacy", rows.sums("state", "residence_type", literate="literate_total", illiterate="illiterate_total").top(None, "state", "residence_type")),
    26: (3, "Population", rows.sums(*S, **_pop).calc(place=over("rank()", "population DESC"))),
    27: (3, "Literacy", rows.sums(*SD, literate="literate_total", total="literate_total + illiterate_total").where("total > 0").calc(rate=ratio("literate", "total"), place=over("rank()", "literate * 100.0 / nullif(total, 0) DESC", "state")).pick(*SD, "rate", "place")),
    28: (3, "Employment", rows.sums(*SD, female="working_female", workers="working_total").where("workers > 1000").calc(female_pct=ratio("female", "workers")).calc(level="CASE WHEN female_pct >= 50 THEN 'High' WHEN female_pct >= 45 THEN 'Medium' ELSE 'Low' END").pick(*SD, "workers", "female_pct", "level").top(None, "female_pct desc", "state", "district")),
    29: (3, "Caste", rows.sums(*S, sc="sc_population_total", st="st_population_total", **_pop).calc(sc_pct=ratio("sc", "population"), st_pct=ratio("st", "population")).calc(kind="CASE WHEN st_pct > 50 THEN 'ST Majority' WHEN sc_pct > 22 THEN 'High SC' ELSE 'General' END").pick("state", "sc_pct", "st_pct", "kind").top(None, "st_pct desc", "state")),
    30: (3, "Population", rows.sums(*S, total_households="households", **_pop).where("total_households > 0").calc(mean_size=ratio("population", "total_households", 1), place=over("dense_rank()", "population * 1.0 / nullif(total_households, 0) DESC"))),
    31: (3, "Employment", rows.sums(*S, **{f"s_{o}": f"{o}_total" for o in _occupations}).calc(economy="CASE WHEN s_cultivators + s_agri_labourers > s_household_industry + s_other_workers THEN 'Agricultural' ELSE 'Non-Agricultural' END").top(None, "s_cultivators + s_agri_labourers desc", "state")),
    32: (3, "Geography", rows.sums(*SD, **_pop).calc(of_state=over("sum(population)", by="state")).calc(pct=ratio("population", "of_state")).top(None, "state", "population desc", "district")),
    33: (3, "Literacy", rows.sums(*S, ml="literate_male", fl="literate_female", mp="population_male", fp="population_female").calc(male=ratio("ml", "mp"), female=ratio("fl", "fp")).calc(gap="round(male - female, 2)").pick("state", "male", "female", "gap").top(None, "gap desc", "state")),
    34: (3, "Employment", rows.sums(*S, main="main_workers_total", marginal="marginal_workers_total").calc(pct=ratio("marginal", "main + marginal"), place=over("row_number()", "marginal * 100.0 / nullif(main + marginal, 0) DESC, state"))),
    35: (3, "Population", rows.sums(*S, urban="CASE WHEN residence_type = 'Urban' THEN population_total ELSE 0 END", rural="CASE WHEN residence_type = 'Rural' THEN population_total ELSE 0 END").where("urban + rural > 0").calc(rate=ratio("urban", "urban + rural")).top(None, "rate desc", "state")),
    36: (3, "Caste", rows.sums(*S, scm="sc_population_male", scf="sc_population_female", stm="st_population_male", stf="st_population_female").where("scm > 0 OR stm > 0").calc(sc_ratio=ratio("scf", "scm", 1000, 0), st_ratio=ratio("stf", "stm", 1000, 0)).pick("state", "sc_ratio", "st_ratio").top(None, "sc_ratio desc", "state")),
    37: (3, "Geography", rows.group("state", "district", "sub_district", population="CAST(sum(population_total) AS BIGINT)", villages="CAST(count(DISTINCT village) AS BIGINT)").where("villages > 0").calc(mean_village=ratio("population", "villages", 1, 0), place=over("rank()", "population DESC", "state"))),
    38: (4, "Population", rows.sums(*S, total_households="households", **_pop).join(_literacy, "state").join(rows.sums(*S, workers="working_total"), "state").calc(literacy=ratio("literate", "assessed"), employment=ratio("workers", "population")).pick("state", "population", "total_households", "literacy", "employment").top(None, "population desc", "state")),
    39: (4, "Caste", rows.sums(*SD, sc="sc_population_total", st="st_population_total", **_pop).where("population > 10000").join(rows.sums(*SD, literate="literate_total", assessed="literate_total + illiterate_total"), *SD).calc(sc_st_pct=ratio("sc + st", "population"), literacy=ratio("literate", "assessed")).pick(*SD, "sc_st_pct", "literacy").top(30, "sc_st_pct desc", "state", "district")),
    40: (4, "Employment", rows.sums(*S, **{f"a_{o}": f"{o}_total" for o in _occupations}).join(rows.sums(*S, **{f"b_{o}": f"m_{o}_total" for o in _occupations}), "state").calc(**{f"all_{o}": f"a_{o} + b_{o}" for o in _occupations}, marginal_pct=ratio("b_cultivators", "a_cultivators + b_cultivators")).pick("state", *[f"all_{o}" for o in _occupations], "marginal_pct").top(None, "all_cultivators desc", "state")),
    41: (4, "Literacy", _residence_literacy("Rural", "rural").join(_residence_literacy("Urban", "urban"), "state", how="left").top(None, "state")),
    42: (4, "Geography", rows.group(*SD, population="CAST(sum(population_total) AS BIGINT)", villages="CAST(count(DISTINCT village) AS BIGINT)").join(rows.sums(*SD, p="population_total").group(*S, mean_pop="avg(p)"), "state").calc(against_state="round(population / mean_pop, 2)", size="CASE WHEN population > mean_pop * 1.2 THEN 'Large' WHEN population < mean_pop * 0.8 THEN 'Small' ELSE 'Medium' END").pick(*SD, "population", "villages", "against_state", "size").top(None, "population desc", "state", "district")),
    43: (4, "Employment", _gender_rates(S).calc(place=over("rank()", "gap DESC")).top(None, "gap desc", "state")),
    44: (4, "Caste", rows.sums(*S, scm="sc_population_male", scf="sc_population_female", sc="sc_population_total").where("sc > 0").join(rows.sums(*S, everyone="population_total"), "state").calc(sc_pct=ratio("sc", "everyone"), sex_ratio=ratio("scf", "scm", 1000, 0)).pick("state", "sc", "sc_pct", "sex_ratio").top(None, "sc_pct desc", "state")),
    45: (4, "Population", rows.sums(*SD, children="population_0_6_total", cm="population_0_6_male", cf="population_0_6_female", **_pop).where("children > 1000").calc(child_pct=ratio("children", "population"), sex_ratio=ratio("cf", "cm", 1000, 0)).calc(state_mean="round(" + over("avg(sex_ratio)", by="state", as_long=False) + ", 6)").calc(deviation="round(sex_ratio - state_mean, 4)").pick(*SD, "children", "child_pct", "sex_ratio", "state_mean", "deviation").top(None, "sex_ratio", "state", "district")),
    46: (5, "Employment", _gender_rates(SD).calc(mean_gap="round(" + over("avg(gap)", as_long=False) + ", 6)", std_gap="round(" + over("stddev_samp(gap)", as_long=False) + ", 6)").calc(national="round(mean_gap, 2)", category="CASE WHEN gap > mean_gap + std_gap THEN 'Significantly Above' WHEN gap > mean_gap THEN 'Above' WHEN gap < mean_gap - std_gap THEN 'Significantly Below' ELSE 'Below' END").pick(*SD, "male_rate", "female_rate", "gap", "national", "category").top(None, "gap desc", "state", "district")),
    47: (5, "Literacy", rows.sums(*SD, literate="literate_total", assessed="literate_total + illiterate_total", sc_st="sc_population_total + st_population_total", **_pop).where("population > 10000").calc(literacy=ratio("literate", "assessed"), sc_st_pct=ratio("sc_st", "population")).calc(q=over("ntile(4)", "literacy, state, district"), r=over("ntile(4)", "sc_st_pct DESC, state, district")).calc(literacy_group="CASE q WHEN 1 THEN 'Low' WHEN 2 THEN 'Below Average' WHEN 3 THEN 'Above Average' ELSE 'High' END", sc_st_group="CASE r WHEN 1 THEN 'High' WHEN 2 THEN 'Above Average' WHEN 3 THEN 'Below Average' ELSE 'Low' END").pick(*SD, "literacy", "sc_st_pct", "literacy_group", "sc_st_group").top(None, "literacy desc", "state", "district")),
    48: (5, "Geography", _sub_districts.join(_sub_districts.group(*SD, district_total="CAST(sum(total) AS BIGINT)", mean_size="avg(mean)"), *SD).calc(mean_village="round(mean, 0)", pct=ratio("total", "district_total"), place=over("rank()", "total DESC", "state, district")).pick(*SD, "sub_district", "villages", "total", "mean_village", "least", "most", "pct", "place").top(None, "state", "district", "place", "sub_district")),
    49: (5, "Caste", rows.sums(*S, sc="sc_population_total", st="st_population_total", literate="literate_total", assessed="literate_total + illiterate_total", workers="working_total", **_pop).calc(sc_pct=ratio("sc", "population"), st_pct=ratio("st", "population"), literacy=ratio("literate", "assessed"), work=ratio("workers", "population")).calc(**{f"{x}_rank": over("rank()", f"{x} DESC") for x in ("sc_pct", "st_pct", "literacy", "work")}).calc(composite="CAST(sc_pct_rank + st_pct_rank + literacy_rank + work_rank AS DOUBLE) / 4").pick("state", "sc_pct", "st_pct", "literacy", "work", "sc_pct_rank", "st_pct_rank", "literacy_rank", "work_rank", "composite").top(None, "composite", "state")),
    50: (5, "Employment", _economy.join(_economy.group(national_raw="avg(agri_pct)")).calc(national="round(national_raw, 2)", deviation="round(agri_pct - national_raw, 2)").pick("state", *[f"{o}_pct" for o in _occupations], "agri_pct", "other_sector_pct", "economy", "national", "deviation").top(None, "agri_pct desc", "state")),
}


def _query(pipe: Pipe) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made: dict[str, DataFrame] = {}

        def source(name: str) -> DataFrame:
            return made.setdefault(name, (locations if name == "locations" else census)(spark, sf_dir))

        return pipe.merged().run(source)

    return run


QUERIES = {f"census_q{i:02d}": _query(pipe) for i, (_, _, pipe) in WORKLOAD.items()}
SQL = {f"census_q{i:02d}": f"WITH {SQL_SOURCES} SELECT * FROM ({pipe.sql()})" for i, (_, _, pipe) in WORKLOAD.items()}
