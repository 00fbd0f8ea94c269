"""Queries of the data-quality operators (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import spikes
from starloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of implausible coliform readings, each once."""
    found = spikes.implausible(read_table(spark, sf_dir, "fact_coliforms"))
    return found.select(F.col("_id").alias("fact_coliforms_id")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per station: readings, and implausible ones by kind."""
    spec = spikes.SpikeSpec()
    table = read_table(spark, sf_dir, "fact_coliforms")
    found = spikes.implausible(table, spec).distinct()
    kinds = found.groupBy("_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("impossible", "spike", "stuck")])
    rows = spikes.readings(table, spec).join(kinds, "_id", "left")
    return rows.groupBy(F.col("_src").cast("long").alias("station_id")).agg(F.count("*").alias("readings"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("impossible", "spike", "stuck")])


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_P1 = """
WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_coliforms_id ORDER BY loaded_at) AS rn FROM fact_coliforms) WHERE rn = 1),
r AS (SELECT fact_coliforms_id AS id, station_id, year, sample_seq, max_fecal_coliform_mpn_per_100ml AS v FROM first WHERE max_fecal_coliform_mpn_per_100ml IS NOT NULL),
bad AS (SELECT id FROM r WHERE isnan(v) OR v < 0 OR v > 1e12),
ok AS (SELECT id, station_id, log10(greatest(v, 1e-9)) AS u FROM r WHERE id NOT IN (SELECT id FROM bad)),
lev AS (SELECT station_id, count(*) AS n, median(u) AS m FROM ok GROUP BY station_id HAVING count(*) >= 8),
sca AS (SELECT o.station_id, 1.4826 * median(abs(o.u - l.m)) AS s FROM ok o JOIN lev l ON o.station_id = l.station_id GROUP BY o.station_id),
spike AS (SELECT o.id FROM ok o JOIN lev l ON o.station_id = l.station_id JOIN sca s ON s.station_id = o.station_id WHERE abs(o.u - l.m) >= 1 AND abs(o.u - l.m) > 5 * s.s),
e AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new_run FROM r WINDOW w AS (PARTITION BY station_id ORDER BY year, sample_seq, id)),
g AS (SELECT *, sum(new_run) OVER (PARTITION BY station_id ORDER BY year, sample_seq, id) AS run FROM e),
stuck AS (SELECT id FROM (SELECT id, v, count(*) OVER (PARTITION BY station_id, run) AS k FROM g) WHERE k >= 5 AND v <> 1.8)
"""

SQL = {
    "p1_found": _P1 + "SELECT id AS fact_coliforms_id FROM bad UNION SELECT id FROM spike UNION SELECT id FROM stuck",
    "p1_report": _P1 + """SELECT r.station_id, count(*) AS readings,
 CAST(count(CASE WHEN r.id IN (SELECT id FROM bad) THEN 1 END) AS BIGINT) AS impossible,
 CAST(count(CASE WHEN r.id IN (SELECT id FROM spike) THEN 1 END) AS BIGINT) AS spike,
 CAST(count(CASE WHEN r.id IN (SELECT id FROM stuck) THEN 1 END) AS BIGINT) AS stuck
FROM r GROUP BY r.station_id""",
}
