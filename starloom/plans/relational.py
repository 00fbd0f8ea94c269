"""Relational workload in PostgreSQL's words over the order tables: run through the dialect here, unchanged in the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starloom.dialect import to_spark
from starloom.session import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


STAR = "region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey"
MONEY = "cast(sum(cast(o_totalprice AS decimal(18,2))) AS double precision)"
PER_NATION = f"SELECT r_name, n_name, cast(count(*) AS bigint) AS n, {MONEY} AS total FROM {STAR} GROUP BY r_name, n_name"

TEXTS: dict[str, str] = {
    # flagship: returned lines by region, guarded ratio
    "literacy_rate": f"""SELECT r.r_name AS state, count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS literate, count(*) AS assessed, round(cast(100.0 * count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) / nullif(count(*), 0) AS double precision), 2) AS rate
FROM {STAR} JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name ORDER BY rate DESC, state""",
    # aggregates
    "count_by_state": "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY n DESC, r_name",
    "sum_by_residence": f"SELECT o_orderstatus, {MONEY} AS total FROM orders GROUP BY o_orderstatus",
    "global_sums": f"SELECT count(*) AS n, {MONEY} AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders",
    "average_price": "SELECT p_brand, round(avg(p_retailprice)::numeric(20,6)::double precision, 4) AS mean FROM part GROUP BY p_brand",
    "distinct_counts_topk": "SELECT r_name, count(DISTINCT n_name) AS nations, count(DISTINCT c_mktsegment) AS segments FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name ORDER BY nations DESC, r_name LIMIT 3",
    "group_by_four": f"SELECT r_name, n_name, c_mktsegment, o_orderstatus, count(*) AS n FROM {STAR} GROUP BY r_name, n_name, c_mktsegment, o_orderstatus",
    "having_topk": f"SELECT n_name, count(*) AS n FROM {STAR} GROUP BY n_name HAVING count(*) > 100 ORDER BY n DESC, n_name LIMIT 10",
    "having_scalar": f"SELECT n_name, count(*) AS n FROM {STAR} GROUP BY n_name HAVING count(*) > (SELECT count(*) / 25.0 FROM orders)",
    "conditional_agg_urbanization": f"SELECT r_name, cast(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS bigint) AS urban, cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS rural FROM {STAR} GROUP BY r_name",
    "filtered_agg": f"SELECT r_name, count(*) FILTER (WHERE o_orderstatus = 'O') AS urban, count(*) AS n FROM {STAR} GROUP BY r_name",
    "nested_aggregates": f"WITH d AS ({PER_NATION}) SELECT r_name, cast(avg(n) AS double precision) AS mean_n, min(n) AS least, max(n) AS most FROM d GROUP BY r_name",
    "order_by_hidden_aggregate": "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 5",
    "string_agg_names": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    "percentile_price": "SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS mid FROM part GROUP BY p_brand",
    "rollup_sales": f"SELECT r_name, n_name, count(*) AS n FROM {STAR} GROUP BY ROLLUP (r_name, n_name)",
    # windows
    "rank_global": f"SELECT n_name, total, cast(rank() OVER (ORDER BY total DESC) AS bigint) AS place FROM ({PER_NATION}) d",
    "rank_partitioned": f"SELECT r_name, n_name, cast(rank() OVER (PARTITION BY r_name ORDER BY total DESC) AS bigint) AS place FROM ({PER_NATION}) d",
    "dense_rank_ratio": f"SELECT n_name, cast(dense_rank() OVER (ORDER BY n DESC) AS bigint) AS place FROM ({PER_NATION}) d",
    "row_number_tiebreak": f"SELECT n_name, cast(row_number() OVER (ORDER BY n DESC, n_name) AS bigint) AS place FROM ({PER_NATION}) d",
    "ntile_quartiles": f"SELECT n_name, cast(ntile(4) OVER (ORDER BY total DESC, n_name) AS bigint) AS q FROM ({PER_NATION}) d",
    "pct_of_partition": f"SELECT r_name, n_name, round(n * 100.0 / sum(n) OVER (PARTITION BY r_name), 2)::double precision AS pct FROM ({PER_NATION}) d",
    "avg_deviation_partition": f"SELECT r_name, n_name, round(n - avg(n) OVER (PARTITION BY r_name), 6)::double precision AS deviation FROM ({PER_NATION}) d",
    "stddev_band_case": f"SELECT n_name, CASE WHEN n > m + s THEN 'high' WHEN n < m - s THEN 'low' ELSE 'middle' END AS band FROM (SELECT n_name, n, avg(n) OVER () AS m, stddev_samp(n) OVER () AS s FROM ({PER_NATION}) d) e",
    "multi_rank_composite": f"SELECT n_name, (rank() OVER (ORDER BY n DESC) + rank() OVER (ORDER BY total DESC)) / 2.0::double precision AS composite FROM ({PER_NATION}) d",
    # joins
    "inner_one_key": "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    "multi_key_join": "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A') b ON a.p = b.p AND a.s = b.s",
    "multi_cte_join": f"WITH a AS ({PER_NATION}), b AS (SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name) SELECT a.r_name, a.n_name, a.n, b.customers FROM a JOIN b ON a.n_name = b.n_name",
    "left_join_rural_urban": "WITH u AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) SELECT u.k, u.n, f.n AS other FROM u LEFT JOIN f ON u.k = f.k",
    "right_join": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000",
    "full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS n1, b.n AS n2 FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < -900 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY s_nationkey) b ON a.k = b.k",
    "cross_join_national_avg": f"WITH d AS ({PER_NATION}), m AS (SELECT avg(n) AS mean FROM d) SELECT d.n_name, round(d.n - m.mean, 6)::double precision AS deviation FROM d CROSS JOIN m",
    "semi_in": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey > 5 THEN s_nationkey END FROM supplier)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
    "exists_correlated": "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)",
    "self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "natural_join": "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) y",
    "recursive_hierarchy": "WITH RECURSIVE t(k, depth) AS (SELECT r_regionkey, 1 FROM region WHERE r_regionkey = 0 UNION ALL SELECT r_regionkey, depth + 1 FROM region JOIN t ON r_regionkey = k + 1) SELECT k, depth FROM t",
    # set operations
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT 'c' AS src, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier",
    "intersect_sets": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_sets": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    # sorting and limits
    "order_expression": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey * 100 + n_nationkey DESC LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 10",
    "fetch_first": "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey FETCH FIRST 7 ROWS ONLY",
    "null_order": "SELECT k, v, cast(row_number() OVER (ORDER BY v NULLS LAST, k) AS bigint) AS last_place, cast(row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS bigint) AS first_place FROM (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer) q",
    # scalar functions and predicates
    "arithmetic": "SELECT o_orderkey, round(cast(o_totalprice * 100.0 / 4.0 AS double precision), 2) AS x FROM orders WHERE o_totalprice - 1000 > 350000",
    "case_simple": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "between_like_ilike": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND (p_type LIKE '%ECON%' OR p_name ILIKE '%RED%')",
    "in_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority",
    "cast_left": "SELECT DISTINCT left(p_brand::text, 7) AS b, CAST(p_size AS text) AS s FROM part WHERE p_size < 4",
    "null_predicates": "SELECT count(*) AS n, count(v) AS given FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS v FROM customer) q WHERE v IS NULL OR v IS NOT NULL",
    "quoted_identifiers": 'SELECT "n_name", count(*) AS "how many" FROM "nation" JOIN "customer" ON "c_nationkey" = "n_nationkey" GROUP BY "n_name"',
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(to_spark(text))

    return run


QUERIES = {name: _query(text) for name, text in TEXTS.items()}
SQL = dict(TEXTS)
literacy_rate = QUERIES["literacy_rate"]
