"""The SQL a user may send: one query for each category, in Spark SQL over named views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.registry import query

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables that the text names."""
    for t in _TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def statement(name: str, spark_sql: str, oracle: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query given as text; the oracle is the same text unless the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_sql)
        return spark.sql(spark_sql)

    run.__module__ = __name__
    return query(name, oracle or spark_sql)(run)


statement("sql_inner_join", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
statement("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
statement("sql_right_join", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
statement("sql_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k")
statement("sql_cross_join", "SELECT r_name, x FROM region CROSS JOIN (VALUES (1), (2)) AS v(x)")
statement("sql_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
statement("sql_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
statement(
    "sql_asof", "SELECT p.event_id, max_by(s.event_id, struct(s.ts, s.event_id)) AS last_signup FROM events p JOIN events s ON p.user_id = s.user_id AND s.ts <= p.ts AND s.event_type = 'signup' WHERE p.event_type = 'purchase' GROUP BY p.event_id",
    "SELECT p.event_id, s.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts")
statement("sql_lateral", "SELECT n_name, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
statement("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
statement("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
statement("sql_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
statement("sql_distinct_filter", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 40) AS large FROM lineitem GROUP BY l_returnflag")
statement("sql_rank_frames", """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
statement("sql_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS last_day FROM events")
statement("sql_set_ops", "SELECT 'except' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
statement("sql_pivot", "SELECT * FROM (SELECT l_shipdate, l_returnflag, l_linestatus, l_linenumber FROM lineitem) PIVOT (count(l_shipdate) AS n FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))", "SELECT l_linestatus, l_linenumber, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS a, nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS n, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY ALL")
statement("sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
statement("sql_json", "SELECT event_id, get_json_object(props, '$.k') AS k, length(props) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(length(props) AS INT) AS n FROM events")
statement("sql_arrays", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS total FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
statement("sql_strings", "SELECT p_partkey, upper(p_name) AS name, substring(p_type, 1, 5) AS kind, concat(p_brand, '-', p_size) AS label FROM part", "SELECT p_partkey, upper(p_name) AS name, substring(p_type, 1, 5) AS kind, concat(p_brand, '-', p_size) AS label FROM part")
statement("sql_dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
statement("sql_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
statement("sql_qualify", "SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3", "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
statement("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
statement("sql_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
