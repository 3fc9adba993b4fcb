"""Statements of the advertised SQL vocabulary, run as they are."""

from __future__ import annotations

from wardlight.plans.registry import delegated

_money = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

delegated("J1", f"SELECT r_name AS hospital, n_name AS department, count(*) AS stays, {_money.format('l_extendedprice')} AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
delegated("J1_left", "SELECT c_mktsegment, count(*) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
delegated("J1_full", "SELECT count(*) AS n, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
delegated("A17", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_money.format('l_quantity')} AS qty, {_money.format('l_quantity')} / count(*) AS avg_qty, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, count(DISTINCT l_suppkey) AS units FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
delegated("A18_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
delegated("A18_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
delegated("A18_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
delegated("W1", """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr,
    lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
delegated("W1_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM events")
delegated("U1_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
delegated("U1_union_all", "SELECT 'unit' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'patient', count(*) FROM customer")
delegated("U1_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
delegated("U1_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
delegated("F28", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 'middle' ELSE 'low' END AS band FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%URGENT' AND NOT o_custkey IS NULL OR o_orderkey < 10")
delegated("F28_exists", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
delegated("F28_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * (max(o_totalprice) / 2) FROM orders)")
delegated("L9", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
delegated("L9_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n ORDER BY n NULLS LAST")
delegated("A17_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
delegated("S29_string", "SELECT c_custkey, concat(upper(c_mktsegment), '-', lower(c_name)) AS a, CAST(length(trim(c_name)) AS BIGINT) AS b, substr(c_name, 1, 4) AS c, substring(c_name, 10, 3) AS d FROM customer")
delegated("S29_math", "SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS a, CAST(floor(s_acctbal) AS BIGINT) AS b, abs(s_acctbal) AS c, power(s_suppkey % 7, 2) AS d, sqrt(abs(s_acctbal)) AS e, mod(s_suppkey, 7) AS f FROM supplier")
delegated("S29_null", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#17'), 'other') AS brand, CAST(p_size AS VARCHAR(10)) AS size FROM part")
delegated("S29_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS due FROM orders")
