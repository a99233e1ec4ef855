"""Scans, predicates, joins, subqueries, aggregation, pivoting, set operations, CTEs."""

from __future__ import annotations

from tidewater.plans.runner import Query as Q

QUERIES = [
    Q(
        "top_n",
        "SELECT TOP 10 c.c_name, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus <> 'P' GROUP BY c.c_name ORDER BY total DESC, c.c_name",
        "SELECT c.c_name, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus <> 'P' GROUP BY c.c_name ORDER BY total DESC, c.c_name LIMIT 10",
    ),
    Q(
        "scan_filter_project",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_shipdate FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_quantity < 5 AND l_returnflag = 'R'",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 5 AND l_returnflag = 'R'",
    ),
    Q("select_star", "SELECT * FROM nation WHERE n_regionkey = 1", "SELECT * FROM nation WHERE n_regionkey = 1"),
    Q("select_alias_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
    Q("dual", "SELECT 1 AS one, 'x' AS letter, NULLIF(1, 1) AS nothing", "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INTEGER) AS nothing"),
    Q("offset_fetch", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 20 ROWS FETCH NEXT 15 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20"),
    Q("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    Q("order_by_unprojected", "SELECT TOP 20 c_name FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20"),
    Q("order_by_ordinal", "SELECT TOP 7 s_name, s_suppkey FROM supplier ORDER BY 2 DESC", "SELECT s_name, s_suppkey FROM supplier ORDER BY 2 DESC LIMIT 7"),
    Q("top_expression", "SELECT TOP (2 + 3) p_partkey FROM part ORDER BY p_partkey DESC", "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 5"),
    Q(
        "case_when",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    ),
    Q(
        "in_between_like",
        "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 15) AND p_retailprice BETWEEN 900 AND 1500 AND p_name NOT LIKE '%zz%'",
        "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 15) AND p_retailprice BETWEEN 900 AND 1500 AND p_name NOT ILIKE '%zz%'",
    ),
    Q("like_escape_ci", "SELECT c_custkey FROM customer WHERE c_name LIKE 'CUSTOMER!#_______1_' ESCAPE '!'", "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER!#_______1_' ESCAPE '!'"),
    Q(
        "kleene_logic",
        "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND NULLIF(p_size, 20) IS NOT NULL) OR NULLIF(p_size, 7) IS NULL",
        "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND NULLIF(p_size, 20) IS NOT NULL) OR NULLIF(p_size, 7) IS NULL",
    ),
    Q(
        "int_division",
        "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size / 7 AS n FROM part",
        "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, CAST(p_size % 7 AS BIGINT) AS r, CAST(-p_size // 7 AS BIGINT) AS n FROM part",
    ),
    Q(
        "decimal_arith",
        "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.05 + 0.10 AS FLOAT) AS raised, CAST(CAST(p_retailprice AS DECIMAL(10,2)) / 3 AS FLOAT) AS third, CAST(CAST(p_retailprice AS MONEY) AS FLOAT) AS money FROM part",
        "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.05 + 0.10 AS DOUBLE) AS raised, CAST(TRUNC(CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(28,12)) * 1000000 / 3) AS DOUBLE) / 1000000 AS third, CAST(CAST(p_retailprice AS DECIMAL(19,4)) AS DOUBLE) AS money FROM part",
    ),
    Q("bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, p_size ^ 5 AS x, ~p_size AS n FROM part", "SELECT p_partkey, CAST(p_size & 6 AS BIGINT) AS a, CAST(p_size | 8 AS BIGINT) AS o, CAST(xor(p_size, 5) AS BIGINT) AS x, CAST(~p_size AS BIGINT) AS n FROM part"),
    Q("string_concat", "SELECT n_nationkey, n_name + '-' + CAST(n_regionkey AS VARCHAR(5)) + NULLIF('', 'x') AS tag FROM nation", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation"),
    Q(
        "cast_try_cast",
        "SELECT p_partkey, CAST(p_retailprice AS INT) AS whole, TRY_CAST(p_name AS INT) AS bad, CAST(p_size AS VARCHAR(10)) AS txt, TRY_CAST('2024-02-30' AS DATE) AS nodate, CAST(p_size AS BIT) AS flag FROM part",
        "SELECT p_partkey, CAST(TRUNC(p_retailprice) AS INTEGER) AS whole, TRY_CAST(p_name AS INTEGER) AS bad, CAST(p_size AS VARCHAR) AS txt, CAST(NULL AS DATE) AS nodate, p_size <> 0 AS flag FROM part",
    ),
    Q(
        "convert_styles",
        "SELECT o_orderkey, CONVERT(VARCHAR(30), o_orderdate, 101) AS us, CONVERT(VARCHAR(30), o_orderdate, 103) AS uk, CONVERT(VARCHAR(30), o_orderdate, 112) AS iso, CONVERT(VARCHAR(30), o_orderdate, 120) AS odbc, CONVERT(VARCHAR(30), o_orderdate, 106) AS long FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y') AS uk, strftime(o_orderdate, '%Y%m%d') AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS odbc, strftime(o_orderdate, '%d %b %Y') AS long FROM orders",
    ),
    # joins
    Q("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 400000", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 400000"),
    Q("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000"),
    Q("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT OUTER JOIN nation n ON n.n_nationkey = s.s_nationkey", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey"),
    Q("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON s.s_suppkey = c.c_custkey AND s.s_nationkey <> c.c_nationkey", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON s.s_suppkey = c.c_custkey AND s.s_nationkey <> c.c_nationkey"),
    Q("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    Q("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey"),
    Q("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a RIGHT JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a RIGHT JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    Q("join_self", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    Q("join_grouped", "SELECT r.r_name, x.n_name, x.s_suppkey FROM region r LEFT JOIN (nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey) x ON x.n_regionkey = r.r_regionkey", "SELECT r.r_name, x.n_name, x.s_suppkey FROM region r LEFT JOIN (SELECT * FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey) x ON x.n_regionkey = r.r_regionkey"),
    Q("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)"),
    Q("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"),
    Q("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)"),
    Q("not_in_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)"),
    Q("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM region)"),
    Q("scalar_subquery_corr", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c"),
    Q("quantified_all_any", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part) AND p_partkey > ANY (SELECT n_nationkey FROM nation)", "SELECT p_partkey FROM part WHERE p_size >= (SELECT MAX(p_size) FROM part) AND p_partkey > (SELECT MIN(n_nationkey) FROM nation)"),
    Q("derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d(k, n) WHERE d.n > 12", "SELECT d.k, d.n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d(k, n) WHERE d.n > 12"),
    Q("values_ctor", "SELECT v.id, v.name, n.n_name FROM (VALUES (1, 'a'), (2, 'b'), (99, NULL)) AS v(id, name) LEFT JOIN nation n ON n.n_nationkey = v.id", "SELECT v.id, v.name, n.n_name FROM (VALUES (1, 'a'), (2, 'b'), (99, NULL)) AS v(id, name) LEFT JOIN nation n ON n.n_nationkey = v.id"),
    # APPLY
    Q(
        "cross_apply_topn",
        "SELECT c.c_custkey, x.o_orderkey, x.o_totalprice FROM customer c CROSS APPLY (SELECT TOP 2 o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey) x",
        "SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    ),
    Q(
        "outer_apply",
        "SELECT n.n_name, x.s_name FROM nation n OUTER APPLY (SELECT TOP 1 s_name FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey) x",
        "SELECT n.n_name, x.s_name FROM nation n LEFT JOIN (SELECT s_nationkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) x ON x.s_nationkey = n.n_nationkey",
    ),
    Q(
        "string_split_apply",
        "SELECT p.p_partkey, s.ordinal, s.value FROM part p CROSS APPLY STRING_SPLIT(p.p_name, ' ', 1) s",
        "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS BIGINT) AS ordinal, unnest(string_split(p_name, ' ')) AS value FROM part",
    ),
    Q(
        "openjson_apply",
        "SELECT e.event_id, j.[key], j.value, j.type FROM events e CROSS APPLY OPENJSON(e.props) j",
        "SELECT event_id, k AS key, props::JSON ->> k AS value, CASE json_type(props::JSON -> k) WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 3 WHEN 'ARRAY' THEN 4 WHEN 'OBJECT' THEN 5 WHEN 'NULL' THEN 0 ELSE 2 END AS type FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    ),
    # aggregation
    Q(
        "group_by_having",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_quantity), 6) AS qty FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 100",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_quantity), 6) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 100",
    ),
    Q("group_by_expr", "SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate)", "SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, COUNT(*) AS n FROM orders GROUP BY ALL"),
    Q("global_aggregate", "SELECT COUNT(*) AS n, SUM(p_size) AS s, MIN(p_name) AS a, MAX(p_retailprice) AS b, SUM(p_size) + 1 AS c FROM part WHERE p_size < 0", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_name) AS a, MAX(p_retailprice) AS b, CAST(SUM(p_size) + 1 AS BIGINT) AS c FROM part WHERE p_size < 0"),
    Q("agg_int_avg", "SELECT p_brand, AVG(p_size) AS a, SUM(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) // COUNT(p_size) AS INTEGER) AS a, CAST(SUM(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand"),
    Q("count_distinct", "SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS d, SUM(DISTINCT YEAR(o_orderdate)) AS y FROM orders GROUP BY o_custkey", "SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS d, CAST(SUM(DISTINCT YEAR(o_orderdate)) AS BIGINT) AS y FROM orders GROUP BY o_custkey"),
    Q("string_agg_ordered", "SELECT n_regionkey, STRING_AGG(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    Q("group_null", "SELECT NULLIF(p_size % 3, 0) AS g, COUNT(*) AS n, COUNT(NULLIF(p_size % 3, 0)) AS k FROM part GROUP BY NULLIF(p_size % 3, 0)", "SELECT CAST(NULLIF(p_size % 3, 0) AS BIGINT) AS g, COUNT(*) AS n, COUNT(NULLIF(p_size % 3, 0)) AS k FROM part GROUP BY 1"),
    Q(
        "pivot_sum",
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, CAST(o_totalprice AS INT) AS price FROM orders) d PIVOT (SUM(price) FOR o_orderstatus IN ([F], [O], [X])) p",
        "SELECT o_orderpriority, CAST(SUM(CAST(trunc(o_totalprice) AS INTEGER)) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(SUM(CAST(trunc(o_totalprice) AS INTEGER)) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(NULL AS BIGINT) AS X FROM orders GROUP BY o_orderpriority",
    ),
    Q(
        "pivot_stdev",
        "SELECT p.l_returnflag, ROUND(p.[O], 6) AS o, ROUND(p.[F], 6) AS f FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) d PIVOT (STDEV(l_quantity) FOR l_linestatus IN ([O], [F])) p",
        "SELECT l_returnflag, ROUND(stddev_samp(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o, ROUND(stddev_samp(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f FROM lineitem GROUP BY l_returnflag",
    ),
    Q(
        "unpivot_skip_null",
        "SELECT u.p_partkey, u.attr, u.val FROM (SELECT p_partkey, NULLIF(p_size, 7) AS size, CAST(p_retailprice AS INT) AS price FROM part) d UNPIVOT (val FOR attr IN (size, price)) u",
        "SELECT p_partkey, 'size' AS attr, NULLIF(p_size, 7) AS val FROM part WHERE p_size <> 7 UNION ALL SELECT p_partkey, 'price', CAST(trunc(p_retailprice) AS INTEGER) FROM part",
    ),
    # set operations and CTEs
    Q("union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    Q("union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer ORDER BY k", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
    Q("intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000"),
    Q("except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier"),
    Q(
        "setop_precedence",
        "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT 2",
        "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION (SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)) EXCEPT SELECT 2",
    ),
    Q("setop_order_limit", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region ORDER BY x OFFSET 3 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT x FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region) ORDER BY x LIMIT 5 OFFSET 3"),
    Q(
        "cte_multi",
        "WITH spent(k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), top_(k) AS (SELECT k FROM spent WHERE total > 2000000) SELECT c.c_name, ROUND(s.total, 2) AS total FROM top_ t JOIN spent s ON s.k = t.k JOIN customer c ON c.c_custkey = t.k",
        "WITH spent(k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), top_(k) AS (SELECT k FROM spent WHERE total > 2000000) SELECT c.c_name, ROUND(s.total, 2) AS total FROM top_ t JOIN spent s ON s.k = t.k JOIN customer c ON c.c_custkey = t.k",
    ),
    Q(
        "cte_recursive",
        "WITH r(n, fact) AS (SELECT 1, 1 UNION ALL SELECT n + 1, fact * (n + 1) FROM r WHERE n < 15) SELECT n, fact FROM r",
        "WITH RECURSIVE r(n, fact) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, fact * (n + 1) FROM r WHERE n < 15) SELECT n, fact FROM r",
    ),
    Q("three_part_names", "SELECT n.n_name FROM tidewater.dbo.nation AS n WITH (NOLOCK) WHERE n.n_nationkey < 3", "SELECT n_name FROM nation WHERE n_nationkey < 3"),
    Q("rowcount_limit", "SET ROWCOUNT 4; SELECT n_name FROM nation ORDER BY n_nationkey", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4"),
]
