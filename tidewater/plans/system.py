"""What a session says of itself and of its objects, definitions, constraints, cursors and loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.versions import shared_dir
from tidewater.plans.runner import Query as Q
from tidewater.plans.runner import open_folder

LANDS = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r INTO t FROM nation; "
KEYED = "CREATE TABLE p (k INT PRIMARY KEY, name NVARCHAR(40)); INSERT INTO p SELECT r_regionkey, r_name FROM region; "
QUERIES = [
    Q(
        "clock_functions",
        "SELECT CAST(GETDATE() AS DATE) AS a, CAST(SYSUTCDATETIME() AS DATE) AS b, CURRENT_DATE AS c, YEAR(CURRENT_TIMESTAMP) AS y, IIF(ABS(DATEDIFF(second, GETUTCDATE(), SYSDATETIME())) < 2, 1, 0) AS near, LEN(CAST(CURRENT_TIME AS VARCHAR(8))) AS t, LEFT(CAST(SYSDATETIMEOFFSET() AS VARCHAR(40)), 4) AS o",
        "SELECT CAST(u AS DATE) AS a, CAST(u AS DATE) AS b, CAST(u AS DATE) AS c, CAST(year(u) AS INTEGER) AS y, 1 AS near, CAST(length(strftime(u, '%H:%M:%S')) AS INTEGER) AS t, strftime(u, '%Y') AS o FROM (SELECT now() AT TIME ZONE 'UTC' AS u)",
    ),
    Q("fn_random", "SELECT n_nationkey, IIF(RAND() >= 0 AND RAND() < 1, 1, 0) AS r, LEN(NEWID()) AS g, IIF(CHECKSUM(n_name, 1) = CHECKSUM(n_name, 1), 1, 0) AS same, IIF(CHECKSUM(n_name) = CHECKSUM(n_name + 'x'), 1, 0) AS other FROM nation", "SELECT n_nationkey, 1 AS r, CAST(length(CAST(uuid() AS VARCHAR)) AS INTEGER) AS g, CAST(n_name = n_name AS INTEGER) AS same, CAST(n_name = n_name || 'x' AS INTEGER) AS other FROM nation"),
    Q("fn_checksum_groups", "SELECT COUNT(*) AS n, COUNT(DISTINCT CHECKSUM(p_brand, p_size)) AS pairs FROM part", "SELECT COUNT(*) AS n, COUNT(DISTINCT (p_brand, p_size)) AS pairs FROM part"),
    Q(
        "fn_math_more",
        "SELECT p_partkey, ROUND(EXP(p_size / 10e0), 6) AS e, ROUND(ASIN(p_size / 100e0), 9) AS s, ROUND(ACOS(p_size / 100e0), 9) AS c, ROUND(ATAN(p_size), 9) AS t, NCHAR(200 + p_size) AS n, PI() AS p FROM part",
        "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(asin(p_size / 100.0), 9) AS s, round(acos(p_size / 100.0), 9) AS c, round(atan(p_size), 9) AS t, chr(CAST(200 + p_size AS INTEGER)) AS n, pi() AS p FROM part",
    ),
    Q("fn_jaro_distance", "SELECT a.n_nationkey AS x, ROUND(CAST(JARO_WINKLER_DISTANCE(a.n_name, r.r_name) AS FLOAT), 9) AS d FROM nation a JOIN region r ON r.r_regionkey = a.n_regionkey", "SELECT n_nationkey AS x, round(1 - jaro_winkler_similarity(n_name, r_name), 9) AS d FROM nation JOIN region ON r_regionkey = n_regionkey"),
    Q(
        "fn_regexp_places",
        "SELECT doc_id, REGEXP_INSTR(text, '[0-9]+') AS a, REGEXP_INSTR(text, '[0-9]+', 1, 1, 1) AS e, REGEXP_INSTR(text, 'zq{3}z') AS none FROM documents",
        "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN CAST(length(regexp_extract(text, '^[^0-9]*')) + 1 AS INTEGER) ELSE 0 END AS a, CASE WHEN regexp_matches(text, '[0-9]') THEN CAST(length(regexp_extract(text, '^[^0-9]*[0-9]+')) + 1 AS INTEGER) ELSE 0 END AS e, 0 AS none FROM documents",
    ),
    Q(
        "fn_json_rows",
        "SELECT event_id, JSON_VALUE(JSON_MODIFY(props, '$.kind', event_type), '$.kind') AS kind, ISJSON(event_type) AS is_json, JSON_PATH_EXISTS(props, '$.k') AS k, JSON_QUERY('{\"p\":' + props + '}', '$.p') AS q, JSON_ARRAY_LENGTH('[' + CAST(user_id AS VARCHAR(20)) + ',2]') AS n FROM events",
        "SELECT event_id, event_type AS kind, json_valid(event_type) AS is_json, json_exists(props, '$.k') AS k, CAST(json(props) AS VARCHAR) AS q, CAST(json_array_length('[' || user_id || ',2]') AS INTEGER) AS n FROM events",
    ),
    Q("fn_isdate", "SELECT o_orderkey, ISDATE(CONVERT(VARCHAR(10), o_orderdate, 120)) AS good, ISDATE(o_orderpriority) AS bad FROM orders", "SELECT o_orderkey, CAST(try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NOT NULL AS INTEGER) AS good, CAST(try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL AS INTEGER) AS bad FROM orders"),
    Q(
        "convert_more_styles",
        "SELECT event_id, " + ", ".join(f"CONVERT(VARCHAR(30), ts, {s}) AS s{s}" for s in (102, 103, 104, 105, 106, 107, 108, 110, 111, 112, 120, 4, 5, 11, 12)) + " FROM events",
        "SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS s{s}" for s, f in ((102, "%Y.%m.%d"), (103, "%d/%m/%Y"), (104, "%d.%m.%Y"), (105, "%d-%m-%Y"), (106, "%d %b %Y"), (107, "%b %d, %Y"), (108, "%H:%M:%S"), (110, "%m-%d-%Y"), (111, "%Y/%m/%d"), (112, "%Y%m%d"), (120, "%Y-%m-%d %H:%M:%S"), (4, "%d.%m.%y"), (5, "%d-%m-%y"), (11, "%y/%m/%d"), (12, "%y%m%d"))) + " FROM events",
    ),
    Q("convert_binary", "SELECT n_nationkey, CONVERT(VARCHAR(20), CAST(n_nationkey * 1000 AS VARBINARY(8)), 2) AS h, CAST(CAST(n_nationkey AS BINARY(4)) AS INT) AS back, CONVERT(VARCHAR(20), CONVERT(VARBINARY(8), n_name), 1) AS s FROM nation", "SELECT n_nationkey, printf('%016X', n_nationkey * 1000) AS h, n_nationkey AS back, '0x' || hex(n_name) AS s FROM nation"),
    Q(
        "pivot_spread",
        "SELECT v.o_orderpriority, ROUND(v.[F], 2) AS v_f, ROUND(v.[O], 2) AS v_o, ROUND(w.[F], 2) AS w_f, ROUND(d.[O], 4) AS d_o FROM (SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) s PIVOT (VAR(o_totalprice) FOR o_orderstatus IN ([F], [O])) p) v JOIN (SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) s PIVOT (VARP(o_totalprice) FOR o_orderstatus IN ([F])) p) w ON w.o_orderpriority = v.o_orderpriority JOIN (SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) s PIVOT (STDEVP(o_totalprice) FOR o_orderstatus IN ([O])) p) d ON d.o_orderpriority = v.o_orderpriority",
        "SELECT o_orderpriority, round(var_samp(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS v_f, round(var_samp(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS v_o, round(var_pop(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS w_f, round(stddev_pop(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS d_o FROM orders GROUP BY o_orderpriority",
    ),
    Q("pivot_count_big", "SELECT o_orderpriority, [F], [O], [P] FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) s PIVOT (COUNT_BIG(o_orderkey) FOR o_orderstatus IN ([F], [O], [P])) p", "SELECT o_orderpriority, nullif(COUNT(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(COUNT(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(COUNT(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_orderpriority"),
    Q(
        "session_identity",
        "CREATE TABLE t (id INT IDENTITY(10, 5), name NVARCHAR(40)); INSERT INTO t (name) SELECT n_name FROM nation; SELECT SCOPE_IDENTITY() AS a, @@IDENTITY AS b, CAST(IDENT_CURRENT('t') AS BIGINT) AS c, CAST(IDENT_SEED('t') AS BIGINT) AS s, CAST(IDENT_INCR('t') AS BIGINT) AS i, MAX(id) AS m FROM t",
        "SELECT CAST(5 + 5 * COUNT(*) AS BIGINT) AS a, CAST(5 + 5 * COUNT(*) AS BIGINT) AS b, CAST(5 + 5 * COUNT(*) AS BIGINT) AS c, CAST(10 AS BIGINT) AS s, CAST(5 AS BIGINT) AS i, CAST(5 + 5 * COUNT(*) AS INTEGER) AS m FROM nation",
    ),
    Q(
        "session_principals",
        "SELECT r_regionkey, SUSER_SNAME() + SUSER_NAME() + ORIGINAL_LOGIN() + SYSTEM_USER AS l, USER_NAME() + SESSION_USER + CURRENT_USER + DATABASE_PRINCIPAL_NAME() AS u, SUSER_ID() + USER_ID() + DATABASE_PRINCIPAL_ID() AS i, CONVERT(VARCHAR(10), SUSER_SID(), 2) + CONVERT(VARCHAR(10), USER_SID(), 2) AS s, APP_NAME() + HOST_NAME() + HOST_ID() AS h, IS_SRVROLEMEMBER('sysadmin') + IS_MEMBER('db_owner') + HAS_DBACCESS('tidewater') + HAS_PERMS_BY_NAME('t', 'OBJECT', 'SELECT') AS m, PERMISSIONS() AS p FROM region",
        "SELECT r_regionkey, repeat('sa', 4) AS l, repeat('dbo', 4) AS u, 3 AS i, '0101' AS s, 'tidewaterlocalhost1' AS h, 4 AS m, 0 AS p FROM region",
    ),
    Q(
        "session_properties",
        "EXEC sp_set_session_context @key = 'lang', @value = 'xy'; SELECT r_regionkey, SERVERPROPERTY('ProductMajorVersion') AS v, SESSIONPROPERTY('ANSI_NULLS') AS n, CONNECTIONPROPERTY('net_transport') AS c, COLLATIONPROPERTY('x', 'CodePage') AS p, FULLTEXTSERVICEPROPERTY('IsFullTextInstalled') AS f, ISNULL(CONVERT(VARCHAR(9), CONTEXT_INFO(), 2), 'none') AS i, SESSION_CONTEXT('lang') AS x, DB_NAME() AS d, DB_ID() AS k, ORIGINAL_DB_NAME() AS o, DATABASEPROPERTYEX('tidewater', 'Status') AS s FROM region",
        "SELECT r_regionkey, '16' AS v, 1 AS n, 'TCP' AS c, 1252 AS p, 0 AS f, 'none' AS i, 'xy' AS x, 'tidewater' AS d, 1 AS k, 'tidewater' AS o, 'ONLINE' AS s FROM region",
    ),
    Q(
        "system_variables",
        LANDS + "DELETE FROM t WHERE r = 2; DECLARE @n INT = @@ROWCOUNT; BEGIN TRAN; BEGIN TRAN; DECLARE @tran INT = @@TRANCOUNT, @x INT = XACT_STATE(); ROLLBACK; SELECT @n AS n, @tran AS tran_, @x AS x, @@TRANCOUNT AS none, XACT_STATE() AS x0, @@ERROR AS e, @@NESTLEVEL AS lvl, @@DATEFIRST AS df, @@MAX_PRECISION AS mp, @@MAX_CONNECTIONS AS mc, @@LANGUAGE AS lang, @@TEXTSIZE AS ts, @@PROCID AS pid, IIF(@@SPID > 50, 1, 0) AS spid, @@OPTIONS AS op, @@SERVERNAME AS sn, @@SERVICENAME AS sv, LEFT(@@VERSION, 9) AS ver, ISNULL(@@REMSERVER, '-') AS rs, @@MICROSOFTVERSION AS mv",
        "SELECT CAST(COUNT(*) AS INTEGER) AS n, 2 AS tran_, 1 AS x, 0 AS none, CAST(0 AS SMALLINT) AS x0, 0 AS e, 0 AS lvl, 7 AS df, 38 AS mp, 32767 AS mc, 'us_english' AS lang, 4096 AS ts, 0 AS pid, 1 AS spid, 5432 AS op, 'localhost' AS sn, 'TIDEWATER' AS sv, 'Tidewater' AS ver, '-' AS rs, 268435456 AS mv FROM nation WHERE n_regionkey = 2",
    ),
    Q(
        "error_functions",
        "CREATE TABLE e (n INT, sev INT, st INT, msg NVARCHAR(200)); BEGIN TRY RAISERROR('made %s %d', 11, 3, 'up', 7) END TRY BEGIN CATCH INSERT INTO e SELECT ERROR_NUMBER(), ERROR_SEVERITY(), ERROR_STATE(), ERROR_MESSAGE() END CATCH; BEGIN TRY THROW 51000, 'thrown', 5 END TRY BEGIN CATCH INSERT INTO e SELECT ERROR_NUMBER(), ERROR_SEVERITY(), ERROR_STATE(), ERROR_MESSAGE() END CATCH; BEGIN TRY EXEC('SELECT 1 UNION SELECT 1, 2') END TRY BEGIN CATCH INSERT INTO e SELECT ERROR_NUMBER(), ERROR_SEVERITY(), 1, 'arity' END CATCH; SELECT n, st, msg FROM e",
        "SELECT * FROM (VALUES (50000, 3, 'made up 7'), (51000, 5, 'thrown'), (205, 1, 'arity')) AS x(n, st, msg)",
    ),
    Q(
        "metadata_columns",
        "SELECT x.value AS nth, COL_NAME(OBJECT_ID('customer'), 1) AS c1, COL_NAME(OBJECT_ID('customer'), 2) AS c2, COL_LENGTH('nation', 'n_nationkey') AS len, COLUMNPROPERTY(OBJECT_ID('nation'), 'n_regionkey', 'ColumnId') AS id, OBJECT_NAME(OBJECT_ID('dbo.orders')) AS o, OBJECT_SCHEMA_NAME(OBJECT_ID('orders')) AS s, SCHEMA_NAME(SCHEMA_ID('dbo')) AS sc, OBJECTPROPERTY(OBJECT_ID('part'), 'IsUserTable') AS ut, OBJECTPROPERTYEX(OBJECT_ID('part'), 'IsView') AS iv, TYPE_NAME(TYPE_ID('bigint')) AS ty, TYPEPROPERTY('int', 'Precision') AS pr FROM GENERATE_SERIES(1, 2) x",
        "SELECT CAST(nth AS INTEGER) AS nth, (SELECT column_name FROM information_schema.columns WHERE table_name = 'customer' AND ordinal_position = 1) AS c1, (SELECT column_name FROM information_schema.columns WHERE table_name = 'customer' AND ordinal_position = 2) AS c2, 4 AS len, (SELECT CAST(ordinal_position AS INTEGER) FROM information_schema.columns WHERE table_name = 'nation' AND column_name = 'n_regionkey') AS id, 'orders' AS o, 'dbo' AS s, 'dbo' AS sc, 1 AS ut, 0 AS iv, 'bigint' AS ty, 10 AS pr FROM range(1, 3) AS r(nth)",
    ),
    Q(
        "metadata_indexes",
        "CREATE TABLE t (k INT NOT NULL, v INT, CONSTRAINT pk_t PRIMARY KEY (k))\nGO\nCREATE UNIQUE INDEX ix ON t (v, k)\nGO\nCREATE VIEW w AS SELECT k FROM t\nGO\nSELECT i.name, i.is_unique, i.is_primary_key, COUNT(c.column_id) AS n, INDEXPROPERTY(OBJECT_ID('t'), 'ix', 'IsUnique') AS u, INDEX_COL('t', 2, 1) AS first_, INDEXKEY_PROPERTY(OBJECT_ID('t'), 2, 2, 'ColumnId') AS second_, OBJECTPROPERTY(OBJECT_ID('t'), 'TableHasPrimaryKey') AS pk, CHARINDEX('SELECT', OBJECT_DEFINITION(OBJECT_ID('w'))) AS place FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id WHERE i.object_id = OBJECT_ID('t') GROUP BY i.name, i.is_unique, i.is_primary_key",
        "SELECT name, uniq AS is_unique, prim AS is_primary_key, n, 1 AS u, 'v' AS first_, 1 AS second_, 1 AS pk, CAST(instr('CREATE VIEW w AS SELECT k FROM t', 'SELECT') AS INTEGER) AS place FROM (VALUES ('pk_t', TRUE, TRUE, CAST(1 AS BIGINT)), ('ix', TRUE, FALSE, CAST(2 AS BIGINT))) AS x(name, uniq, prim, n)",
    ),
    Q(
        "info_schema_all_columns",
        "SELECT TABLE_NAME AS t, COLUMN_NAME AS c, ORDINAL_POSITION AS n FROM INFORMATION_SCHEMA.COLUMNS",
        "SELECT table_name AS t, column_name AS c, CAST(ordinal_position AS INTEGER) AS n FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')",
    ),
    Q("sys_objects_all", "SELECT o.name AS t, COUNT(*) AS n, MAX(c.column_id) AS last FROM sys.objects o JOIN sys.columns c ON c.object_id = o.object_id WHERE o.type = 'U' GROUP BY o.name", "SELECT table_name AS t, COUNT(*) AS n, CAST(MAX(ordinal_position) AS INTEGER) AS last FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations') GROUP BY table_name"),
    Q("sys_partitions_rows", "SELECT t.name, p.rows FROM sys.tables t JOIN sys.partitions p ON p.object_id = t.object_id WHERE t.name IN ('nation', 'orders', 'part')", "SELECT 'nation' AS name, COUNT(*) AS rows FROM nation UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'part', COUNT(*) FROM part"),
    Q("sp_columns_rows", "CREATE TABLE r (q NVARCHAR(99), o NVARCHAR(99), t NVARCHAR(99), c NVARCHAR(99), ty NVARCHAR(99), p INT, n INT, nth INT); INSERT INTO r EXEC sp_columns 'customer'; SELECT t, c, nth FROM r", "SELECT table_name AS t, column_name AS c, CAST(ordinal_position AS INTEGER) AS nth FROM information_schema.columns WHERE table_name = 'customer'"),
    Q("sp_tables_rows", "CREATE TABLE r (q NVARCHAR(99), o NVARCHAR(99), t NVARCHAR(99), ty NVARCHAR(99), m NVARCHAR(99)); INSERT INTO r EXEC sp_tables; SELECT t FROM r WHERE t <> 'r'", "SELECT DISTINCT table_name AS t FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')"),
    Q("insert_default_values", "CREATE TABLE t (id INT IDENTITY, v INT DEFAULT 7, s VARCHAR(9) DEFAULT 'x'); INSERT INTO t DEFAULT VALUES; INSERT INTO t DEFAULT VALUES; INSERT INTO t (v) SELECT n_regionkey FROM nation; SELECT v, s, COUNT(*) AS n FROM t GROUP BY v, s", "SELECT v, 'x' AS s, COUNT(*) AS n FROM (SELECT n_regionkey AS v FROM nation UNION ALL SELECT 7 UNION ALL SELECT 7) GROUP BY v"),
    Q("insert_exec", "CREATE PROCEDURE lands @r INT AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = @r\nGO\nCREATE TABLE t (k INT, name NVARCHAR(40)); INSERT INTO t EXEC lands 3; INSERT INTO t EXEC('SELECT r_regionkey, r_name FROM region'); SELECT k, name FROM t", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 3 UNION ALL SELECT r_regionkey, r_name FROM region"),
    Q("alter_table", LANDS + "ALTER TABLE t ADD twice INT NULL; UPDATE t SET twice = k * 2; ALTER TABLE t DROP COLUMN r; ALTER TABLE t ALTER COLUMN name VARCHAR(60); SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, n_nationkey * 2 AS twice FROM nation"),
    Q("create_schema_type", "CREATE SCHEMA store\nGO\nCREATE TYPE dbo.money_ FROM DECIMAL(12, 2)\nGO\nCREATE TABLE store.t (k INT, total dbo.money_); INSERT INTO store.t SELECT o_orderkey, o_totalprice FROM orders; SELECT k, CAST(total AS FLOAT) AS total FROM store.t", "SELECT CAST(o_orderkey AS INTEGER) AS k, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS total FROM orders"),
    Q("table_type_parameter", "CREATE TYPE dbo.ids AS TABLE (id INT)\nGO\nCREATE PROCEDURE dbo.pick @which dbo.ids READONLY AS SELECT n.n_name FROM nation n JOIN @which w ON w.id = n.n_nationkey\nGO\nDECLARE @some dbo.ids; INSERT INTO @some SELECT n_nationkey FROM nation WHERE n_regionkey = 4; EXEC dbo.pick @which = @some", "SELECT n_name FROM nation WHERE n_regionkey = 4"),
    Q(
        "foreign_key_set",
        KEYED + "CREATE TABLE a (k INT, r INT REFERENCES p (k) ON DELETE SET NULL); CREATE TABLE b (k INT, r INT DEFAULT 0 REFERENCES p (k) ON DELETE SET DEFAULT); INSERT INTO a SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO b SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE k IN (2, 3); SELECT a.k, a.r AS null_, b.r AS zero FROM a JOIN b ON b.k = a.k",
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey IN (2, 3) THEN NULL ELSE n_regionkey END AS null_, CASE WHEN n_regionkey IN (2, 3) THEN 0 ELSE n_regionkey END AS zero FROM nation",
    ),
    Q("string_lengths", "CREATE TABLE t (c CHAR(12), v VARCHAR(60)); INSERT INTO t SELECT n_name, n_name FROM nation; DECLARE @e INT = 0; BEGIN TRY INSERT INTO t (c) VALUES (REPLICATE('x', 13)) END TRY BEGIN CATCH SET @e = ERROR_NUMBER() END CATCH; SELECT v, DATALENGTH(c) AS n, @e AS e FROM t", "SELECT n_name AS v, 12 AS n, 2628 AS e FROM nation"),
    Q("trigger_instead", "CREATE TABLE t (k INT, v INT)\nGO\nCREATE TRIGGER tr ON t INSTEAD OF INSERT AS INSERT INTO t SELECT k, v * 100 FROM inserted WHERE v > 1\nGO\nINSERT INTO t SELECT n_nationkey, n_regionkey FROM nation; SELECT k, v FROM t", "SELECT n_nationkey AS k, n_regionkey * 100 AS v FROM nation WHERE n_regionkey > 1"),
    Q(
        "cursor_ways",
        "DECLARE k SCROLL CURSOR FOR SELECT n_nationkey FROM nation ORDER BY n_nationkey; DECLARE @v INT, @all VARCHAR(200) = ''; OPEN k; FETCH LAST FROM k INTO @v; SET @all += CAST(@v AS VARCHAR(9)) + ' '; FETCH PRIOR FROM k INTO @v; SET @all += CAST(@v AS VARCHAR(9)) + ' '; FETCH ABSOLUTE 4 FROM k INTO @v; SET @all += CAST(@v AS VARCHAR(9)) + ' '; FETCH RELATIVE 2 FROM k INTO @v; SET @all += CAST(@v AS VARCHAR(9)) + ' '; FETCH FIRST FROM k INTO @v; SET @all += CAST(@v AS VARCHAR(9)); FETCH PRIOR FROM k INTO @v; SELECT @all AS seen, @@FETCH_STATUS AS st",
        "SELECT (COUNT(*) - 1) || ' ' || (COUNT(*) - 2) || ' 3 5 0' AS seen, -1 AS st FROM nation",
    ),
    Q("cursor_many_pages", "DECLARE k SCROLL CURSOR FOR SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber; DECLARE @o BIGINT, @n INT, @a BIGINT, @b INT; OPEN k; FETCH ABSOLUTE 2500 FROM k INTO @o, @n; FETCH RELATIVE -1200 FROM k INTO @a, @b; SELECT @o AS o, @n AS n, @a AS a, @b AS b", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem) SELECT x.l_orderkey AS o, x.l_linenumber AS n, y.l_orderkey AS a, y.l_linenumber AS b FROM r x, r y WHERE x.nth = 2500 AND y.nth = 1300"),
    Q("set_options", "SET CONCAT_NULL_YIELDS_NULL OFF; SET ANSI_NULLS OFF; SET DATEFIRST 1; SELECT n_nationkey, n_name + NULL AS c, IIF(NULL = NULL, 1, 0) AS e, @@DATEFIRST AS d, SESSIONPROPERTY('ANSI_NULLS') AS p FROM nation", "SELECT n_nationkey, n_name AS c, 1 AS e, 1 AS d, 0 AS p FROM nation"),
    Q("query_governor", "SET QUERY_GOVERNOR_COST_LIMIT 5; DECLARE @e INT = 0; BEGIN TRY SELECT COUNT(*) AS n FROM nation a JOIN region b ON b.r_regionkey = a.n_regionkey END TRY BEGIN CATCH SET @e = ERROR_NUMBER() END CATCH; SELECT @e AS e, COUNT(*) AS n FROM nation", "SELECT 8649 AS e, COUNT(*) AS n FROM nation"),
    Q("udf_while", "CREATE FUNCTION dbo.steps(@n BIGINT) RETURNS INT AS BEGIN DECLARE @i INT = 0; WHILE @n > 1 BEGIN SET @i += 1; IF @n % 2 = 0 BEGIN SET @n = @n / 2; CONTINUE END; SET @n = 3 * @n + 1; IF @i > 500 BREAK END; RETURN @i END\nGO\nSELECT o_orderkey, dbo.steps(o_orderkey % 100) AS n FROM orders", "WITH RECURSIVE c(s, n, i) AS (SELECT s, s, 0 FROM range(0, 100) AS r(s) UNION ALL SELECT s, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, i + 1 FROM c WHERE n > 1) SELECT o_orderkey, CAST(MAX(i) AS INTEGER) AS n FROM orders JOIN c ON s = o_orderkey % 100 GROUP BY o_orderkey"),
    Q("udf_while_sum", "CREATE FUNCTION dbo.total(@n INT) RETURNS INT AS BEGIN DECLARE @sum INT = 0; DECLARE @i INT = 1; WHILE @i <= @n BEGIN SET @sum = @sum + @i; SET @i = @i + 1; END RETURN @sum; END\nGO\nSELECT p_partkey, dbo.total(p_size) AS n FROM part", "SELECT p_partkey, CAST(p_size * (p_size + 1) / 2 AS INTEGER) AS n FROM part"),
    Q("apply_then_join", "SELECT n.n_nationkey, s.value, s.ordinal, r.r_name FROM nation n OUTER APPLY STRING_SPLIT(n.n_name, '_', 1) s JOIN region r ON r.r_regionkey = n.n_regionkey WHERE s.ordinal = 2", "SELECT n_nationkey, split_part(n_name, '_', 2) AS value, CAST(2 AS BIGINT) AS ordinal, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    Q("proc_while_rows", "CREATE PROCEDURE count_lands @total INT OUTPUT AS BEGIN DECLARE @r INT = 0, @n INT; SET @total = 0; WHILE @r < 5 BEGIN SELECT @n = COUNT(*) FROM nation WHERE n_regionkey = @r; SET @total += @n * @r; SET @r += 1 END END\nGO\nDECLARE @t INT; EXEC count_lands @total = @t OUTPUT; SELECT @t AS total", "SELECT CAST(SUM(n_regionkey) AS INTEGER) AS total FROM nation"),
    Q("truncate_identity", "CREATE TABLE t (id INT IDENTITY, k INT); INSERT INTO t (k) SELECT n_nationkey FROM nation; TRUNCATE TABLE t; INSERT INTO t (k) SELECT r_regionkey FROM region; SELECT COUNT(*) AS n, MAX(id) AS last FROM t", "SELECT COUNT(*) AS n, CAST(COUNT(*) AS INTEGER) AS last FROM region"),
]


def bulk_insert_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as delimited text and read by BULK INSERT, and others through a client's bulk load."""
    path = f"{shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("sep", "|").csv(path)
    engine = open_folder(spark, sf_dir)
    engine.exec(f"CREATE TABLE t (k INT, name NVARCHAR(40), r INT); BULK INSERT t FROM '{path}' WITH (FIELDTERMINATOR = '|')")
    engine.exec("INSERT BULK t (k INT, name NVARCHAR(40), r INT)")
    engine.default.bulk_load("t", spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey + 100 as k", "r_name as name", "cast(null as int) as r"))
    return engine.query("SELECT k, name, r FROM t")


def checkpoint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database with tables, keys, defaults, a view and routines, exported and read back by another engine."""
    path = f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}"
    engine = open_folder(spark, sf_dir)
    engine.exec("CREATE TABLE t (id INT IDENTITY(5, 5) PRIMARY KEY, name NVARCHAR(40) DEFAULT 'none', r INT CHECK (r >= 0)); INSERT INTO t (name, r) SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
    engine.exec("CREATE VIEW w AS SELECT name, r FROM t WHERE r > 0\nGO\nCREATE FUNCTION dbo.twice(@x INT) RETURNS INT AS BEGIN RETURN @x * 2 END\nGO\nCREATE PROCEDURE more @r INT AS INSERT INTO t (r) VALUES (@r)")
    engine.export_checkpoint(path)
    other = open_folder(spark, sf_dir)
    other.import_checkpoint(path)
    return other.query("EXEC more 2; DECLARE @e INT = 0; BEGIN TRY EXEC more -1 END TRY BEGIN CATCH SET @e = ERROR_NUMBER() END CATCH; SELECT r, COUNT(*) AS n, SUM(IIF(name = 'none', 1, 0)) AS added, dbo.twice(r) AS two, @e AS e FROM w GROUP BY r")


def explain_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN and a trace say of a query."""
    engine = open_folder(spark, sf_dir)
    said = engine.explain("SELECT TOP 3 n_regionkey, COUNT(*) AS n FROM nation WHERE n_nationkey > 2 GROUP BY n_regionkey ORDER BY n DESC")
    traced = engine.trace("SELECT r_name FROM region; SELECT * FROM no_such_table")
    rows = [(said["kind"], len(said["columns"]), "GreaterThan(n_nationkey,2)" in said["plan"], traced[0]["rows"], traced[1]["error"][0])]
    return spark.createDataFrame(rows, "kind string, n_columns int, pushed boolean, traced_rows long, error int")


DIRECT = {f.__name__: f for f in (bulk_insert_file, checkpoint_round_trip, explain_operators)}
DIRECT_ORACLES = {
    "bulk_insert_file": "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region",
    "checkpoint_round_trip": "SELECT r, COUNT(*) AS n, CAST(SUM(added) AS BIGINT) AS added, r * 2 AS two, 547 AS e FROM (SELECT n_regionkey AS r, 0 AS added FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 2, 1) GROUP BY r",
    "explain_operators": "SELECT 'query' AS kind, 2 AS n_columns, TRUE AS pushed, COUNT(*) AS traced_rows, 208 AS error FROM region",
}
