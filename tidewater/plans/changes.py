"""Changes of data, routines, scripts and metadata: scripts that end in a SELECT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import relational as R
from tidewater.plans.runner import Query as Q

COPY = "SELECT c_custkey, c_name, c_nationkey, c_acctbal INTO t FROM customer; "
QUERIES = [
    Q(
        "update_from",
        COPY + "UPDATE t SET c_acctbal = t.c_acctbal + x.n, c_name = UPPER(t.c_name) FROM t JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) x ON x.o_custkey = t.c_custkey WHERE x.n > 5; SELECT c_custkey, c_name, ROUND(c_acctbal, 4) AS b FROM t",
        "SELECT c_custkey, CASE WHEN x.n > 5 THEN upper(c_name) ELSE c_name END AS c_name, ROUND(CASE WHEN x.n > 5 THEN c_acctbal + x.n ELSE c_acctbal END, 4) AS b FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) x ON x.o_custkey = c_custkey",
    ),
    Q("update_where", COPY + "UPDATE t SET c_acctbal = 0 WHERE c_acctbal < 0; SELECT c_custkey, c_acctbal FROM t", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    Q("delete_from", COPY + "DELETE t FROM t JOIN nation n ON n.n_nationkey = t.c_nationkey WHERE n.n_regionkey = 2; SELECT c_custkey FROM t", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    Q("delete_where", COPY + "DELETE FROM t WHERE c_custkey % 3 = 0; SELECT c_custkey FROM t", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0"),
    Q(
        "insert_select",
        "CREATE TABLE t (id INT IDENTITY(10, 5) PRIMARY KEY, name NVARCHAR(40) NOT NULL, tag VARCHAR(5) DEFAULT 'new', twice AS (id * 2)); INSERT INTO t (name) SELECT n_name FROM nation WHERE n_regionkey = 1; INSERT INTO t (name, tag) VALUES ('x', 'a'), ('y', DEFAULT); SELECT COUNT(*) AS n, SUM(id) AS ids, MIN(tag) AS low, MAX(tag) AS high, SUM(twice) AS twice FROM t",
        "SELECT n, CAST(10 * n + 5 * n * (n - 1) / 2 AS BIGINT) AS ids, 'a' AS low, 'new' AS high, CAST(2 * (10 * n + 5 * n * (n - 1) / 2) AS BIGINT) AS twice FROM (SELECT COUNT(*) + 2 AS n FROM nation WHERE n_regionkey = 1)",
    ),
    Q(
        "merge_all_clauses",
        COPY + "MERGE INTO t USING (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey UNION ALL SELECT -1, 7) s ON t.c_custkey = s.k WHEN MATCHED AND s.n > 10 THEN DELETE WHEN MATCHED THEN UPDATE SET c_acctbal = s.n WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (s.k, 'new', s.n) WHEN NOT MATCHED BY SOURCE AND t.c_custkey % 2 = 1 THEN UPDATE SET c_name = 'odd'; SELECT c_custkey, c_name, c_acctbal FROM t",
        "WITH s AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey UNION ALL SELECT -1, 7) SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'new' WHEN k IS NULL AND c_custkey % 2 = 1 THEN 'odd' ELSE c_name END AS c_name, CASE WHEN k IS NOT NULL THEN n ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN s ON k = c_custkey WHERE NOT (c_custkey IS NOT NULL AND k IS NOT NULL AND n > 10)",
    ),
    Q(
        "output_clause",
        COPY + "CREATE TABLE log_ (id BIGINT, old FLOAT, new FLOAT); UPDATE t SET c_acctbal = c_acctbal * 2 OUTPUT inserted.c_custkey, deleted.c_acctbal, inserted.c_acctbal INTO log_ WHERE c_custkey < 20; SELECT id, old, new FROM log_",
        "SELECT c_custkey AS id, c_acctbal AS old, c_acctbal * 2 AS new FROM customer WHERE c_custkey < 20",
    ),
    Q(
        "merge_output",
        "CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30); MERGE t USING (VALUES (2, 5), (4, 40)) s(id, v) ON s.id = t.id WHEN MATCHED THEN UPDATE SET v += s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v) WHEN NOT MATCHED BY SOURCE AND t.id = 3 THEN DELETE OUTPUT $action AS what, inserted.v AS new, deleted.v AS old;",
        "SELECT * FROM (VALUES ('UPDATE', 25, 20), ('INSERT', 40, NULL), ('DELETE', NULL, 30)) AS x(what, new, old)",
    ),
    Q("select_into", "SELECT o_orderstatus, COUNT(*) AS n INTO #s FROM orders GROUP BY o_orderstatus; SELECT o_orderstatus, n FROM #s WHERE n > 0", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    Q("truncate_table", COPY + "TRUNCATE TABLE t; SELECT COUNT(*) AS n FROM t", "SELECT CAST(0 AS BIGINT) AS n"),
    Q(
        "constraints",
        "CREATE TABLE t (id INT PRIMARY KEY, v INT CHECK (v > 0)); INSERT INTO t VALUES (1, 1); DECLARE @a INT, @b INT, @c INT; BEGIN TRY INSERT INTO t VALUES (1, 2) END TRY BEGIN CATCH SET @a = ERROR_NUMBER() END CATCH; BEGIN TRY INSERT INTO t VALUES (2, -1) END TRY BEGIN CATCH SET @b = ERROR_NUMBER() END CATCH; BEGIN TRY INSERT INTO t (v) VALUES (3) END TRY BEGIN CATCH SET @c = ERROR_NUMBER() END CATCH; SELECT @a AS a, @b AS b, @c AS c, COUNT(*) AS n FROM t",
        "SELECT 2627 AS a, 547 AS b, 515 AS c, CAST(1 AS BIGINT) AS n",
    ),
    Q(
        "foreign_key_cascade",
        "SELECT r_regionkey, r_name INTO p FROM region; ALTER TABLE p ADD CONSTRAINT pk PRIMARY KEY (r_regionkey); CREATE TABLE c (k INT PRIMARY KEY, r INT, CONSTRAINT fk FOREIGN KEY (r) REFERENCES p (r_regionkey) ON DELETE CASCADE); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE r_regionkey IN (1, 3); SELECT k, r FROM c",
        "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey NOT IN (1, 3)",
    ),
    Q("trigger_after", "CREATE TABLE t (id INT, v INT); CREATE TABLE a (id INT, old INT, new INT)\nGO\nCREATE TRIGGER tr ON t AFTER UPDATE AS INSERT INTO a SELECT i.id, d.v, i.v FROM inserted i JOIN deleted d ON d.id = i.id\nGO\nINSERT INTO t SELECT n_nationkey, n_regionkey FROM nation; UPDATE t SET v = v + 10 WHERE id < 6; SELECT id, old, new FROM a", "SELECT n_nationkey AS id, n_regionkey AS old, n_regionkey + 10 AS new FROM nation WHERE n_nationkey < 6"),
    Q("view_expand", "CREATE VIEW rich AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier\nGO\nSELECT n.n_name, COUNT(*) AS n FROM rich r JOIN nation n ON n.n_nationkey = r.c_nationkey GROUP BY n.n_name", "SELECT n.n_name, COUNT(*) AS n FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) r JOIN nation n ON n.n_nationkey = r.c_nationkey GROUP BY n.n_name"),
    Q("inline_tvf", "CREATE FUNCTION dbo.orders_of(@c BIGINT, @least FLOAT = 0) RETURNS TABLE AS RETURN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = @c AND o_totalprice > @least)\nGO\nSELECT c.c_custkey, f.o_orderkey FROM customer c CROSS APPLY dbo.orders_of(c.c_custkey, 300000) f", "SELECT o_custkey AS c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    Q("scalar_udf", "CREATE FUNCTION dbo.band(@x FLOAT) RETURNS VARCHAR(10) AS BEGIN DECLARE @r VARCHAR(10) = 'low'; IF @x > 300000 RETURN 'top'; IF @x > 100000 SET @r = 'mid'; RETURN @r END\nGO\nSELECT o_orderkey, dbo.band(o_totalprice) AS band FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'top' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders"),
    Q("synonym_sequence", "CREATE SYNONYM lands FOR nation; CREATE SEQUENCE s START WITH 100 INCREMENT BY 10; DECLARE @a BIGINT = NEXT VALUE FOR s, @b BIGINT = NEXT VALUE FOR s; SELECT @a AS a, @b AS b, COUNT(*) AS n FROM lands", "SELECT CAST(100 AS BIGINT) AS a, CAST(110 AS BIGINT) AS b, COUNT(*) AS n FROM nation"),
    Q("proc_while_loop", "CREATE PROCEDURE sums @n INT, @total INT OUTPUT AS BEGIN DECLARE @i INT = 0; SET @total = 0; WHILE 1 = 1 BEGIN SET @i += 1; IF @i > @n BREAK; IF @i % 2 = 0 CONTINUE; SET @total += @i END; RETURN @i END\nGO\nDECLARE @t INT, @r INT; EXEC @r = sums @n = 9, @total = @t OUTPUT; SELECT @t AS total, @r AS status", "SELECT 25 AS total, 10 AS status"),
    Q("cursor_fetch", "DECLARE k CURSOR FOR SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey; DECLARE @k INT, @n NVARCHAR(50), @all NVARCHAR(500) = ''; OPEN k; FETCH NEXT FROM k INTO @k, @n; WHILE @@FETCH_STATUS = 0 BEGIN SET @all = @all + @n + ';'; FETCH NEXT FROM k INTO @k, @n END; CLOSE k; DEALLOCATE k; SELECT @all AS names", "SELECT string_agg(r_name || ';', '' ORDER BY r_regionkey) AS names FROM region"),
    Q("dynamic_sql", "DECLARE @n INT; EXEC sp_executesql N'SELECT @out = COUNT(*) FROM nation WHERE n_regionkey = @r', N'@r INT, @out INT OUTPUT', @r = 2, @out = @n OUTPUT; SELECT @n AS n", "SELECT CAST(COUNT(*) AS INTEGER) AS n FROM nation WHERE n_regionkey = 2"),
    Q("try_catch", "BEGIN TRY SELECT 1 / 0 AS x END TRY BEGIN CATCH SELECT ERROR_NUMBER() AS n, ERROR_SEVERITY() AS s END CATCH", "SELECT 8134 AS n, 16 AS s"),
    Q("transactions", COPY + "BEGIN TRAN; DELETE FROM t WHERE c_custkey < 10; SAVE TRAN p; DELETE FROM t; ROLLBACK TRAN p; COMMIT; BEGIN TRAN; DELETE FROM t; ROLLBACK; SELECT COUNT(*) AS n FROM t", "SELECT COUNT(*) AS n FROM customer WHERE c_custkey >= 10"),
    Q("table_variable", "DECLARE @t TABLE (k INT, n INT); INSERT INTO @t SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey; SELECT r.r_name, v.n FROM @t v JOIN region r ON r.r_regionkey = v.k", "SELECT r_name, CAST(COUNT(*) AS INTEGER) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"),
    Q("info_schema_columns", "SELECT TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME IN ('region', 'nation')", "SELECT * FROM (VALUES ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'nvarchar'), ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'nvarchar'), ('nation', 'n_regionkey', 3, 'int')) AS x(TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE)"),
    Q("sys_objects", "SELECT t.name, COUNT(*) AS n FROM sys.tables t JOIN sys.columns c ON c.object_id = t.object_id WHERE t.name IN ('part', 'orders') GROUP BY t.name", "SELECT * FROM (VALUES ('part', CAST(6 AS BIGINT)), ('orders', CAST(6 AS BIGINT))) AS x(name, n)"),
]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def api_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(_orders(spark, sf_dir), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def api_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivot(_orders(spark, sf_dir), ["o_orderpriority"], "o_orderstatus", ["F", "O"], F.max, "o_totalprice")


def api_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.groups_frame(_orders(spark, sf_dir), ["o_custkey"], F.col("o_orderstatus"), -1, 0, F.count("*"), "n").select("o_orderkey", "n")


def api_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.salted_join(_orders(spark, sf_dir), customer, ["o_custkey"], 4).select("o_orderkey", "c_name")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.streaming import drained, windowed

    return drained(spark, f"{sf_dir}/events.parquet", lambda events: windowed(events, "ts", "1 day", "30 days", "event_type", "value"))


DIRECT = {f.__name__: f for f in (api_top_per_group, api_pivot, api_groups_frame, api_salted_join, stream_windows)}
DIRECT_ORACLES = {
    "api_top_per_group": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "api_pivot": "SELECT o_orderpriority, MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS F, MAX(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority",
    "api_groups_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "api_salted_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey",
    "stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL",
}
