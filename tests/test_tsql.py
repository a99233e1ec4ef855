"""Statements with results that are known beforehand."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.errors import SqlError
from tidewater.session import Engine
from tidewater.tsql.emit import float_sum
from tidewater.tsql.lexer import batches, tokens
from tidewater.tsql.statements import parse


@pytest.fixture
def engine(spark):
    return Engine(spark, seed=3)


def one(engine, sql):
    return [tuple(r) for r in engine.query(sql).collect()]


def error(engine, sql):
    with pytest.raises(SqlError) as raised:
        for result in engine.exec(sql):
            result.rows()
    return raised.value.number


def test_lexer_and_parser():
    assert [t.text for t in tokens("SELECT [a]]b], 'it''s' /* x /* y */ */ -- z\n, 0x1F, @v")][1:-1] == ["a]b", ",", "it's", ",", "0x1F", ",", "@v"]
    assert batches("a\nGO\nb") == ["a\n", "\nb"]
    assert parse("SELECT a FROM t WHERE x = 1 AND NOT y LIKE 'z%'") == parse("select a from t where x=1 and not y like 'z%'")
    for broken in ("SELECT", "SELECT FROM", "SELECT 1 +", "INSERT INTO", "CREATE TABLE t (", "SELECT * FROM t WHERE", "'open", "SELECT (1", "/* x"):
        with pytest.raises(SqlError):
            parse(broken)


def test_expressions(engine):
    assert one(engine, "SELECT 7 / 2 AS a, -7 / 2 AS b, 7 % 3 AS c, 'a' + 'b' AS d, 1 + NULL AS e") == [(3, -3, 1, "ab", None)]
    assert one(engine, "SELECT LEN('ab  ') a, DATALENGTH(N'ab') b, SUBSTRING('abc', 0, 2) c, CONCAT('a', NULL, 1) d") == [(2, 4, "ab", "a1")]
    assert one(engine, "SELECT CASE WHEN 1 IN (2, NULL) THEN 'y' ELSE 'n' END a, CASE WHEN 2 IN (NULL, 2) THEN 'y' ELSE 'n' END b") == [("n", "y")]
    assert one(engine, "SELECT GREATEST(1, NULL) a, LEAST(3, 2) b, CHOOSE(3, 'a', 'b') c, IIF(1 > 2, 1, 0) d") == [(None, 2, None, 0)]
    assert one(engine, "SELECT TRY_CAST('x' AS INT) a, TRY_CONVERT(DATE, '2024-02-30') b, CAST('2024-02-29' AS DATE) c") == [(None, None, dt.date(2024, 2, 29))]
    assert one(engine, "SELECT DATEDIFF(month, '2020-01-31', '2020-02-01') a, DATEADD(month, 1, CAST('2020-01-31' AS DATE)) b") == [(1, dt.date(2020, 2, 29))]
    assert one(engine, "SELECT CAST(200 AS TINYINT) a, CAST(3.999 AS MONEY) b, CAST('ab' AS CHAR(4)) c") [0][2] == "ab  "
    assert one(engine, "SELECT JSON_VALUE('{\"a\":[1,{\"b\":\"x\"}]}', '$.a[1].b') v, ISJSON('[') i") == [("x", False)]
    assert float(one(engine, "SELECT JARO_WINKLER_SIMILARITY('MARTHA', 'MARHTA') j")[0][0]) == pytest.approx(0.961111111)
    assert one(engine, "SELECT VECTOR_DISTANCE('euclidean', CAST('[0,3]' AS VECTOR(2)), CAST('[4,0]' AS VECTOR(2))) d") == [(5.0,)]


def test_errors(engine):
    assert error(engine, "SELECT 1 / 0 AS x") == 8134
    assert error(engine, "SELECT nope FROM (SELECT 1 a) d") == 207
    assert error(engine, "SELECT * FROM missing") == 208
    assert error(engine, "SELECT CAST('x' AS INT) AS x") == 245
    assert error(engine, "SELECT nope(1)") == 195
    assert error(engine, "USE elsewhere") == 911
    engine.exec("CREATE TABLE t (a INT)")
    assert error(engine, "CREATE TABLE t (a INT)") == 2714
    assert error(engine, "CREATE TABLE u (a INT, A INT)") == 2705
    assert error(engine, "SET ARITHABORT OFF; THROW 50001, 'mine', 1") == 50001


def test_arithabort_off_gives_null(engine):
    engine.exec("SET ARITHABORT OFF; SET ANSI_WARNINGS OFF")
    assert one(engine, "SELECT 1 / 0 AS a, 1.0 / 0 AS b") == [(None, None)]


def test_ansi_nulls_and_concat(engine):
    engine.exec("SET ANSI_NULLS OFF; SET CONCAT_NULL_YIELDS_NULL OFF")
    assert one(engine, "SELECT IIF(NULL = NULL, 1, 0) a, 'x' + NULL b") == [(1, "x")]


def test_outer_joins_and_missing_keys(engine):
    engine.exec(
        "CREATE TABLE boats (no INT, hull VARCHAR(9), berth INT); INSERT INTO boats VALUES (7, 'oak', 3), (8, 'steel', 5), (9, 'ash', 6), (11, 'reed', NULL);"
        "CREATE TABLE berths (no INT, pier CHAR(1)); INSERT INTO berths VALUES (3, 'N'), (5, 'S'), (8, 'W')"
    )
    assert sorted(one(engine, "SELECT b.no, p.pier FROM berths p RIGHT JOIN boats b ON p.no = b.berth")) == [(7, "N"), (8, "S"), (9, None), (11, None)]
    assert sorted(one(engine, "SELECT p.pier, COUNT(b.no) AS n FROM boats b RIGHT JOIN berths p ON p.no = b.berth GROUP BY p.pier")) == [("N", 1), ("S", 1), ("W", 0)]
    assert one(engine, "SELECT COUNT(*) AS n, COUNT(b.no) AS b, COUNT(p.no) AS p FROM boats b FULL JOIN berths p ON p.no = b.berth") == [(5, 4, 3)]
    assert one(engine, "SELECT hull FROM boats WHERE berth NOT IN (SELECT no FROM berths)") == [("ash",)]
    assert one(engine, "SELECT hull FROM boats WHERE no NOT IN (SELECT berth FROM boats)") == []
    assert sorted(one(engine, "SELECT hull FROM boats WHERE berth NOT IN (SELECT no FROM berths WHERE pier = 'Q')")) == [("ash",), ("oak",), ("reed",), ("steel",)]
    assert one(engine, "SELECT COUNT(*) AS n FROM boats WHERE NOT (berth NOT IN (SELECT no FROM berths)) AND no < 100") == [(2,)]


def test_running_and_sliding_windows(engine):
    engine.exec("CREATE TABLE tide (hour INT, pier CHAR(1), cm INT); INSERT INTO tide VALUES (1, 'N', 3), (2, 'N', 8), (3, 'S', 4), (4, 'S', 9), (5, 'S', 12)")
    assert one(engine, "SELECT SUM(cm) OVER (ORDER BY hour), AVG(cm) OVER (PARTITION BY pier) FROM tide ORDER BY hour") == [(3, 5), (11, 5), (15, 8), (24, 8), (36, 8)]
    assert one(engine, "SELECT MAX(cm) OVER (ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM tide ORDER BY hour") == [(8,), (8,), (9,), (12,), (12,)]
    engine.exec("CREATE TABLE g (v INT); INSERT INTO g VALUES (2), (2), (9), (20)")
    assert one(engine, "SELECT SUM(v) OVER (ORDER BY v GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM g ORDER BY s") == [(4,), (4,), (13,), (29,)]


def test_cross_tables(engine):
    engine.exec("CREATE TABLE catch (boat VARCHAR(9), fish VARCHAR(9), kg INT); INSERT INTO catch VALUES ('oak', 'cod', 12), ('oak', 'cod', 5), ('oak', 'ling', 7), ('ash', 'COD', 4)")
    assert one(engine, "SELECT * FROM catch PIVOT (SUM(kg) FOR fish IN ([cod], [ling])) p ORDER BY boat") == [("ash", 4, None), ("oak", 17, 7)]
    engine.exec("CREATE TABLE w (boat VARCHAR(9), cod INT, ling INT); INSERT INTO w VALUES ('oak', 17, 7), ('ash', 4, NULL)")
    assert one(engine, "SELECT boat, f, kg FROM w UNPIVOT (kg FOR f IN (cod, ling)) u ORDER BY boat, f") == [("ash", "cod", 4), ("oak", "cod", 17), ("oak", "ling", 7)]


def test_generators_are_applied_in_one_pass(engine, spark):
    spark.createDataFrame([(1, "a,b", '{"x":1}'), (2, None, "[3]"), (3, "", "no json")], "id int, t string, j string").createOrReplaceTempView("applied")
    engine.register("d", spark.table("applied"))
    for sql in ("SELECT d.id, s.value FROM d CROSS APPLY STRING_SPLIT(d.t, ',') s", "SELECT d.id, s.[key], s.value FROM d OUTER APPLY OPENJSON(d.j) s", "SELECT d.id, s.x FROM d CROSS APPLY OPENJSON(d.j) WITH (x INT) s JOIN d e ON e.id = d.id"):
        plan = engine.explain(sql)["plan"]
        assert "Generate" in plan and ("Join" in plan) == (" JOIN " in sql)
    assert one(engine, "SELECT d.id, s.value FROM d OUTER APPLY STRING_SPLIT(d.t, ',') s ORDER BY 1, 2") == [(1, "a"), (1, "b"), (2, None), (3, "")]
    assert one(engine, "SELECT a.id, s.value, u.value AS v FROM d a CROSS APPLY STRING_SPLIT(a.t, ',') s CROSS APPLY STRING_SPLIT(s.value + '|z', '|') u WHERE u.value <> 'z' AND a.id = 1 ORDER BY 2") == [(1, "a", "a"), (1, "b", "b")]
    plan = engine.explain("SELECT id FROM d WHERE id NOT IN (SELECT id + 1 FROM d)")["plan"]
    assert "NullAware" not in plan and "isNullAware" not in plan


def test_quantified_comparisons(engine):
    engine.exec("CREATE TABLE v (x INT); INSERT INTO v VALUES (1), (5), (NULL); CREATE TABLE w (x INT); INSERT INTO w VALUES (2), (4)")
    assert one(engine, "SELECT x FROM w WHERE x > ANY (SELECT x FROM v) ORDER BY x") == [(2,), (4,)]
    assert one(engine, "SELECT x FROM w WHERE x < ALL (SELECT x FROM v)") == []
    assert one(engine, "SELECT x FROM v WHERE x > ALL (SELECT x FROM w)") == [(5,)]
    assert one(engine, "SELECT COUNT(*) AS n FROM w WHERE x >= ALL (SELECT x FROM w WHERE x > 9)") == [(2,)]


def test_loops_in_functions(engine):
    engine.exec("CREATE FUNCTION dbo.root(@n INT) RETURNS INT AS BEGIN DECLARE @i INT = 0; WHILE 1 = 1 BEGIN IF @i * @i > @n RETURN @i - 1; SET @i += 1 END; RETURN -1 END")
    assert one(engine, "SELECT dbo.root(0) AS a, dbo.root(99) AS b, dbo.root(100) AS c") == [(0, 9, 10)]
    engine.exec("CREATE FUNCTION dbo.pairs(@n INT) RETURNS INT AS BEGIN DECLARE @i INT = 0, @j INT, @all INT = 0; WHILE @i < @n BEGIN SET @i += 1; SET @j = 0; WHILE @j < @i BEGIN SET @j += 1; IF @j = @i CONTINUE; SET @all += 1 END END; RETURN @all END")
    assert one(engine, "SELECT dbo.pairs(1) AS a, dbo.pairs(5) AS b") == [(0, 10)]
    engine.exec("CREATE FUNCTION dbo.forever(@n INT) RETURNS INT AS BEGIN WHILE 1 = 1 SET @n = @n; RETURN @n END")
    with pytest.raises(Exception, match="too many rounds"):
        engine.query("SELECT dbo.forever(1) AS a").collect()


def test_old_versions_are_deleted(engine):
    engine.exec("CREATE TABLE t (x INT); INSERT INTO t VALUES (1), (2); UPDATE t SET x = x + 1; DELETE FROM t WHERE x = 2; INSERT INTO t VALUES (9)")
    assert engine.vacuum() > 0
    assert sorted(one(engine, "SELECT x FROM t")) == [(3,), (9,)]
    assert engine.vacuum() == 0


def test_views_without_rows_have_their_columns(engine):
    assert one(engine, "SELECT s.stats_id, c.column_id FROM sys.stats s JOIN sys.stats_columns c ON c.object_id = s.object_id") == []
    assert one(engine, "SELECT COUNT(*) AS n FROM sys.database_files WHERE type_desc = 'ROWS'") == [(0,)]


def test_recursion_is_capped(engine):
    assert one(engine, "WITH r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT MAX(n) AS m FROM r") == [(50,)]
    with pytest.raises(Exception):
        engine.query("WITH r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 500) SELECT MAX(n) AS m FROM r").collect()


def test_identity_defaults_and_output(engine):
    engine.exec("CREATE TABLE t (id INT IDENTITY(5, 10), a INT DEFAULT 7, b AS (a + 1))")
    out = engine.exec("INSERT INTO t (a) OUTPUT inserted.id, inserted.b VALUES (1), (DEFAULT), (NULL)")
    assert out[0].rows() == [(5, 2), (15, 8), (25, None)]
    assert one(engine, "SELECT SCOPE_IDENTITY() AS i, IDENT_CURRENT('t') AS c") == [(25, 25)]
    engine.exec("SET IDENTITY_INSERT t ON; INSERT INTO t (id, a) VALUES (100, 1); SET IDENTITY_INSERT t OFF; INSERT INTO t DEFAULT VALUES")
    assert one(engine, "SELECT MAX(id) AS m FROM t") == [(110,)]
    out = engine.exec("DELETE TOP (1) FROM t OUTPUT deleted.* WHERE a = 1")
    assert len(out[0].rows()) == 1


def test_truncation_nulls_keys_and_checks(engine):
    engine.exec("CREATE TABLE t (k INT PRIMARY KEY, s VARCHAR(3), c CHAR(3), CHECK (k < 10))")
    assert error(engine, "INSERT INTO t VALUES (1, 'long', 'a')") == 2628
    assert error(engine, "INSERT INTO t VALUES (NULL, 'a', 'a')") == 515
    assert error(engine, "INSERT INTO t VALUES (11, 'a', 'a')") == 547
    engine.exec("INSERT INTO t VALUES (1, 'a', 'a')")
    assert error(engine, "INSERT INTO t VALUES (1, 'b', 'b')") == 2627
    assert one(engine, "SELECT c + '|' AS c FROM t") == [("a  |",)]
    assert error(engine, "INSERT INTO t (k) VALUES (1, 2)") == 213


def test_foreign_keys(engine):
    engine.exec("CREATE TABLE p (id INT PRIMARY KEY); INSERT INTO p VALUES (1), (2); CREATE TABLE c (id INT, p INT REFERENCES p(id) ON DELETE SET NULL); CREATE TABLE d (p INT REFERENCES p(id))")
    assert error(engine, "INSERT INTO c VALUES (1, 9)") == 547
    engine.exec("INSERT INTO c VALUES (1, 1), (2, NULL); DELETE FROM p WHERE id = 1; INSERT INTO d VALUES (2)")
    assert one(engine, "SELECT id, p FROM c ORDER BY id") == [(1, None), (2, None)]
    assert error(engine, "DELETE FROM p") == 547


def test_merge_refuses_two_matches(engine):
    engine.exec("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1); CREATE TABLE s (id INT, v INT); INSERT INTO s VALUES (1, 2), (1, 3)")
    assert error(engine, "MERGE t USING s ON s.id = t.id WHEN MATCHED THEN UPDATE SET v = s.v;") == 8672


def test_transactions(engine):
    engine.exec("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    other = engine.create_session()
    engine.exec("BEGIN TRAN; UPDATE t SET a = 2")
    assert [tuple(r) for r in other.query("SELECT a FROM t").collect()] == [(1,)]
    other.exec("UPDATE t SET a = 3")
    with pytest.raises(SqlError) as raised:
        engine.exec("COMMIT")
    assert raised.value.number == 3960
    engine.exec("IF @@TRANCOUNT > 0 ROLLBACK")
    assert one(engine, "SELECT a FROM t") == [(3,)]


def test_triggers_and_instead_of(engine):
    engine.exec("CREATE TABLE t (a INT); CREATE TABLE log_ (m INT)\nGO\nCREATE TRIGGER tr ON t INSTEAD OF INSERT AS INSERT INTO log_ SELECT a * 10 FROM inserted\nGO\nINSERT INTO t VALUES (1), (2)")
    assert one(engine, "SELECT COUNT(*) n FROM t") == [(0,)]
    assert one(engine, "SELECT m FROM log_ ORDER BY m") == [(10,), (20,)]


def test_procedures(engine):
    engine.exec("CREATE TYPE ids AS TABLE (id INT)\nGO\nCREATE PROCEDURE total @t ids READONLY, @more INT = 5 AS SELECT SUM(id) + @more AS s FROM @t\nGO\nCREATE PROCEDURE fails AS BEGIN SELECT 1 AS x; RETURN 3 END")
    out = engine.exec("DECLARE @x ids; INSERT INTO @x VALUES (1), (2); EXEC total @t = @x; DECLARE @r INT; EXEC @r = fails; SELECT @r AS r")
    assert [r.rows() for r in out if r.df is not None] == [[(8,)], [(1,)], [(3,)]]
    assert error(engine, "EXEC nowhere") == 2812


def test_cursor_moves(engine):
    engine.exec("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2), (3)")
    out = engine.exec("DECLARE c SCROLL CURSOR FOR SELECT a FROM t ORDER BY a; OPEN c; FETCH LAST FROM c; FETCH PRIOR FROM c; FETCH ABSOLUTE 1 FROM c; FETCH RELATIVE 2 FROM c; CLOSE c; DEALLOCATE c")
    assert [r.rows() for r in out] == [[(3,)], [(2,)], [(1,)], [(3,)]]
    assert error(engine, "FETCH NEXT FROM c") == 16916


def test_alter_and_metadata(engine):
    engine.exec("CREATE SCHEMA x\nGO\nCREATE TABLE x.t (a INT NOT NULL CONSTRAINT pk PRIMARY KEY); INSERT INTO x.t VALUES (1); ALTER TABLE x.t ADD b VARCHAR(5) NULL, c INT NOT NULL DEFAULT 4; CREATE UNIQUE INDEX i ON x.t (c); ALTER TABLE x.t DROP COLUMN b")
    assert one(engine, "SELECT a, c FROM x.t") == [(1, 4)]
    assert one(engine, "SELECT COLUMN_NAME, IS_NULLABLE FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 't' ORDER BY ORDINAL_POSITION") == [("a", "NO"), ("c", "NO")]
    assert one(engine, "SELECT CONSTRAINT_NAME, CONSTRAINT_TYPE FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS") == [("pk", "PRIMARY KEY")]
    assert one(engine, "SELECT OBJECT_NAME(OBJECT_ID('x.t')) n, COL_LENGTH('x.t', 'a') l, SCHEMA_ID('x') s, DB_NAME() d")[0][:2] == ("t", 4)
    assert error(engine, "INSERT INTO x.t VALUES (2, 4)") == 2627
    from tidewater.metadata.views import VIEWS

    for schema, name in VIEWS:
        engine.query(f"SELECT * FROM {schema}.{name}").collect()
    for proc in ("sp_help", "sp_tables", "sp_who", "sp_databases", "sp_helpdb", "sp_server_info", "sp_columns 'x.t'", "sp_helpindex 'x.t'", "sp_helpconstraint 'x.t'"):
        assert engine.exec(f"EXEC {proc}")[0].df is not None


def test_checkpoint_round_trip(engine, spark, tmp_path):
    engine.exec("CREATE TABLE t (id INT IDENTITY, s VARCHAR(9)); INSERT INTO t VALUES ('a'), ('b'); CREATE VIEW v AS SELECT s FROM t WHERE id = 2")
    engine.export_checkpoint(f"file://{tmp_path}/out")
    again = Engine(spark)
    again.import_checkpoint(f"file://{tmp_path}/out")
    again.exec("INSERT INTO t VALUES ('c')")
    assert one(again, "SELECT id, s FROM t ORDER BY id") == [(1, "a"), (2, "b"), (3, "c")]
    assert one(again, "SELECT s FROM v") == [("b",)]


def test_bulk_insert(engine, tmp_path):
    (tmp_path / "rows.csv").write_text("1,a\n2,b\n")
    engine.exec(f"CREATE TABLE t (a INT, b VARCHAR(5)); BULK INSERT t FROM '{tmp_path}/rows.csv' WITH (FIELDTERMINATOR = ',')")
    assert one(engine, "SELECT * FROM t ORDER BY a") == [(1, "a"), (2, "b")]


def test_governor_explain_and_trace(engine):
    engine.exec("CREATE TABLE t (a INT)")
    plan = engine.explain("SELECT TOP 1 a, COUNT(*) n FROM t WHERE a > 1 GROUP BY a ORDER BY a")
    assert [o for o, _ in plan["operators"]] == ["Scan", "Filter", "Aggregate", "Project", "Sort", "Limit"]
    assert [e["statement"] for e in engine.trace("INSERT INTO t VALUES (1); SELECT a FROM t")] == ["insert", "query"]
    engine.exec("SET QUERY_GOVERNOR_COST_LIMIT 5")
    assert error(engine, "SELECT x.a FROM t x CROSS JOIN t y") == 8649


def test_statement_clock_and_seed(engine, spark):
    assert one(engine, "SELECT CASE WHEN GETDATE() = SYSDATETIME() THEN 1 END AS same") == [(1,)]
    a, b = Engine(spark, seed=9), Engine(spark, seed=9)
    assert one(a, "SELECT NEWID() i, RAND() r") == one(b, "SELECT NEWID() i, RAND() r")


def test_dataframes_as_arguments(engine, spark):
    engine.exec("CREATE TABLE t (a INT, b VARCHAR(5))")
    assert engine.default.bulk_load("t", spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")) == 2
    engine.default.bind_table("@p", spark.range(3))
    assert one(engine, "SELECT COUNT(*) AS n FROM t JOIN @p p ON p.id = t.a") == [(2,)]


def test_float_totals_rank_in_no_order_of_rows(engine, spark):
    r = random.Random(2)
    sets = [[0.1, 0.2, 0.3], [2.0**47, 0.1, -(2.0**47)], [1e-6, -3.5, 1e-6, 7e11]] + [[r.uniform(-1e6, 1e6) for _ in range(40)] for _ in range(20)]
    rows = [(2 * i, x) for i, values in enumerate(sets) for x in values] + [(2 * i + 1, x) for i, values in enumerate(sets) for x in reversed(values)]
    df = spark.createDataFrame(rows, "g int, x double").coalesce(1)
    engine.register("t", df)
    got = one(engine, "SELECT g, RANK() OVER (PARTITION BY g / 2 ORDER BY SUM(x) DESC, g) AS s, RANK() OVER (PARTITION BY g / 2 ORDER BY AVG(x), g DESC) AS a FROM t GROUP BY g")
    assert sorted(got) == [(g, g % 2 + 1, 2 - g % 2) for g in range(2 * len(sets))]
    sums = df.groupBy("g").agg(F.expr(float_sum("x"))).collect()
    assert sorted(map(tuple, sums)) == [(2 * i + k, math.fsum(values)) for i, values in enumerate(sets) for k in (0, 1)]


def test_float_totals_of_odd_values(spark):
    sets = [[None], [None, 1.5], [math.inf, 1.0], [math.inf, -math.inf], [1e300, 1e300, 1.0], [5e-324, 5e-324], [-0.0], [2.0**48, -1.0], [-0.1], [0.25, -(2.0**60), 2.0**60]]
    df = spark.createDataFrame([(i, x) for i, values in enumerate(sets) for x in values], "g int, x double").repartition(3)
    got = [repr(s) for _, s in sorted(map(tuple, df.groupBy("g").agg(F.expr(float_sum("x"))).collect()))]
    assert got == ["None", "1.5", "inf", "nan", "2e+300", "1e-323", "0.0", repr(2.0**48 - 1), "-0.1", "0.25"]
    assert df.where("g > 99").agg(F.expr(float_sum("x"))).collect()[0][0] is None
