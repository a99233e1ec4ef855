"""Every registered query of the engine against its oracle, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
from conftest import DATA

from tidewater import plans
from tidewater.plans.runner import TABLES

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (datetime.date, datetime.datetime, decimal.Decimal)):
        return str(v)
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_matches_oracle(spark, oracle, name):
    df = plans.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    cursor = oracle.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_flagship_pushes_down(spark):
    from tidewater.plans.runner import open_folder

    plan = open_folder(spark, FOLDER).explain("SELECT l_orderkey FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")["plan"]
    assert "LessThan(l_quantity" in plan and "EqualTo(l_returnflag" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_equal_totals_rank_by_key(spark, tmp_path):
    """Copies of the customers, whose orders come in another order, share their totals to the cent."""
    c = duckdb.connect()
    c.execute(f"create table o as select * from '{FOLDER}/orders.parquet'")
    keys = c.execute("select max(o_orderkey) + 1, max(o_custkey) + 1 from o").fetchone()
    c.execute("create table orders as select * from o order by o_orderkey")
    c.execute("insert into orders select * replace (o_orderkey + ? as o_orderkey, o_custkey + ? as o_custkey) from o order by o_orderkey desc", keys)
    c.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    df = plans.queries()["win_over_group"](spark, str(tmp_path))
    cents = plans.oracle_sql()["win_over_group"].replace("SUM(o_totalprice)", "SUM(CAST(o_totalprice AS DECIMAL(18, 2)))")
    want = [(k, float(total), place) for k, total, place in c.execute(cents).fetchall()]
    assert sorted(map(tuple, df.collect())) == sorted(want)
