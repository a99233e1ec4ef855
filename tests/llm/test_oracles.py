import duckdb
import pytest

from tidewater.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, FOLDER).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
