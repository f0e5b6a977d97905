"""Every registered query of the audit against its SQL, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__
from usage_audit.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)).values.tolist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_paths_over_whole_tables(spark, duck):
    parts = {f"p{k}": k % 101 == 0 for (k,) in duck.execute("SELECT p_partkey FROM part").fetchall()}
    links = duck.execute("SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'").fetchall()
    onward = {}
    for a, b in links:
        onward.setdefault(a, set()).add(b)
    distance = {k: 0 for k, entry in parts.items() if entry}
    level = list(distance)
    for a in level:  # grows as it is read: breadth first
        for b in onward.get(a, ()):
            if b not in distance:
                distance[b] = distance[a] + 1
                level.append(b)
    got = {r["key"]: r["steps"] for r in queries.QUERIES["path_to_root"](spark, SF).collect()}
    assert set(got) == set(distance)
    assert all(1 <= got[k] <= min(n + 1, 12) for k, n in distance.items())  # orders have no label


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
