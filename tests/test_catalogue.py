"""Every catalogue query that has SQL equals it on the smallest tables; the others run."""

import duckdb
import pytest

from wakeline.plans import catalogue, oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return None if isinstance(x, float) and x != x else x + 0.0 if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v) if isinstance(v, (list, str)) else 0, v if not isinstance(v, (list, str)) and v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in oracles.ORACLE_SQL:
        assert got
        return
    found = db.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert [str(r) for r in ordered(got)] == [str(r) for r in ordered(want)] or ordered(got) == ordered(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
