"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare, plain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = [tuple(plain(r[df.columns.index(c)]) for c in order) for r in got]
    right = [tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()]
    assert compare(left, right).startswith(("ok", "approx"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_query_pairs_all_rows(spark):
    import contextlib
    import io

    found = []
    for name, run in entry.queries().items():
        if name.endswith("_stream"):
            continue
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            run(spark, SMALL).explain()
        if "CartesianProduct" in shown.getvalue() or "BroadcastNestedLoop" in shown.getvalue():
            found.append(name)
    assert found == []
