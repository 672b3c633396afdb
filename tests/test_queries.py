"""Every graph query that has SQL equals it, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from strandline.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(rows, cols):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v)
    return sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.NAMED))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows, cols = [r.asDict() for r in df.collect()], sorted(df.columns)
    if name in oracle.QUERIES:
        got = duck.execute(oracle.oracle_sql()[name])
        names = [d[0] for d in got.description]
        want = [dict(zip(names, r)) for r in got.fetchall()]
        assert sorted(names) == cols
        assert same(rows, cols) == same(want, cols)
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["n1", "n2", "mark"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
