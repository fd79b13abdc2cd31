"""Each registered query with SQL against DuckDB at the smallest scale, and a run of the others."""

import os

import duckdb
import pytest

from chronolens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_is_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted(names) == columns and len(got) == len(want)
    assert got == want or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
