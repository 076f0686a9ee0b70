import glob
import math
import os

import duckdb
import pytest

from terrane.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    got = frame.collect()
    assert got or name in ("fusion_violations",), "no rows"
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(frame.columns) == sorted(columns)
        assert rows(frame.columns, got) == rows(columns, found.fetchall())
