"""Every query with an oracle gives the rows of its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docflow import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    wanted = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    a, b = plain([tuple(r) for r in found.collect()], found.columns), plain(wanted.fetchall(), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-6)), (x, y)
