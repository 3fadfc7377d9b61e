"""Every query of the table reader, beside SQL over the same base tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gridpoint.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def counted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 7) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, DATA)
    rows = found.collect()
    assert rows
    if name in registry.ORACLES:
        told = sql.execute(registry.ORACLES[name])
        names = [d[0] for d in told.description]
        assert sorted(found.columns) == sorted(names)
        assert counted(rows, found.columns) == counted(told.fetchall(), names)
