"""Every registered catalog query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from aislegrid.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Spark's names of types by DuckDB's.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    wanted = duck.sql(ORACLES[name])
    kinds = {c: TYPES[str(t)] for c, t in zip(wanted.columns, wanted.types, strict=True)}
    assert dict(got.dtypes) == kinds
    order = sorted(kinds)
    at = [wanted.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())
