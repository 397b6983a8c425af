"""Each query that SQL can express against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from scoreline import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = ("m", "t")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(norm, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n in registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_has_a_key_of_the_survey():
    kinds = set("abcdefgjmpstw")
    assert all(n[0] in kinds and n[1].isdigit() for n in registry.QUERIES)
    assert len(registry.QUERIES) > 150
