"""Every registered query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from draftloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "decimal(20,2)": "DECIMAL(20,2)"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    found = oracle.execute(catalog.ORACLES[name])
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert sorted(kinds) == sorted(df.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    names = sorted(kinds)
    order = [list(kinds).index(n) for n in names]
    want = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
    assert got == want


def test_all_names_have_functions_and_docs():
    assert len(catalog.QUERIES) >= 90
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_imports_and_lists_the_catalogue(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
