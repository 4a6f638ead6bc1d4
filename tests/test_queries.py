"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from behaviorlens.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(records, names):
    return sorted(repr([r[n] for n in names]) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, SF).toPandas()
    want = tables.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    names = sorted(found.columns)

    def plain(frame):
        out = []
        for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False):
            out.append(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row))
        return sorted(out, key=repr)

    assert plain(found) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "llm_registry", None)
    monkeypatch.setattr(__spark_entry__, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
