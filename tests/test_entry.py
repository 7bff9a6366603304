"""The driver's contract: queries, their SQL, and results against DuckDB on the smallest tables."""

import importlib
import sys

import duckdb
import pytest

from millrace.plans import catalogue, forms_catalogue, registry_catalogue, rules_catalogue  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr([plain(x) for x in value]) if isinstance(value, (list, tuple)) else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, sql = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = lambda cols: [cols.index(c) for c in sorted(cols)]
    mine = sorted(tuple(plain(r[i]) for i in order(df.columns)) for r in df.collect())
    assert mine == sorted(tuple(plain(r[i]) for i in order(sql.columns)) for r in sql.fetchall())


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "closing_balance", "cash_gap", "gap_date"]
