"""The driver contract, and every query against its DuckDB counterpart at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from flatsieve.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "flatsieve.llm", None)
    import flatsieve

    monkeypatch.delattr(flatsieve, "llm", raising=False)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert names == sorted(columns)
    assert got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
