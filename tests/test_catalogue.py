"""Every query of the catalogue with SQL, against another engine on the same files."""

import os

import duckdb
import pytest

from tablewright.plans import catalogue

ROUNDED = 6


def plain(v):
    if isinstance(v, float):
        return round(v, ROUNDED)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bytearray):
        return bytes(v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf_dir, db, name):
    got = catalogue.queries()[name](spark, sf_dir)
    rel = db.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = [tuple(map(plain, r)) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall()]
    rows = [tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
