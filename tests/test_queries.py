"""Every query of the core runs, and equals its SQL where it has one."""

import os

import pandas as pd
import pytest

from heliotable.queries import oracle_sql, queries

SQL = oracle_sql()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, str):
            return v
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables(sample_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(sample_dir):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sample_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sample_dir, tables, name):
    frame = queries()[name](spark, sample_dir)
    if name not in SQL:
        assert frame.count() >= 0
        return
    found, told = frame.toPandas(), tables.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    assert rows(found) == rows(told)


def test_entry_has_all_names():
    import __spark_entry__ as entry

    assert set(queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sample_dir):
    import __spark_entry__ as entry

    if entry.SMOKE_DIR == sample_dir:
        assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "heliotable"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "heliotable.llm" not in path.read_text()
