"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
from decimal import Decimal

import pytest

from bitloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    plain = lambda rows: sorted(str(tuple(int(v) if isinstance(v, Decimal) else v for v in r)) for r in rows)
    want = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert plain(tuple(r[n] for n in names) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_checksums_verify(spark):
    assert catalog.queries()["checksums"](spark, SF).where("not same").count() == 0


def test_entry_needs_no_training_data_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read_text()), f
