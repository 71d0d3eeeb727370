"""Every named query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry_points
from lagfield.catalog import ENTRIES
from tools.compare import compare, duck


# No altitude bin reaches ten rows in the smallest tables.
EMPTY_WHEN_TINY = {"a15_altitude_profile"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    problem, rows = compare(
        spark, con, name, entry_points.queries()[name], entry_points.oracle_sql().get(name), sf_dir
    )
    assert problem is None
    assert rows > 0 or name in EMPTY_WHEN_TINY


def test_every_query_has_sql():
    assert not [n for n, e in ENTRIES.items() if e.sql is None]
    assert set(ENTRIES) <= set(entry_points.queries())


def test_entry(spark, sf_dir):
    df = entry_points.entry(spark)
    assert {"day_part", "r2", "within_10_percent"} <= set(df.columns)
    assert df.count() == 2


def test_tables_of_a_job_are_removed_with_it(spark, tmp_path):
    import os

    from lagfield.operators.bounded import settle
    from lagfield.operators.sampling import ranked
    from lagfield.session import job_tables, shared_folder

    base = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with job_tables(spark):
        with job_tables(spark, "inner") as inner:
            assert ranked(spark.range(50), "id").count() == 50
            assert len(os.listdir(inner)) == 2
        assert not os.path.exists(inner)
        out = settle(spark.range(3), "kept")
        assert out.count() == 3
    with __import__("pytest").raises(ZeroDivisionError), job_tables(spark):
        settle(spark.range(3))
        1 / 0
    assert set(os.listdir(base)) == before
