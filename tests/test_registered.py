"""Every registered query against its SQL, over whole tables."""

import __spark_entry__ as entry
import oracle
import pytest
from loomquill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, name):
    assert not oracle.difference(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["party", "word", "z", "rank"] and df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    registry.QUERIES["date_range"](spark, SF).explain("formatted")
    registry.QUERIES["meta_per_year"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "PushedFilters" in plan
