import pytest

from millrace import registry

SLOW = {"pmi_profile"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(name, compare):
    compare(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry_runs(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["n_nationkey", "n_name", "cnt"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
