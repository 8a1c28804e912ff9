import pytest
from oracle import same

import __spark_entry__ as entry
from lurewatch import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    f = registry.queries()[name]
    if name in SQL:
        same(spark, sf_dir, f, SQL[name])
    else:
        assert f(spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
