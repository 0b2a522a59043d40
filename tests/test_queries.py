"""Every query of the library proper against its SQL on the smallest tables."""

import pytest

from terroir.plans import registry
from tests.compare import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same(registry.queries()[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["etiquette_dpe", "type_local", "n", "moyenne", "mediane"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
