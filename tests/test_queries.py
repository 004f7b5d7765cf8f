"""Every named query: against its SQL where there is one, else that it gives rows."""

import pytest

from mimiq.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    same_rows(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_gives_rows(spark, sf, name):
    assert len(catalog.QUERIES[name](spark, sf).take(1)) == 1


def test_entry_needs_no_training_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
