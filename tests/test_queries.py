import os

import pytest
from compare import FOLDER, assert_same

from postmill.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    if name in registry.sql():
        assert_same(df, registry.sql()[name])
    else:
        assert len(df.collect()) > 0  # what they hold is tested elsewhere


def test_every_sql_has_its_query():
    assert set(registry.sql()) <= set(registry.queries())


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
