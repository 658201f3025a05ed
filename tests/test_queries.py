"""Every inventory query against its DuckDB SQL on the smallest tables."""

import compare
import pytest

from tessel import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE_SQL:
        assert not compare.differences(df, duck, plans.ORACLE_SQL[name])
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
