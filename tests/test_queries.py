import pytest
from compare import connect, differs

from skeinlake.plans import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, con, name):
    assert differs(spark, con, SF, Q.QUERIES[name], Q.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    Q.QUERIES[name](spark, SF).collect()
