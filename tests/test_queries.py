"""Every query of the engine against its SQL, over the smallest tables."""

import os

import pytest

from tessella.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, compare, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.SQL:
        ours, theirs = compare(df, Q.SQL[name], SF)
        assert ours == theirs
    else:
        assert df.count() > 0
