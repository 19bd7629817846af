import os

import pytest
from oracle_check import SMALL, no_product, same_as_oracle

from kmerloom.llm.oracle import ORACLE
from kmerloom.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, name):
    same_as_oracle(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, SMALL)
    no_product(df)
    assert df.count() > 0
