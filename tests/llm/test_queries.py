import pytest

from tests.llm.oracle import compare
from tracelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, sf, queries.queries()[name](spark, sf), queries.oracle_sql()[name])
