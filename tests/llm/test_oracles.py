import pytest
from oracle import compare

from prosemill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, small, name):
    assert compare(spark, small, name, QUERIES[name], ORACLES[name]) == ""
