import pytest

from tests.oracle import check
from textloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert check(spark, sf_dir, QUERIES[name], ORACLES[name]) > 0
