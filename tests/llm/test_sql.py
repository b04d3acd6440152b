"""Corpus queries with SQL give what DuckDB gives on the smallest tables."""

from pathlib import Path

import pytest

from evidara.llm.queries import ORACLES, QUERIES
from tests.test_queries import SF, duck, rows  # noqa: F401  duck is a fixture

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())
