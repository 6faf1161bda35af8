import pytest

from folio.llm.oracle import ORACLE_SQL
from folio.llm.queries import QUERIES
from tests.oracle import compare, database


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, small, name):
    compare(spark, database(small), small, QUERIES[name], ORACLE_SQL[name])
