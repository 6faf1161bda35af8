import pytest

import __spark_entry__
from folio.plans.oracle import ORACLE_SQL
from folio.plans.queries import QUERIES
from tests.oracle import compare, database


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, con, small, name):
    compare(spark, con, small, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_have_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8


def test_all_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_name_is_defined_twice():
    """A second function of a name would silently take the place of the first one under the queries that call it."""
    import ast
    import inspect

    from folio.plans import queries

    names = [n.name for n in ast.parse(inspect.getsource(queries)).body if isinstance(n, ast.FunctionDef)]
    assert sorted(set(names)) == sorted(names)
