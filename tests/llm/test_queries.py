import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(ORACLE_SQL[name], sf_dir)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
