import pytest
from compare import connect, same

from stridelake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])
