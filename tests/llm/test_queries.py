import pytest

from codequarry.llm.queries import QUERIES, SQL
from tests.compare import SF, connection, needs_data, same

COLUMNS = {"p1_found": ["vec_a", "vec_b"], "p2_found": ["file_path"], "p3_found": ["id"], "p5_found": ["id", "func_name"], "p6_found": ["id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.fixture(scope="module")
def c():
    return connection()


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, c, name):
    same(spark, c, QUERIES[name], SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
