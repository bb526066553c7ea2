import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_compare import duck, frame_hash
from tillroll.llm import queries as corpus_queries


def test_every_operator_is_registered():
    found = queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in found)] == []
    assert "pipeline" in found and set(corpus_queries.ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(corpus_queries.ORACLES))
def test_equals_sql(spark, name):
    got = corpus_queries.QUERIES[name](spark, SF_SMALL).toPandas()
    assert frame_hash(got) == frame_hash(duck(SF_SMALL).execute(corpus_queries.ORACLES[name]).fetchdf())
