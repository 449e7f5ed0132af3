"""The llm queries that SQL can express, against DuckDB on the small tables."""

import pytest

from tests.test_oracles import duck, test_query_equals_sql as equals_sql  # noqa: F401
from tracklattice.llm import queries as llm
from tracklattice.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_llm_query_equals_sql(spark, duck, sf, name, monkeypatch):  # noqa: F811
    monkeypatch.setitem(QUERIES, name, llm.QUERIES[name])
    monkeypatch.setitem(SQL, name, llm.SQL[name])
    equals_sql(spark, duck, sf, name)
