"""Every catalogue query with an SQL twin, compared row by row on the smallest tables."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def duck(corpus):
    return connect(corpus)


def test_every_twin_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_query(spark):
    row = entry(spark).first()
    assert 0 < row.accuracy <= 1


@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - set(oracle_sql()) if not re.match(r"op\d+_|pipeline", n)))
def test_queries_without_a_twin_run(spark, corpus, name):
    rows = queries()[name](spark, corpus).toPandas()
    assert len(rows) and not rows.isnull().any(axis=None)
    if "score" in rows:
        assert rows["doc_id"].is_unique and set(rows["prediction"]) <= {0, 1}


# The smallest tables have strata with one member, which is an error by rule.
NEEDS_MORE_ROWS = {"sample_multi_strata"}


@pytest.mark.parametrize("name", sorted(NEEDS_MORE_ROWS))
def test_query_on_larger_tables(spark, corpus, name):
    with pytest.raises(ValueError, match="one member"):
        queries()[name](spark, corpus)
    larger = corpus.replace("0.001", "0.01")
    got = queries()[name](spark, larger).toArrow()
    assert compare(got, connect(larger).sql(oracle_sql()[name]).to_arrow_table()) == ""


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - NEEDS_MORE_ROWS))
def test_query_equals_its_twin(spark, corpus, duck, name):
    got = queries()[name](spark, corpus).toArrow()
    assert compare(got, duck.sql(oracle_sql()[name]).to_arrow_table()) == ""
