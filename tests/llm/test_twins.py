"""The corpus queries next to their SQL twins on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry
from signalloom.llm.queries import QUERIES, TWINS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, name):
    ok, note = oracle_check.check(spark, oracle_check.duck(SF), SF, name, QUERIES[name], TWINS.get(name))
    assert ok, note


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
