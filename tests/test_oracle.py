"""Every query of the library next to its SQL twin on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry
from signalloom.plans import load

SF = "/root/testdata/sf0.001"
LIBRARY = load()
#: Queries without a twin: the others must have one.
NO_TWIN = {
    "corroborate", "event_twins", "explain_score", "page_text", "resolve_entities", "stream_events", "stream_scores",
}


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", sorted(LIBRARY.QUERIES))
def test_query_equals_twin(spark, con, name):
    assert (name in LIBRARY.TWINS) != (name in NO_TWIN)
    ok, note = oracle_check.check(spark, con, SF, name, LIBRARY.QUERIES[name], LIBRARY.TWINS.get(name))
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0 and set(LIBRARY.QUERIES) <= set(entry.queries())
