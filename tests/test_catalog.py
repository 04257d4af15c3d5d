import pytest

from talentloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["profile_id", "base_score", "fields_matched", "match_score", "single_matches"]
