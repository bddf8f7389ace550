"""Queries of the subpackage over the small tables; those with SQL give what the SQL gives."""

import pytest

from test_queries import same
from tarn.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(set(map(str, rows)))


def test_matches_hold_the_labels(spark):
    """Of the labelled pairs of one organisation (labels may be wrong), nearly all are found."""
    d = "/root/testdata/sf0.01"
    found = {(r["l_id"], r["r_id"]) for r in QUERIES["p5_matches"](spark, d).select("l_id", "r_id").collect()}
    from tarn.llm.queries import _links

    true = {tuple(r) for r in _links(spark, d).where("matched_entity_id LIKE 'S2-%'").collect()}
    assert len(true & found) / len(true) > 0.8
