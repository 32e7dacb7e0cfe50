"""All registered queries next to their SQL on the smallest test data."""

import os

import pytest

from checks import load
from checks.compare import compare, database

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


@pytest.fixture(scope="module")
def tables():
    return database(SF)


@needs_data
@pytest.mark.parametrize("name", list(load().QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    line, same = compare(spark, tables, name, load().QUERIES[name], load().SQL[name], SF)
    assert same, line


def test_every_query_has_its_sql():
    assert set(load().SQL) == set(load().QUERIES)


@needs_data
def test_scores_read_their_zips_from_one_table(spark):
    """Scaling, totals and running sums read what was written, not the packages."""
    from checks.world import World
    from lanewise.operators.scoring import remediation_score

    w = World(spark, SF)
    plan = remediation_score(w.base)._jdf.queryExecution().optimizedPlan()
    scans = [leaf for leaf in plan.toString().split("\n") if "Relation" in leaf]
    assert 0 < len(scans) <= 4
