"""Every engine query that SQL can express, against DuckDB on the smallest tables; the others run."""

import pytest

from annulus.plans import queries
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_circles_are_valid(spark):
    """Found circles pass along edges of the graph, and canonical ones are unique."""
    from annulus.operators import graph, search
    from annulus.operators.solver import turn

    f, e = queries._order_graph(spark, SF)
    e = graph.strongest(e, f)
    ties = {frozenset((r.u, r.v)) for r in e.collect()}
    found = search.circles(f, e)
    for r in found.where("phase = 0").collect():
        ends = [(x + 2, x + 1) if x > 0 else (-x + 1, -x + 2) for x in r.path]  # (left by, entered by) nodes of each passage
        for (out, _), (_, into) in zip(ends, ends[1:] + ends[:1]):
            assert frozenset((out, into)) in ties
    forms = [tuple(r.path) for r in search.distinct_circles(found).collect()]
    assert len(forms) == len(set(forms)) and all(turn(p) == p for p in forms)
