"""Steps that must not move more than their input, and the ways round for what doesn't fit the short one."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.operators import alignment, annotate, breakpoints, circuits, fragments, graph, ordering, quantify, search, similarity, solver
from annulus.operators.lineage import durable
from annulus.plans import queries
from tests.shuffled import shuffled


@pytest.fixture
def no_broadcast(spark):
    """Small tables joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _circles(n):
    return [(c, f, 1 + (c + f) % 2, float(100 + f % 7)) for c in range(n) for f in {(c * k) % 40 for k in (1, 3, 7, 11)}]


def _brute(rows, multiset, above):
    w = defaultdict(dict)
    for c, f, m, size in rows:
        w[c][f] = m * size if multiset else size
    out = {}
    for a in w:
        for b in w:
            both = sum(min(w[a][f], w[b][f]) for f in w[a].keys() & w[b].keys())
            union = sum(w[a].values()) + sum(w[b].values()) - both
            if a < b and both / union > above:
                out[a, b] = round(both / union, 9)
    return out


@pytest.mark.parametrize("short", [64, 3, 0])
@pytest.mark.parametrize("multiset", [True, False])
def test_likeness_of_short_and_long_circles(spark, monkeypatch, short, multiset):
    """Pairs with a circle too long for a row are counted by joins, with the same result."""
    monkeypatch.setattr(similarity, "SHORT", short)
    rows = _circles(60) + [(100 + i, f, 1, 50.0) for i in range(2) for f in range(i, 90)]
    df = spark.createDataFrame(rows, "circ_id long, fid long, mult long, len double")
    found = similarity.jaccard(df, multiset=multiset, above=0.3).collect()
    assert {(r.a, r.b): round(r.jaccard, 9) for r in found} == _brute(rows, multiset, 0.3)


def test_likeness_moves_no_pairs(spark, no_broadcast):
    """Each fragment pairs its circles by the hundred, but only pairs that may be alike leave the task."""
    df = spark.createDataFrame([(c, f, 1, 100.0) for c in range(2000) for f in {c % 10, 40 + c % 11, 100 + c % 13, 200 + c % 9}], "circ_id long, fid long, mult long, len double")
    rows, _ = shuffled(spark, lambda: similarity.jaccard(df, multiset=True, above=0.5).agg(F.count("*")).collect())
    assert rows < 12 * df.count()


SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_parts_take_one_shuffle(spark, no_broadcast):
    """Parts whose ids are near each other are found where they lie, not by rounds of joins."""
    f, e = queries._rings(spark, SF)
    f, e = f.localCheckpoint(), e.localCheckpoint()
    rows, _ = shuffled(spark, lambda: search.circles(f, e).count())
    assert rows < 3 * f.count()


def test_parts_across_blocks(spark, monkeypatch):
    """Parts over several blocks of ids, ends that no fragment has, and single fragments come out as by joins."""
    monkeypatch.setattr(search, "BLOCK_BITS", 5)
    f, e = queries._order_graph(spark, SF)
    f = f.where("fid % 40 <> 5").localCheckpoint()  # so some edges end in nothing
    found, rest = search.by_block(f, e, lambda key, part: [(x, key) for x in part.frags], "fid long, part long")
    assert rest is not None and 0 < found.count() < f.count()
    assert _rows(search.parts(f, e)) == _rows(search._parts(f, e))


def test_circles_and_abundance_across_blocks(spark, monkeypatch):
    f, e = queries._rings(spark, SF)
    f, e = f.localCheckpoint(), e.localCheckpoint()
    circles = search.circles(f, e).localCheckpoint()
    numbered = search.distinct_circles(circles).localCheckpoint()
    scores = _rows(quantify.abundance(numbered, f, 4.0))
    monkeypatch.setattr(search, "BLOCK_BITS", 4)
    assert _rows(search.circles(f, e)) == _rows(circles)
    assert _rows(quantify.abundance(numbered, f, 4.0)) == scores


def test_bins_are_small():
    """What one window or one list holds of a chromosome doesn't grow to a share of it."""
    assert ordering.BIN <= 50_000 and breakpoints.MERGE_BIN <= 50_000


def test_lines_are_dealt_to_all_cores(spark):
    assert queries.QUERIES["vcf_sniffles2"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert queries.QUERIES["vcf_filter"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_places_are_not_broadcast(spark):
    """Words are many more rows than the blocks that their size is judged by."""
    b = spark.createDataFrame([("c", 0, "ACGTTGCATTAGACCATAGG" * 3)], "circ_id string, block long, seq string")
    plan = alignment.matches(b, b, k=16, size=64)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["topology", "annotate_circles", "bed_circles", "summary_table"])
def test_flags_are_made_once(spark, monkeypatch, name):
    """Array functions that several columns are made of would run once for each of them."""
    made = []
    monkeypatch.setattr(annotate, "durable", lambda df: (made.append(df), durable(df))[1], raising=False)
    df = queries.QUERIES[name](spark, SF)
    plans = "".join(x._jdf.queryExecution().optimizedPlan().toString() for x in [*made, df])
    assert 0 < plans.count("lambdafunction(") <= 15
    assert len(made) == (name == "summary_table")


def _paths(df):
    return sorted(tuple(r.path) for r in df.collect())


def test_circuits_take_one_shuffle(spark, no_broadcast):
    """Parts inside a block of ids are grown where they lie, not by a join a round."""
    f, e = queries._order_graph(spark, SF)
    f, e = f.localCheckpoint(), e.localCheckpoint()
    rows, _ = shuffled(spark, lambda: circuits.circuits(f, e).count())
    assert rows <= 1.1 * (f.count() + e.count())


@pytest.mark.parametrize("bits, rows, paths", [(8, 2_000_000, 200_000), (5, 2_000_000, 200_000), (10, 100, 200_000), (10, 2_000_000, 30)])
def test_circuits_across_blocks(spark, monkeypatch, bits, rows, paths):
    """Parts over several blocks, blocks of too many rows, parts of too many paths, and ends that no fragment has come out as by joins."""
    _, e = queries._order_graph(spark, SF)
    f, e = queries.spark_view(spark, SF, "order_fragment").where("fid % 40 <> 5 and grp < 200").localCheckpoint(), e.where("edge_id < 520000").localCheckpoint()
    want = _paths(circuits._by_joins(f, e, 40, 50_000_000))
    for name, value in (("BLOCK_BITS", bits), ("MOST_ROWS", rows)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(circuits, "AT_ONCE", paths)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        _, rest = circuits._in_blocks(f, e, 40, paths)
        assert rest.count() > 0 and _paths(circuits.circuits(f, e)) == want and want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _moved(spark, run, f, e):
    """Rows shuffled for each row of a graph."""
    f, e = f.localCheckpoint(), e.localCheckpoint()
    return shuffled(spark, lambda: run(f, e).write.format("noop").mode("overwrite").save())[0] / (f.count() + e.count())


def test_graph_moves_edges_no_more_than_needed(spark, no_broadcast):
    f, e = queries._order_graph(spark, SF)
    assert _moved(spark, lambda f, e: graph.strongest(e, f), f, e) < 2.7
    assert _moved(spark, lambda f, e: graph.adjacency(e), f, e) < 1
    assert _moved(spark, lambda f, e: circuits.loops(f, e, 24.0)[0], f, e) < 5
    spec = queries.spark_view(spark, SF, "part_fragment").selectExpr("fid as node1", "fid + 1 as node2", "fid as frag1", "fid + fid % 8 div 5 as frag2", "0 as part1", "1 as part2", "fid as edgeid", "1 as svtype", "coverage as cov")
    assert _moved(spark, lambda f, e: graph.from_spec(f)[1], spec, e.limit(0)) < 0.8


def test_order_graph_asks_no_function(spark):
    assert "lambdafunction(" not in queries._order_graph(spark, SF)[1]._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_are_solved_together(spark, monkeypatch):
    """The regression runs for many clusters at once, not once for each, with the results of each by itself."""
    rng = np.random.default_rng(7)
    cover = {256 * g + i: float(rng.integers(1, 60)) for g in range(300) for i in range(1 + g % 7)}
    paths = [[int(x) for x in rng.choice([f for f in cover if f // 256 == g], rng.integers(1, 6))] for g in range(300) for _ in range(1 + g % 5)]
    want = {}
    for g in range(300):
        own = [(c, p) for c, p in enumerate(paths) if p[0] // 256 == g]
        left = {f for _, p in own for f in p}
        while left:  # a cluster
            some = {left.pop()}
            while more := {f for _, p in own if some & set(p) for f in p} - some:
                some |= more
            left -= some
            ids, line = [c for c, p in own if some & set(p)], {f: i for i, f in enumerate(sorted(some))}
            y = np.array([cover[f] for f in line])
            columns = [tuple(np.array(sorted((line[f], paths[c].count(f)) for f in set(paths[c]))).T) for c in ids]
            score = [y.mean()] if len(ids) == 1 else [100.0] * len(ids) if len(y) == 1 else quantify.solve_cluster(columns, y, 4.0)
            want |= {c: (round(float(s), 6), min(some)) for c, s in zip(ids, score) if not np.isnan(s)}
    circles = spark.createDataFrame(list(enumerate(paths)), "circ_id long, path array<long>").localCheckpoint()
    frags = spark.createDataFrame(list(cover.items()), "fid long, coverage double").localCheckpoint()
    scored = lambda: {r.circ_id: (round(r.score, 6), r.cluster) for r in quantify.abundance(circles, frags, 4.0).collect()}
    assert scored() == want
    monkeypatch.setattr(quantify, "AT_ONCE", 50)
    monkeypatch.setattr(quantify, "CELLS", 200)
    monkeypatch.setattr(quantify, "MOST_ROWS", 150)  # larger blocks are left whole
    assert scored() == want

    def alone(*a, **b):
        raise AssertionError("a cluster by itself")

    monkeypatch.undo()
    monkeypatch.setattr(quantify, "solve_cluster", alone)
    monkeypatch.setattr(quantify, "positive_lasso", alone)
    assert scored() == want


def test_ties_are_ranked_once(monkeypatch):
    """A node's ties have one order for all roots of its part."""
    asked = []
    ranked = solver.ranked_ties
    monkeypatch.setattr(solver, "ranked_ties", lambda part, node: (asked.append(node), ranked(part, node))[1])
    frags = {4 * i + 1: solver.Frag(4 * i + 1, "", 0.0, 1.0, 4 * i + 2, 4 * i + 3, 4 * i + 4, 1.0, 1.0) for i in range(5)}
    ties = {100 + 10 * i + j: (4 * i + 3, 4 * ((i + j) % 5) + 2, 4, 1.0 + j) for i in range(5) for j in (1, 2)}
    assert len(solver.simple_circles(solver.Part(frags, ties))) > 5 and len(asked) == len(set(asked)) == 10


def test_calls_move_once_for_each_end(spark, no_broadcast):
    """Fragments are looked up for positions, not for calls."""
    n = 20_000
    sv = spark.range(n).selectExpr("id as ord", "'chr1' as chr1", "1000 + id % 150 * 1000 as pos1", "'chr1' as chr2", "300000 + id % 70 * 1000 as pos2", "array('DEL', 'DUP', 'INV', 'BND')[id % 4] as svtype", "'+-' as strand", "id % 9 as dv").localCheckpoint()
    points = breakpoints.breakpoints(sv)
    merged = breakpoints.merge(points).localCheckpoint()
    frags = fragments.fragment(breakpoints.kept_anchors(points, merged)).localCheckpoint()
    rows, _ = shuffled(spark, lambda: graph.sv_edges(sv, merged, frags).select("ord", "u", "v").write.format("noop").mode("overwrite").save())
    assert rows < 2.3 * n
