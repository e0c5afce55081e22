"""Binned order against plain models, circle search and regression against brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import cli
from annulus.config import Config
from annulus.operators import breakpoints, fragments, graph, quantify, search, similarity, validate
from annulus.operators.intervals import stab_join
from annulus.operators.ordering import last_known, numbered
from annulus.operators.solver import turn
from annulus.sources import vcf
from tests.test_engine import CALLS, HEAD, line


@pytest.mark.parametrize("bin_size", [7, 10**6])
def test_last_known(spark, bin_size):
    rng = random.Random(bin_size)
    rows = [(k, at, i, bool(rng.randint(0, 1))) for i, (k, at) in enumerate(rng.sample([(k, at) for k in "ab" for at in range(200)], 150))]
    rows += [(k, at, 1000 + i, False) for k, at, i, v in rows if v][:40]  # others at the place of a known one
    df = spark.createDataFrame(rows, "k string, at long, i long, v boolean")
    for strictly in (False, True):
        for take in (None, ["i"]):
            got = {r.i: r.x for r in last_known(df, "k", "at", F.col("v"), "x", take=take, then="i", strictly=strictly, bin_size=bin_size).collect()}
            for k, at, i, v in rows:
                before = [(a, j) for q, a, j, w in rows if q == k and w and ((a, j) < (at, i) if strictly else (a, j) <= (at, i))]
                want = max(before)[0 if take is None else 1] if before else None
                assert (got[i].i if take and got[i] else got[i]) == want


def test_numbered(spark):
    rows = [(i, random.Random(i).randint(0, 20)) for i in range(500)]
    got = {r.i: r.n for r in numbered(spark.createDataFrame(rows, "i long, v long").repartition(7), [F.desc("v"), "i"], "n", 1).collect()}
    assert [got[i] for i, v in sorted(rows, key=lambda x: (-x[1], x[0]))] == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "i long"), ["i"], "n").count() == 0


def greedy(positions, distance):
    """Anchors one by one."""
    out, anchor = [], None
    for p in positions:
        if anchor is None or p - anchor > distance:
            anchor = p
        out.append((p, anchor))
    return out


@pytest.mark.parametrize("distance", [0, 1, 50])
def test_merge_over_bins(spark, distance):
    """Runs that cross many bins, gaps of just the distance, empty bins, bins narrower than the distance, repeated and null positions."""
    rng = random.Random(distance)
    sets = {f"chr{i}": sorted({rng.randrange(1, span) for _ in range(n)}) for i, (n, span) in enumerate([(900, 1000), (300, 20_000), (1, 5), (200, 10**7), (50, 60)])}
    sets["even"] = list(range(7, 3000, max(distance, 1)))
    rows = [(c, p) for c, ps in sets.items() for p in ps] * 2 + [(None, 4), ("chr1", None)]
    points = spark.createDataFrame(rows, "chr string, pos long")
    want = {(c, p, a) for c, ps in sets.items() for p, a in greedy(ps, distance)}
    for bin_size in (13, 100, 250_000):
        got = [tuple(r) for r in breakpoints.merge(points, distance, bin_size=bin_size).collect()]
        assert len(got) == len(want) and set(got) == want
    assert breakpoints.merge(points.where("false")).count() == 0


def test_merge_of_a_long_run(spark):
    """A million positions without a gap: linear work, one chromosome over many bins."""
    points = spark.range(1_000_000).selectExpr("'chr1' as chr", "id * 10 + 3 as pos")
    # positions 10 apart: an anchor takes five more, and the next one begins 60 behind it
    bad = breakpoints.merge(points, 50).where("anchor <> pos - (pos - 3) % 60").count()
    assert bad == 0
    took = []
    for n in (500_000, 1_000_000):
        began = time.time()
        assert breakpoints.merge(points.limit(n), 50).count() == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 2


@pytest.mark.parametrize("bin_size", [60, 1000, 10**6])
def test_genome_in_bins(spark, bin_size):
    """Anchors, fragments and the fragment of a position don't depend on how the genome is cut into bins."""
    rng = random.Random(5)
    pos = {c: sorted({rng.randint(1, 3000) for _ in range(n)}) for c, n in (("c1", 90), ("c2", 5), ("c3", 1))}
    points = spark.createDataFrame([(c, p, i, 0) for i, (c, p) in enumerate((c, p) for c in ("c2", "c1", "c3") for p in pos[c])], "chr string, pos long, ord long, side int")
    merged = breakpoints.merge(points, 50, bin_size=bin_size)
    anchors: dict = {}
    for c, ps in pos.items():
        for p in ps:
            held = anchors.setdefault(c, [])
            if not held or p - held[-1] > 50:
                held.append(p)
    assert {(r.chr, r.pos, r.anchor) for r in merged.collect()} == {(c, p, max(a for a in anchors[c] if a <= p)) for c, ps in pos.items() for p in ps}
    frags = fragments.fragment(breakpoints.kept_anchors(points, merged), bin_size=bin_size)
    want, fid = [], 1
    for c in ("c2", "c1", "c3"):
        for a, b in zip([0, *anchors[c]], [*anchors[c], 10**11]):
            want.append((fid, c, a, b))
            fid += 4
    assert sorted((r.fid, r.chr, r.start, r.end) for r in frags.collect()) == want
    asked = spark.createDataFrame([(i, rng.choice(["c1", "c2", "c4"]), rng.randint(-5, 4000)) for i in range(200)], "i int, chr string, at long")
    got = stab_join(asked, frags, F.col("at"), "f", ["fid"], bin_size=bin_size).select("i", "chr", "at", "f.fid").collect()
    for r in got:
        assert r.fid == next((f for f, c, a, b in want if c == r.chr and a <= r.at < b), None)
    near = {(r.fid1, r.fid2, r.bp) for r in fragments.adjacent(frags).collect()}
    assert near == {(x[0], y[0], y[2]) for x, y in zip(want, want[1:]) if x[1] == y[1]}


def circles_by_definition(frags, ties):
    """Raw circles of one connected graph without equal weights. frags: fid -> (tail, head); ties: (id, u, v, weight)."""
    out_of = {a: b for t, h in frags.values() for a, b in ((t, h), (h, t))}
    sign = {n: s * f for f, (t, h) in frags.items() for n, s in ((t, 1), (h, -1))}
    at = {n: sorted((k for k in ties if n in k[1:3]), key=lambda k: -k[3]) for n in out_of}
    known, every, last = set(), [], set()
    for fid, (tail, head) in sorted(frags.items()):
        degree = [sum((k[1] == n) + (k[2] == n) for k in ties) for n in (tail, head)]
        if 0 in degree or (degree == [1, 1] and fid in last):
            continue
        used, seen, trail, found = set(), set(), [], []

        def walk(entry):
            here = out_of[entry]
            seen.update((entry, here))
            trail.append(entry)
            for e, u, v, _ in at[here]:
                to = v if u == here else u
                if e not in used and to in trail:
                    start = len(trail) - 1 - trail[::-1].index(to)
                    path = tuple(sign[n] for n in trail[start:])
                    if path not in known:
                        known.add(path)
                        found.append(path)
            for e, u, v, _ in at[here]:
                if e not in used:
                    used.add(e)
                    walk(v if u == here else u)
            trail.pop()

        walk(tail)
        last = {abs(x) for p in found for x in p}
        every += found
    return every


def combined_by_definition(raw, length):
    alike = lambda p, q: (lambda a, b: sum(length[x] for x in a & b) / sum(length[x] for x in a | b))({abs(x) for x in p}, {abs(x) for x in q})
    accepted = []
    for start in dict.fromkeys(p[0] for p in raw):
        own = [p for p in raw if p[0] == start]
        own = [p for i, p in enumerate(own) if all(alike(p, q) <= 0.9 for q in own[i + 1 :])]
        for size in range(2, len(own) + 1):
            for some in itertools.combinations(own, size):
                form = turn(sum(some, ()))
                if form not in raw and form not in accepted and max([alike(form, a) for a in accepted], default=0) <= 0.7:
                    accepted.append(form)
    return accepted


def test_search_equals_brute_force(spark):
    """Random connected graphs with loops and parallel edges, all solved as parts of one."""
    rng = random.Random(11)
    frows, erows, want, first = [], [], {}, 1
    while len(want) < 120:
        n = rng.randint(1, 5)
        frags = {first + 4 * i: (first + 4 * i + 1, first + 4 * i + 2) for i in range(n)}
        nodes = [x for p in frags.values() for x in p]
        weights = rng.sample(range(5, 400), rng.randint(1, 7))
        ties = [(first * 100 + i, rng.choice(nodes), rng.choice(nodes), float(w)) for i, w in enumerate(weights)]
        fid_of = {x: f for f, p in frags.items() for x in p}
        reach, todo = set(), [min(frags)]
        while todo:
            f = todo.pop()
            if f not in reach:
                reach.add(f)
                todo += [fid_of[b] for _, u, v, _ in ties for a, b in ((u, v), (v, u)) if fid_of[a] == f]
        if len(reach) < n:
            continue
        length = {f: float(rng.randint(1, 60) * 10) for f in frags}
        raw = circles_by_definition(frags, ties)
        if len(raw) > 14:
            continue
        want[first] = raw, combined_by_definition(raw, length)
        frows += [(f, "c", 0, 100, t, h, f + 3, 9.0, length[f]) for f, (t, h) in frags.items()]
        erows += [(e, u, v, 4, w) for e, u, v, w in ties]
        first += 4 * n
    f = spark.createDataFrame(frows, "fid long, chr string, start long, end long, tail long, head long, edge_id long, coverage double, len double")
    e = spark.createDataFrame(erows, "edge_id long, u long, v long, svtype int, weight double")
    got: dict = {}
    for r in search.circles(f, e).orderBy("part", "phase", "seq").collect():
        got.setdefault(r.part, ([], []))[r.phase].append(tuple(r.path))
    assert sum(len(b) for _, b in want.values()) > 10
    assert {k: (a, b) for k, (a, b) in want.items() if a or b} == got
    loose = {r.fid for r in graph.standalone(f, e).collect()}
    touched = {x for _, u, v, *_ in erows for x in (u, v)}
    assert loose == {r[0] for r in frows if r[4] not in touched and r[5] not in touched}


def test_lasso_equals_active_sets():
    """The optimum has one of the possible sets of positive weights, each of which has one solution."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, k, alpha = int(rng.integers(3, 9)), int(rng.integers(1, 5)), 0.1
        x, y = rng.integers(0, 3, (n, k)).astype(float) + 0.001, rng.uniform(0, 200, n)
        xc, yc = x - x.mean(0), y - y.mean()
        best = (float(yc @ yc) / (2 * n), np.zeros(k))
        for size in range(1, k + 1):
            for some in map(list, itertools.combinations(range(k), size)):
                w = np.zeros(k)
                w[some] = np.linalg.lstsq(xc[:, some].T @ xc[:, some], xc[:, some].T @ yc - alpha * n, rcond=None)[0]
                if (w >= 0).all():
                    best = min(best, (float(((yc - xc @ w) ** 2).sum()) / (2 * n) + alpha * w.sum(), w), key=lambda b: b[0])
        got = quantify.positive_lasso(x, y, alpha=alpha, steps=20_000, tolerance=1e-12)
        cost = ((yc - xc @ got) ** 2).sum() / (2 * n) + alpha * got.sum()
        assert (got >= 0).all() and cost <= best[0] + 1e-6 * (1 + best[0])


def test_abundance_of_clusters(spark):
    """A cluster's scores by the same steps: optimum, without the genome's own circle, cut off below a fifth of the least coverage or 10."""
    circles = spark.createDataFrame([(0, [1, 5, -9]), (1, [5, 13]), (2, [21]), (3, [29, 33]), (4, [37]), (5, [-37])], "circ_id long, path array<long>")
    cover = {1: 120.0, 5: 190.0, 9: 118.0, 13: 75.0, 21: 33.0, 29: 10.0, 33: 20.0, 37: 50.0}
    frags = spark.createDataFrame(list(cover.items()), "fid long, coverage double")
    got = {r.circ_id: r for r in quantify.abundance(circles, frags, 4.0, Config(lasso_steps=50_000, lasso_tolerance=1e-12)).collect()}
    assert got[2].score == 33.0 and got[3].score == 15.0 and got[4].score == got[5].score == 100.0
    assert abs(got[0].score - 117) < 3 and abs(got[1].score - 73) < 3 and got[0].cluster == got[1].cluster == 1
    assert {r.circ_id for r in quantify.abundance(circles, frags.withColumn("coverage", F.when(F.col("fid") == 13, 6.0).otherwise(F.col("coverage"))), 4.0).collect()} >= {0, 2, 3, 4, 5}


@pytest.mark.parametrize("above, multiset", [(0.3, True), (0.7, True), (0.5, False), (0.9, False)])
def test_jaccard_above(spark, above, multiset):
    rng = random.Random(above)
    length = {i: float(rng.randint(1, 9)) for i in range(14)}
    paths = {c: [rng.choice([1, 1, 2, 3, *range(14)]) for _ in range(rng.randint(1, 6))] for c in range(70)}
    w = spark.createDataFrame([(c, f, p.count(f), length[f]) for c, p in paths.items() for f in set(p)], "circ_id long, fid long, mult long, len double")
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in similarity.jaccard(w, multiset=multiset, above=above).collect()}
    want = {}
    for a, b in itertools.combinations(paths, 2):
        count = lambda c, f: paths[c].count(f) if multiset else int(f in paths[c])
        small, large = (sum(pick(count(a, f), count(b, f)) * length[f] for f in length) for pick in (min, max))
        if small / large > above:
            want[a, b] = (small, small / large)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and want


def test_compare_ways(spark):
    circle = lambda names: spark.createDataFrame([(n, 1.0, 0) for n in names], "circ_id string, length_mb double, topology_idx int")
    hits = spark.createDataFrame([("a", "x", 0.5)], "qseqid string, sseqid string, identity double")
    back = spark.createDataFrame([("y", "b", 0.25)], "qseqid string, sseqid string, identity double")
    rows = lambda **k: {(r.true_id, r.reconstruct_id, r.pident_true, r.pident_reconstruct) for r in validate.compare(circle("ab"), circle("xyz"), hits, back, **k).collect()}
    want = {("a", "x", 0.5, 0.0), ("b", "y", 0.0, 0.25)}
    assert rows(every=False) == want and rows() == rows(few=1) and rows() == want | {(t, r, 0.0, 0.0) for t in "ab" for r in "xyz" if (t, r) not in {("a", "x"), ("b", "y")}}


def test_filter_leaves_bad_records_out(spark, tmp_path, capsys):
    bad = line(9, CALLS[0], "./.").replace("GT:DR:DV", "GT").replace(";STRANDS=+-", "")
    (tmp_path / "x.vcf").write_text(HEAD + "\n".join([*(line(i, c) for i, c in enumerate(CALLS)), bad]) + "\n")
    with pytest.raises(Exception, match="STRANDS"):
        vcf.read_calls(spark, str(tmp_path / "x.vcf")).collect()
    assert cli.main(["filter", "-i", f"{tmp_path}/x.vcf", "-o", f"{tmp_path}/kept"]) == 0
    assert spark.read.text(f"{tmp_path}/kept").count() == 2 + len(CALLS) and "record 9 left out" in capsys.readouterr().out
    many = "chr5\t148175216\tm\tN\t<INV>\t.\tPASS\tSVTYPE=INV;SVLEN=539;CHR2=chr5;END=148174677;STRANDS=--\tGT:DR\t./.:0,0\t./.:1,29"
    (tmp_path / "m.vcf").write_text(HEAD + many + "\n" + many.replace("1,29", "1,2") + "\n")
    assert cli.main(["filter", "--multi", "-i", f"{tmp_path}/m.vcf", "-o", f"{tmp_path}/kept2"]) == 0
    assert spark.read.text(f"{tmp_path}/kept2").count() == 3
