"""Column functions against known values and plain models."""

import random

import pytest
from pyspark.sql import functions as F

from annulus.functions import genomics, paths
from annulus.operators.solver import insert_ranked, turn


def one(spark, column, path):
    return list(spark.createDataFrame([(path,)], "p array<bigint>").select(column(F.col("p")).alias("x")).first()["x"])


@pytest.mark.parametrize("path, expected", [([3, 2, 4, 5], [2, 4, 5, 3]), ([3, 3, 2, 4, 5], [2, 4, 5, 3, 3]), ([3, 3, 2, 2, 4, 5], [2, 2, 4, 5, 3, 3]), ([3, 2, 4, -5], [2, 4, -5, 3]), ([3, -2, 2, 4, -5], [-2, 2, 4, -5, 3])])
def test_rotation(spark, path, expected):
    assert one(spark, paths.rotate_to_minimal, path) == expected


@pytest.mark.parametrize("path, expected", [([4, 3, 2, 1], [1, 4, 3, 2]), ([4, -3, -2, 1], [1, 4, -3, -2]), ([4, -3, -2, -1, 5], [1, 2, 3, -4, -5])])
def test_canonical(spark, path, expected):
    assert one(spark, paths.canonical, path) == expected
    assert list(turn(tuple(path))) == expected


def test_canonical_equals_model(spark):
    rng = random.Random(3)
    rows = [([rng.choice([-1, 1]) * rng.randint(1, 9) for _ in range(rng.randint(1, 8))],) for _ in range(300)]
    got = spark.createDataFrame(rows, "p array<bigint>").select("p", paths.canonical(F.col("p")).alias("c"), paths.meta_hash(F.col("p")).alias("h"), paths.meta_hash(paths.opposite(F.col("p"))).alias("o")).collect()
    for r in got:
        assert tuple(r.c) == turn(tuple(r.p))
        assert r.h == r.o


def test_pairs_of_forms():
    assert turn((1, 2, 3)) == turn((2, 3, 1)) == turn((-2, -1, -3))
    assert turn((2, 3, 1, 4)) != turn((2, 3, 4, 1))
    assert turn((1, 2, 3)) != turn((-2, -3, -1))


def test_ranked_insertion():
    held = []
    for x in [(1, 10, 5, 2), (2, 20, 5, 2), (3, 20, 9, 2), (4, 20, 9, 1)]:
        insert_ranked(held, x)
    assert [x[0] for x in held] == [4, 3, 2, 1]
    held = [(1, 100, 50, 1), (2, 80, 50, 1)]
    insert_ranked(held, (3, 100, 40, 1))  # equal weight, lower coverage than an element of lower weight: it lands behind that
    assert [x[0] for x in held] == [1, 2, 3]
    held = [(1, 5, 5, 1), (2, 5, 5, 1)]
    insert_ranked(held, (3, 5, 5, 1))
    assert [x[0] for x in held] == [1, 3, 2]


@pytest.mark.parametrize("weight, cover, kind, at", [(150, 50, 3, 0), (90, 50, 3, 1), (70, 50, 3, 2), (100, 60, 3, 0), (100, 40, 3, 2), (80, 60, 3, 1), (80, 40, 3, 2), (100, 50, 2, 0), (100, 50, 3, 1), (80, 50, 3, 2)])
def test_ranked_insertion_places(weight, cover, kind, at):
    held = [(1, 100, 50, 3), (2, 80, 50, 3)]
    insert_ranked(held, (7, weight, cover, kind))
    assert [x[0] for x in held].index(7) == at


def test_ranked_insertion_is_a_sort_without_ties():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(i, w, rng.randint(1, 3), rng.randint(1, 6)) for i, w in enumerate(rng.sample(range(50), 9))]
        held: list = []
        for x in rows:
            insert_ranked(held, x)
        assert held == sorted(rows, key=lambda x: -x[1])


def test_strand_and_mate(spark):
    rows = [("[c:7[N", "++"), ("]c:7]N", "+-"), ("N[c:7[", "-+"), ("N]c:7]", "--")]
    got = spark.createDataFrame(rows, "alt string, s string").select("s", genomics.bnd_strand(F.col("alt")).alias("g"), genomics.mate_chromosome(F.col("alt")).alias("c"), genomics.mate_position(F.col("alt")).alias("p")).collect()
    assert all(r.s == r.g and r.c == "c" and r.p == 7 for r in got)


def test_small_functions(spark):
    x = spark.sql("select 2.5 a, 3.5 b, 'ACGTNacgt' s")
    r = x.select(genomics.downsampled(F.col("a"), 1).alias("a"), genomics.downsampled(F.col("b"), 1).alias("b"), genomics.reverse_complement(F.col("s")).alias("s"), genomics.coordinates(F.lit("chr1"), F.lit(3), F.lit(9)).alias("c")).first()
    assert (r.a, r.b, r.s, r.c) == (2, 4, "acgtNACGT", "chr1:3-9")
    flags = lambda **k: [F.lit(k.get("n", 2))] + [F.lit(bool(k.get(c))) for c in ("small_del", "dup", "inv", "interchr", "multi", "foldback")]
    cases = [(dict(n=1, foldback=1), 0), (dict(), 0), (dict(small_del=1), 1), (dict(inv=1), 1), (dict(small_del=1, inv=1), 2), (dict(multi=1, inv=1), 3), (dict(interchr=1), 4), (dict(dup=1, interchr=1), 5), (dict(foldback=1, dup=1), 6)]
    got = spark.range(1).select(*[genomics.topology_index(*flags(**k)).alias(str(i)) for i, (k, _) in enumerate(cases)]).first()
    assert list(got) == [e for _, e in cases]


def collapse_model(conf, gap=10):
    meets = lambda a, b: a[0] == b[0] and a[3] == b[3] and (abs(a[2] - b[1]) if a[3] == "+" else abs(a[1] - b[2])) < gap
    join = lambda a, b: (a[0], a[1] if a[3] == "+" else b[1], b[2] if a[3] == "+" else a[2], a[3], f"{a[4]}.{b[4]}", (a[5] + b[5]) / 2)
    if len(conf) == 1:
        return conf
    out, now = [], conf[0]
    for x in conf[1:]:
        if meets(now, x):
            now = join(now, x)
        else:
            out.append(now)
            now = x
    if meets(now, conf[0]):
        return out[1:] + [join(now, conf[0])]
    return out + [now]


def test_collapse(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        conf, at = [], 1000
        for k in range(rng.randint(1, 6)):
            start = at + rng.choice([0, 3, 50])
            conf.append(("c1", start, start + 100, rng.choice("++-"), str(k), float(k)))
            at = start + 100
        rows.append((i, conf))
    df = spark.createDataFrame(rows, f"i int, conf array<{paths.PIECE}>").select("i", paths.collapse(F.col("conf")).alias("c"))
    got = {r.i: [tuple(x) for x in r.c] for r in df.collect()}
    assert all(got[i] == collapse_model(conf) for i, conf in rows)
