"""Ids of any type and range, empty tables, null ids and repeated rows, where they were not handled before."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import decontam, fingerprints, sieve
from tests.llm.test_operators import SCHEMA, rows_of, text


def halves(rows):
    """Edited texts by sorting: null ids first, then by id. rows: (id, text), ids distinct."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0].encode() if isinstance(r[0], str) else r[0] or 0))
    out = {}
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        out[k] = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    return out


KINDS = {
    "far": ("long", [-(2**63), -(2**63) + 1, -5, 0, 7, 2**62, 2**63 - 2, 2**63 - 1, None]),
    "near top": ("long", [2**63 - 1 - i for i in range(40)]),
    "text": ("string", [f"doc-{i:04}" for i in range(40)] + ["doc-", "doc-0001a", "é", None]),
    "other text": ("string", ["", "a", "b" * 30, "b" * 30 + "c", "z"]),
    "numbers": ("double", [0.5, 0.25, -3.0, 1e30, -1e30, None]),
    "bytes": ("binary", [b"a", b"b", b"ab"]),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("size", [1, 500])
def test_next_of_any_id(spark, kind, size):
    rng = random.Random(4)
    name, ids = KINDS[kind]
    rows = [(i, text(rng, rng.randint(0, 30)) if rng.random() < 0.9 else None) for i in ids]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, f"doc_id {name}, text string").repartition(3)
    got = fingerprints.with_next(docs, rows=size).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - F.col("half")), F.col("next.text").substr(F.lit(1), F.col("half")))
    assert {None if r.doc_id is None else bytes(r.doc_id) if name == "binary" else r.doc_id: r.e for r in got.select("doc_id", F.sha2(edited.cast("binary"), 256).alias("e")).collect()} == halves(rows)
    assert fingerprints.edited_halves(docs).count() == len(rows)


def test_text_items(spark):
    rng = random.Random(5)
    items = [(f"item {i}", text(rng, 12)) for i in range(6)] + [(None, "a b c d e f g"), ("empty", None)]
    docs = [("d1", "x y " + items[2][1] + " z"), ("d2", items[0][1] + " and " + items[5][1]), ("d3", text(rng, 40)), (None, items[1][1]), ("d1", "x y " + items[2][1] + " z")]
    d, b = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r.doc_id, r.item_id, r.containment) for r in decontam.contaminated(d, b).collect())
    assert got == Counter({("d1", "item 2", 1.0): 2, ("d2", "item 0", 1.0): 1, ("d2", "item 5", 1.0): 1, (None, "item 1", 1.0): 1})
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == ["d3"]
    assert decontam.clean(d.limit(0), b).count() == 0 and decontam.clean(d, b.limit(0)).count() == 5


def test_sieve(spark):
    """All that was put in passes, few others do, and an empty or a full one works."""
    put = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    s = sieve.Sieve(put)
    let = lambda s, rows: s.marked(rows, F.col("h")).where("may").select("h")
    assert let(s, put).count() == 20_000
    other = spark.range(10**6, 10**6 + 40_000).select(F.xxhash64("id").alias("h"))
    passed = {r.h for r in let(s, other).collect()}
    assert len(passed) < 100
    inside, all_of = s.inside(), np.array([r.h for r in other.collect()], np.int64)
    assert set(all_of[inside.lets(all_of)].tolist()) == passed
    assert inside.lets(np.array([r.h for r in put.collect()], np.int64)).all()
    assert let(sieve.Sieve(put.limit(0)), put).count() == 0
    assert let(sieve.Sieve(put, most=7), put).count() == 20_000
    assert s.marked(put, F.col("h")).columns == ["h", "may"]


def test_many_items_and_a_common_shingle(spark):
    """A shingle that half of all texts hold, and items that share it: counted for each text alike."""
    rng = random.Random(6)
    common = "one two three four five"
    items = [(i, f"{common} {text(rng, 8)}") for i in range(40)]
    texts = [f"{text(rng, 20)} {common} {text(rng, 20)}" if i % 2 else f"{text(rng, 9)} {items[i % 40][1]}" for i in range(400)]
    d, b = spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == {(i, i % 40) for i in range(0, 400, 2)}
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == set(range(1, 400, 2))


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """No rows at all; null ids, null texts and repeated rows: every stage keeps the columns, no row is lost but by a decision."""
    source = "/root/testdata/sf0.001"
    names = ("documents", "labels", "benchmark")
    held = {n: spark.read.parquet(f"{source}/{n}.parquet") for n in names}
    docs = held["documents"]
    odd = docs.limit(40)
    odd = odd.unionByName(odd.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit(None).cast("string")}))
    for name, table in (("none", docs.limit(0)), ("odd", odd)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for n in names[1:]:
            held[n].write.parquet(f"{tmp_path}/{name}/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    d = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, f"{tmp_path}/odd")
        assert out.columns == d.columns and out.dtypes == d.dtypes
        out.write.parquet(f"{tmp_path}/odd/{name}")
        after = spark.read.parquet(f"{tmp_path}/odd/{name}")
        before, now = (Counter(r.doc_id for r in x.select("doc_id").collect()) for x in (d, after))
        assert not now - before
        d = after
    assert max(Counter((r.doc_id, r.text) for r in d.collect()).values()) == 1  # repeated rows left one
    packed = corpus_pipeline.STAGES[-1][1](spark, d, f"{tmp_path}/odd")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()}


@pytest.mark.parametrize("tied", [False, True])
def test_key_of_half_of_all_nodes(spark, monkeypatch, tied):
    """A band's key that half of all nodes share is cut into cells: every two of its nodes of different classes meet in one, and none is large."""
    from annulus.llm import nearcopies

    monkeypatch.setattr(nearcopies, "CELL", 16)
    nodes = [(i, [1 if i < 150 else 1000 + i, 5000 + i // 2]) for i in range(300)]
    made = spark.createDataFrame(nodes * 2, "node long, bands array<long>").repartition(4)
    roots = {i: 0 for i in range(90)} | {i: 100 for i in range(100, 110)} if tied else {}
    rows = nearcopies.shared_keys(made, spark.createDataFrame(list(roots.items()), "node long, root long"))
    held = {(r.key, r.node) for r in rows.collect()}
    pairs = {(5000 + i // 2, i) for i in range(300) if roots.get(i, i) != roots.get(i ^ 1, i ^ 1)}
    assert rows.count() == len(held) and held == {(1, i) for i in range(150)} | pairs
    cells = {}
    for r in nearcopies.cells(rows).collect():
        cells.setdefault((r.key, r.cell), []).append((r.node, r.side))
    assert max(map(len, cells.values())) < 4 * 16
    met = set()
    for (key, _), c in cells.items():
        sides = {s for _, s in c}
        met |= {(key, min(a, b), max(a, b)) for a, s in c for b, t in c if a != b and (s != t or len(sides) == 1)}
    of_one = {(1, a, b) for a in range(150) for b in range(a + 1, 150) if roots.get(a, a) != roots.get(b, b)}
    assert of_one <= met
