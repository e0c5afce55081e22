"""Elementary circuits of the fragment graph as joins, and loops of single fragments as copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.config import DUP, FRAGMENT
from annulus.operators import search
from annulus.operators.graph import ends_of, pairs
from annulus.operators.lineage import durable
from annulus.operators.search import block_of


def moves(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b: from a fragment that was passed to one that can be passed next; a minus is a fragment passed from head to tail.

    An edge is left by the end that a passage comes out of, and entered by the end that the next one begins with.
    """
    ends = fragments.select(F.explode(F.array(F.struct(F.col("tail").alias("node"), (-F.col("fid")).alias("out")), F.struct(F.col("head").alias("node"), F.col("fid").alias("out")))).alias("e")).select("e.*")
    e = edges.where(F.col("svtype") != FRAGMENT).select("u", "v")
    tied = e.join(ends.select(F.col("node").alias("u"), F.col("out").alias("a")), "u").join(ends.select(F.col("node").alias("v"), (-F.col("out")).alias("b")), "v").select("a", "b")
    return tied.unionByName(tied.select((-F.col("b")).alias("a"), (-F.col("a")).alias("b"))).distinct()


AT_ONCE = 200_000  # paths of one length that a task holds for the blocks it has in hand


def _whole(block: np.ndarray, kind: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, bits: int) -> tuple:
    """(fid sorted, part of each, is the part whole, ends u and v of each edge as 2 * place of its fragment + 1 if it is a head; -1 if it isn't here).

    Rows: a fragment (fid, tail, head) or an edge (u, v) at the block of one of its ends. A part is whole if its fragments and all
    edges at them lie in one block.
    """
    f = np.flatnonzero(kind == 0)
    f = f[np.unique(x[f], return_index=True)[1]]
    fid, tail, head = x[f], y[f], z[f]
    n = len(f)
    node = np.concatenate([tail, head])
    by = np.argsort(node, kind="stable")
    sorted_node, end = node[by], np.concatenate([2 * np.arange(n), 2 * np.arange(n) + 1])[by]
    e = np.flatnonzero(kind != 0)

    def ends(of: np.ndarray) -> np.ndarray:  # a node counts only at its own block, as the others see it
        if not n:
            return np.full(len(of), -1)
        i = np.minimum(np.searchsorted(sorted_node, of), 2 * n - 1)
        return np.where((sorted_node[i] == of) & (of >> bits == block[e]) & (block[f][end[i] >> 1] == block[e]), end[i], -1)

    u, v = ends(x[e]), ends(y[e])
    away = tail >> bits != head >> bits
    away[u[(u >= 0) & (v < 0)] >> 1] = True
    away[v[(v >= 0) & (u < 0)] >> 1] = True
    both = (u >= 0) & (v >= 0)
    a, b = u[both] >> 1, v[both] >> 1
    part = np.arange(n)
    while True:  # each to the smallest of its neighbours, and of its neighbour's
        least = part.copy()
        np.minimum.at(least, a, part[b])
        np.minimum.at(least, b, part[a])
        least = least[least]
        if np.array_equal(least, part):
            break
        part = least
    whole = np.ones(n, bool)
    whole[part[away]] = False
    return fid, part, whole[part] if n else whole, e, u, v


def _rounds(fid: np.ndarray, part: np.ndarray, u: np.ndarray, v: np.ndarray, longest: int, at_once: int) -> tuple[list[np.ndarray], set[int]]:
    """(circuits, a matrix for each length; parts left as they have too many paths) by the same rounds as the joins', all parts of a task's blocks at once.

    A step 2 * place is a fragment passed from tail to head, one more is the way back.
    """
    a, b = u ^ 1, v  # out of a head: passed forwards; into a tail: the same
    step = np.unique(np.concatenate([a, b ^ 1]) * (2 * len(fid)) + np.concatenate([b, a ^ 1])) if len(a) else np.zeros(0, np.int64)
    src, to = np.divmod(step, max(2 * len(fid), 1))
    first = np.searchsorted(src, np.arange(2 * len(fid) + 1))
    degree = np.diff(first)
    paths = np.unique(src[src % 2 == 0])[:, None]
    found: list[np.ndarray] = []
    left: set[int] = set()
    for _ in range(longest):
        if not len(paths):
            return found, left
        n = degree[paths[:, -1]]
        of = np.repeat(np.arange(len(paths)), n)
        ahead = to[np.repeat(first[paths[:, -1]] - (np.cumsum(n) - n), n) + np.arange(len(of))]
        root = paths[of, 0]
        closed = ahead == root
        if closed.any():
            found.append(paths[of[closed]])
        on = np.flatnonzero(ahead >> 1 > root >> 1)
        on = on[(paths[of[on]] >> 1 != (ahead[on] >> 1)[:, None]).all(axis=1)]
        paths = np.concatenate([paths[of[on]], ahead[on, None]], axis=1)
        if len(paths) > at_once:  # parts with most paths go
            at = part[paths[:, 0] >> 1]
            count = np.bincount(at)
            order = np.argsort(count, kind="stable")
            gone = order[np.cumsum(count[order]) > at_once]
            left |= set(gone.tolist())
            paths = paths[~np.isin(at, gone)]
    return found, left | set(part[paths[:, 0] >> 1].tolist())  # too long: by joins, which say so


def _in_blocks(fragments: DataFrame, edges: DataFrame, longest: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(path of each circuit of a part that lies inside one block of ids; kind, x, y, z: fragments and edges of the others), after one shuffle.

    Blocks come sorted and are solved together, as many as a batch holds. An edge comes to the blocks of both of its ends.
    """
    bits, most_rows = search.BLOCK_BITS, search.MOST_ROWS
    long = lambda c: F.col(c).cast("bigint")
    f = fragments.select(block_of(F.col("tail")).alias("block"), F.lit(0).alias("kind"), long("fid").alias("x"), long("tail").alias("y"), long("head").alias("z"))
    e = edges.where(F.col("svtype") != FRAGMENT).select(F.posexplode(F.array_distinct(F.array(block_of(F.col("u")), block_of(F.col("v"))))).alias("i", "block"), long("u").alias("x"), long("v").alias("y"))
    rows = f.unionByName(e.select("block", (F.col("i") + 1).alias("kind"), "x", "y", F.lit(None).cast("bigint").alias("z")))  # 1: at home, 2: a copy
    row = pa.schema([("path", pa.list_(pa.int64())), ("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64())])

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block, kind, x, y, z = (t.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in t.column_names)
        fid, part, whole, e, u, v = _whole(block, kind, x, y, z, bits)
        here = (u >= 0) & (v >= 0)
        here[here] = whole[u[here] >> 1]
        found, left = _rounds(fid, part, u[here], v[here], longest, at_once)
        whole &= ~np.isin(part, list(left))
        found = [p for p in (p[whole[p[:, 0] >> 1]] for p in found) if len(p)]
        # what isn't solved here: fragments of such parts, and edges at them, each once
        rest = np.zeros(len(block), bool)
        own = np.flatnonzero(kind == 0)
        rest[own] = ~whole[np.searchsorted(fid, x[own])] if len(own) else False
        here[here] = whole[u[here] >> 1]
        rest[e] = ~here & (kind[e] == 1)
        n = int(rest.sum())
        flat = [(fid[p >> 1] * (1 - 2 * (p & 1))).ravel() for p in found]
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.full(len(p), p.shape[1]) for p in found]])
        path = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))
        none = len(path)
        columns = [pa.concat_arrays([path, pa.nulls(n, row[0].type)])]
        columns += [pa.concat_arrays([pa.nulls(none, k.type), pa.array(c[rest], k.type)]) for c, k in zip((kind, x, y, z), list(row)[1:])]
        return pa.record_batch(columns, schema=row)

    def untouched(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.filter(pc.not_equal(b.column(1), 2))
        return pa.record_batch([pa.nulls(b.num_rows, row[0].type), *b.columns[1:]], schema=row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # from the beginning of a block
        over = None  # a block of too many rows, all of which are left
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield solve(held)
                held = []
            cut = int(np.searchsorted(key, key[-1]))  # the last block may go on
            if over is not None and over == key[0]:
                n = int(np.searchsorted(key, over, side="right"))
                yield untouched(b.slice(0, n))
                b, cut = b.slice(n), max(cut - n, 0)
            if cut:
                yield solve([*held, b.slice(0, cut)])
                held = []
            if b.num_rows > cut:
                held.append(b.slice(cut))
            if sum(h.num_rows for h in held) > most_rows:
                for h in held:
                    yield untouched(h)
                held, over = [], key[-1]
        if held:
            yield solve(held)

    dealt = rows.select("block", "kind", "x", "y", "z").repartition("block").sortWithinPartitions("block")
    out = durable(dealt.mapInArrow(run, "path array<bigint>, kind int, x bigint, y bigint, z bigint"))
    return out.where("kind is null").select("path"), out.where("kind is not null").drop("path")


def circuits(fragments: DataFrame, edges: DataFrame, *, longest: int = 40, most: int = 50_000_000) -> DataFrame:
    """path: every way round the graph that passes no fragment twice, once; it begins with its smallest fragment, from tail to head.

    Paths grow from every root, over larger fragments only, so a circuit is found from its smallest fragment
    alone; its way back passes that one from head to tail. Parallel edges give one circuit. Parts that lie inside one block of ids
    are put together by one shuffle and grown there; all others, and those with more paths than a task should hold, grow by one join a
    round. There may be exponentially many: paths longer than ``longest`` or more than ``most`` of one length are an error, not a cut.
    """
    found, rest = _in_blocks(fragments, edges, longest, min(AT_ONCE, most))
    if not rest.limit(1).count():
        return found
    left = rest.where("kind = 0").select(F.col("x").alias("fid"), F.col("y").alias("tail"), F.col("z").alias("head"))
    ties = rest.where("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v"), F.lit(DUP).alias("svtype"))
    return found.unionByName(_by_joins(left, ties, longest, most))


def _by_joins(fragments: DataFrame, edges: DataFrame, longest: int, most: int) -> DataFrame:
    step = durable(moves(fragments, edges))
    paths = step.where("a > 0").select(F.col("a").alias("root"), F.col("a").alias("last"), F.array("a").alias("path")).distinct()
    found = paths.select("path").limit(0)
    for _ in range(longest):
        ahead = durable(paths.join(step, F.col("last") == F.col("a")).select("root", "path", "b").where("b = root or (abs(b) > root and not array_contains(path, b) and not array_contains(path, -b))"))
        found = found.unionByName(ahead.where("b = root").select("path"))
        paths = ahead.where("b <> root").select("root", F.col("b").alias("last"), F.concat("path", F.array("b")).alias("path"))
        left = paths.count()
        if left > most:
            raise RuntimeError(f"{left} paths of one length: narrow the graph or raise most")
        if not left:
            return found.distinct()
    raise RuntimeError("paths are longer than longest")


def loops(fragments: DataFrame, edges: DataFrame, wgs_mean: float) -> tuple[DataFrame, DataFrame]:
    """(fragments with loop and copies, edges without loops).

    A loop ties a fragment's head to its own tail. The fragment then follows itself: its copies are its coverage by that of
    single ones around it, the mean of the fragments that other edges tie it to, or ``wgs_mean`` if there are none or these have no
    coverage; rounded, and at least two. loop: 'tandem duplication' if one of the loops is a duplication, else 'loop'; null
    without any, and then copies is 1.
    """
    ends = ends_of(fragments, "fid", "coverage")
    tied = pairs(edges.where(F.col("svtype") != FRAGMENT)).join(ends.select(F.col("node").alias("lo"), "mate", F.col("fid").alias("a"), F.col("coverage").alias("ca")), "lo")
    is_loop = F.col("hi") == F.col("mate")
    rest = edges.join(tied.where(is_loop).select("edge_id").distinct(), "edge_id", "left_anti")
    # a row for each loop, and for each fragment that an edge ties to another one; all meet at their fragment
    row = lambda fid, near, c, dup: F.struct(F.col(fid).alias("fid"), near.alias("near"), c.cast("double").alias("c"), dup.cast("boolean").alias("dup"))
    none = F.lit(None)
    at = tied.select("a", "ca", "hi", is_loop.alias("loop"), (F.col("svtype") == DUP).alias("dup")).join(ends.select(F.col("node").alias("hi"), F.col("fid").alias("b"), F.col("coverage").alias("cb")), "hi")
    told = F.when(F.col("loop"), F.array(row("a", none.cast(fragments.schema["fid"].dataType), none, F.col("dup")))).when(F.col("a") != F.col("b"), F.array(row("a", F.col("b"), F.col("cb"), none), row("b", F.col("a"), F.col("ca"), none)))
    by = at.select(F.explode(told).alias("e")).select("e.*").repartition("fid").groupBy("fid", "near").agg(F.max("c").alias("c"), F.max("dup").alias("dup"))
    held = by.groupBy("fid").agg(F.max("dup").alias("dup"), F.avg(F.when(F.col("c") < float("inf"), F.col("c"))).alias("around"))
    held = held.select("fid", F.when(F.col("dup"), "tandem duplication").when(~F.col("dup"), "loop").alias("loop"), "around")
    single = F.when(F.col("around") > 0, F.col("around")).otherwise(F.lit(float(wgs_mean)))
    copies = F.when(F.col("loop").isNull(), 1).otherwise(F.greatest(F.lit(2), F.round(F.col("coverage") / single).cast("int")))
    out = fragments.join(held, "fid", "left").withColumn("copies", copies).drop("around")
    return out, rest
