"""SimHash near-duplicates: exact Hamming pairs by vantage-point trees, then connected classes.

Fingerprints are 64-bit majorities over the hashes of four-word shingles. Equal fingerprints are one
node, so copies are never paired with each other.

A pair within ``radius`` bits differs by at most radius // blocks bits in one of ``blocks`` groups of
bits, so there is one vantage-point tree for each group, under the Hamming distance of its bits, and
it is searched with that smaller radius: distances within a few bits overlap far fewer shards than
the full radius would, and no pair is lost. A tree is fitted on a bounded sample of the fingerprints:
each inner node has a vantage point and the median distance to it. Each fingerprint lives in one
shard (leaf); it is also sent to each other shard that the triangle inequality can't rule out:
the inner side if d - r <= median, the outer one if d + r > median. In a shard the residents are
split by further vantage points, and pairs are confirmed on all 64 bits. Large shards are cut
into slices of their visitors, so no task holds an unbounded number of comparisons. A task returns
a spanning forest of the links it has found, not all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm import nearcopies
from annulus.llm.common import components, durable
from annulus.llm.sieve import Sieve

SEED = 42
WIDTH = 4


def majority(parts: list[bytes]) -> int:
    """A bit is set if it is set in over half of the parts' XXH64 (seed 42); 0 for no part."""
    import xxhash

    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(x, SEED) for x in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # a long text in parts
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def words_of(text: str) -> list[bytes]:
    """A-Z are lower-cased; words are runs of other characters than space, tab, line feed, vertical tab, form feed and
    carriage return. On bytes, so that only ASCII counts as case and space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str) -> int:
    """Majority over the four-word shingles, repeats included. Fewer words make one shingle; no word, fingerprint 0."""
    words = words_of(text)
    if 0 < len(words) < WIDTH:
        return majority([b" ".join(words)])
    return majority([b"%b %b %b %b" % s for s in zip(words, words[1:], words[2:], words[3:])])


def print_column(text: Column) -> Column:
    """The fingerprint as a long (two's complement)."""

    @F.pandas_udf("long")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))

    return made.asNondeterministic()(text)  # else a plan may run it twice


def masks(blocks: int) -> np.ndarray:
    """Bits 0 to 63 in ``blocks`` groups of nearly equal size."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return np.array([sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])], np.uint64)


class Tree:
    """A balanced vantage-point tree of ``depth`` levels under the Hamming distance of the bits of ``mask``.

    Nodes are stored as a heap: node i has the inner side 2i + 1 and the outer side 2i + 2.
    """

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int, seed: int):
        self.mask, self.depth = mask, depth
        n = (1 << depth) - 1
        self.point, self.median = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        rng = np.random.default_rng(seed)
        held = {0: sample}
        for i in range(n):
            own = held.pop(i, sample[:0])
            if len(own):
                tries = own[rng.integers(len(own), size=min(5, len(own)))]
                # of a few points, the one that splits its rows most evenly
                best = None
                for p in tries:
                    d = np.bitwise_count((own ^ p) & mask).astype(np.int64)
                    for m in {int(np.median(d)), int(np.median(d)) - 1}:
                        odd = abs(2 * int((d <= m).sum()) - len(own))
                        if best is None or odd < best[0]:
                            best = (odd, p, m, d)
                _, self.point[i], self.median[i], d = best
                held[2 * i + 1], held[2 * i + 2] = own[d <= best[2]], own[d > best[2]]

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each shard that a row lives in (home) or must be looked for in."""
        row = np.arange(len(x))
        node = np.zeros(len(x), np.int64)
        home = np.ones(len(x), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((x[row] ^ self.point[node]) & self.mask).astype(np.int64)
            m = self.median[node]
            inner, outer = d - radius <= m, d + radius > m
            row = np.concatenate([row[inner], row[outer]])
            home = np.concatenate([home[inner] & (d <= m)[inner], home[outer] & (d > m)[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return row, node - ((1 << self.depth) - 1), home


def close_pairs(visitors: np.ndarray, residents: np.ndarray, mask: np.uint64, near: int, radius: int, leaf: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place among the visitors, place among the residents) within ``radius`` bits, of those within ``near`` bits of the mask.

    The residents are split by vantage points until few are left; visitors follow by triangle bounds.
    """
    stack = [(np.arange(len(visitors)), np.arange(len(residents)), 0)]
    while stack:
        vi, ri, level = stack.pop()
        if not len(vi) or not len(ri):
            continue
        v, r = visitors[vi], residents[ri]
        if len(r) > leaf:
            p = r[(level * 7919) % len(r)]
            d = np.bitwise_count((r ^ p) & mask).astype(np.int64)
            m = int(np.median(d))
            if (d <= m).all():
                m -= 1
            if (d <= m).any():  # both sides have residents; if all are as far from the point, they stay together
                e = np.bitwise_count((v ^ p) & mask).astype(np.int64)
                stack.append((vi[e - near <= m], ri[d <= m], level + 1))
                stack.append((vi[e + near > m], ri[d > m], level + 1))
                continue
        step = max(1, (1 << 20) // len(r))
        for i in range(0, len(v), step):
            a, b = np.nonzero(np.bitwise_count(v[i : i + step, None] ^ r[None, :]) <= radius)
            yield vi[a + i], ri[b]


class Forest:
    """Connected classes of a set of numbers, as links come in; keeps one label for each number, not the links."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.label = np.arange(len(self.values))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.waiting.append((a, b))
            self.size += len(a)
            if self.size > 1 << 18:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a, b = (np.searchsorted(self.values, np.concatenate(x)) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        label = self.label
        while True:
            p, q = label[a], label[b]
            open_ = p != q
            if not open_.any():
                break
            a, b, p, q = a[open_], b[open_], p[open_], q[open_]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))  # the larger root hangs on the smaller
            while (label != label[label]).any():
                label[:] = label[label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.values[at], self.values[self.label[at]]


def links(nodes: DataFrame, *, radius: int = 4, blocks: int = 3, shard: int = 8192, sample: int = 50_000, most: int = 4_000_000) -> DataFrame:
    """Edges (a, b) over ``nodes`` (node, fp) whose connected classes are those of all pairs within ``radius`` bits of fp.

    The trees' depth follows the number of fingerprints so that a shard has about ``shard`` residents. They are fitted on
    about ``sample`` fingerprints, more where the depth asks for it, so that a leaf has eight of them; ``most`` (never over
    twice as many) bounds what the driver holds. It is reached at some 4 10^9 fingerprints; then shards grow, and so does the number
    of slices that both their residents and their visitors are cut into.
    """
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    sample = max(sample, min(most, 8 << depth))
    depth = min(depth, int(np.log2(sample / 8)))
    # by hash, so each task sends only its share of the sample; the limit is a bound that the share hardly meets
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    got = nodes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share).limit(2 * sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    near = radius // blocks
    trees = [Tree(got, m, depth, i) for i, m in enumerate(masks(blocks))]

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for t, tree in enumerate(trees):
                row, leaf, home = tree.route(x, near)
                yield pd.DataFrame({"shard": t * (1 << depth) + leaf, "node": pdf["node"].to_numpy()[row], "fp": x[row].view(np.int64), "home": home})

    sent = durable(nodes.select("node", "fp").mapInPandas(routed, "shard long, node long, fp long, home boolean"))
    # visitors and residents of a shard meet in slices of both; a shard of usual size, with up to 16 visits for each resident, is one
    of = lambda rows: F.ceil(rows / (16 * shard)).cast("int")
    sizes = sent.groupBy("shard").agg(of(F.count("*")).alias("vs"), F.greatest(F.lit(1), of(4 * F.count(F.when(F.col("home"), 1)))).alias("rs"))
    each = sent.join(sizes, "shard")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    visitors = each.select("shard", own("vs").alias("v"), every("rs").alias("r"), "node", "fp", F.lit(False).alias("resident"))
    residents = each.where("home").select("shard", every("vs").alias("v"), own("rs").alias("r"), "node", "fp", F.lit(True).alias("resident"))
    tree_masks = masks(blocks)

    def paired(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        res = pdf["resident"].to_numpy(bool)
        node, fp = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("node", "fp"))
        (vn, vf), (rn, rf) = ([x[m] for x in (node, fp)] for m in (~res, res))
        found = Forest(node)
        for i, j in close_pairs(vf, rf, tree_masks[int(key[0]) >> depth], near, radius):
            good = vn[i] < rn[j]  # each pair once
            found.link(vn[i[good]], rn[j[good]])
        a, b = found.edges()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return visitors.unionByName(residents).groupBy("shard", "v", "r").applyInPandas(paired, "a long, b long")


def order_of(doc_id: Column, th: Column) -> Column:
    """What the first row of a class is the least of: null ids come last; rows of one id follow the hash of their text."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), th.alias("th"))


def classes(docs: DataFrame, **linking) -> DataFrame:
    """(doc_id, th, fp, first): for each row of docs its fingerprint and its class's first (id, text hash)."""
    text = F.coalesce("text", F.lit(""))
    made = durable(docs.select("doc_id", F.xxhash64(text).alias("th"), print_column(text).alias("fp")).withColumn("node", F.col("fp")))
    by_node = durable(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min(order_of(F.col("doc_id"), F.col("th"))).alias("first")))  # copies become one node before any pairing
    return with_first(made, by_node, components(links(by_node, **linking))).select("doc_id", "th", "fp", "first")


def with_first(made: DataFrame, by_node: DataFrame, tied: DataFrame) -> DataFrame:
    """``made`` with first: the least of its node's class. by_node: node, first; tied: node, root of the nodes that have links."""
    in_class = by_node.join(tied, "node").select("node", "root", "first")
    least = in_class.join(in_class.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")
    # few fingerprints have links; all others keep the first of their copies
    # (kept apart from the joins before: rows of a fingerprint that very many share can then be split between tasks)
    held = durable(by_node.join(least, "node", "left").select("node", F.coalesce("least", "first").alias("first")))
    return made.join(held, "node")


def near_copies(docs: DataFrame, **linking) -> DataFrame:
    """(doc_id, th, first) as of classes, where texts are linked that share four in five of their five-word shingles.

    Links of fingerprints, by the trees, are candidates: the nodes (sets of shingles) of one fingerprint are compared with
    the first of them, and the first ones of linked fingerprints with each other. What they leave is found by nearcopies.links.
    """
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", F.xxhash64(text).alias("th"), nearcopies.made_column(text, fingerprint).alias("p"))
    made = durable(x.select("doc_id", "th", "p.*"))
    by_node = durable(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min(order_of(F.col("doc_id"), F.col("th"))).alias("first")))
    sets = nearcopies.sets_of(docs, by_node)
    by_print = durable(by_node.groupBy("fp").agg(F.min("node").alias("lead")))
    same = by_node.select("node", "fp").join(by_print, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = links(by_print.select(F.col("fp").alias("node"), "fp"), **linking)
    lead = lambda side: by_print.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}"))
    across = near.join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    by_trees = nearcopies.counted(same.unionByName(across), sets).where("alike").select("a", "b")
    rest = nearcopies.links(made.select("node", "n", "bands", "sketch"), components(by_trees), sets)
    tied = components(by_trees.unionByName(rest))
    return with_first(made.select("doc_id", "th", "node"), by_node, tied).select("doc_id", "th", "first")


def near_duplicates(docs: DataFrame, **linking) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``.

    component_id is the smallest doc_id that a chain of links reaches. Null or empty texts have
    fingerprint 0 and are linked like any other. A null id is never the smallest; a class of null ids
    alone has a null component_id. Repeated rows share a class. Extra columns are ignored.
    """
    return classes(docs, **linking).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, **linking) -> DataFrame:
    """One row of each class of near copies (near_copies), that with the smallest id, with its columns as they were.

    Texts are linked that share four in five of their distinct five-word shingles; texts without words are one class. Rows that
    can't be among those to go stay where they are; the others are looked up by their keys. linking: for the trees.

    Ties of an id (or of null ids, which come last) fall to the smallest hash of the text; of rows that
    repeat id and text one stays. An empty table stays empty. Columns may have any name.
    """
    c = near_copies(docs, **linking)
    # an id as text and whether it is null: plain keys, so the join and the removal of repeated rows share one exchange
    keys = lambda doc_id, th: [doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), th.alias("th")]
    names = ["none", "id", "th"]
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    verdicts = durable(c.groupBy(*keys(F.col("doc_id"), F.col("th"))).agg(F.count("*").alias("rows"), F.max(stays).alias("stays")))
    mark = F.xxhash64(*names)
    # to be looked up: rows to go, and those of which another is equal
    sieve = Sieve(verdicts.where("not stays or rows > 1").select(mark.alias("h")))
    # the whole row as one column: its names can't meet those of the keys
    keyed = docs.select(F.struct("*").alias("row")).select("row", *keys(F.col("row.doc_id"), F.xxhash64(F.coalesce("row.text", F.lit("")))))
    keyed = sieve.marked(keyed, mark)
    looked_up = keyed.where("may").join(verdicts.where("stays"), names).dropDuplicates(names)
    return keyed.where("not may").select("row.*").unionByName(looked_up.select("row.*"))
