"""Near copies: connected classes of texts that share four in five of their five-word shingles.

A text is the set of its distinct shingles, as 64-bit hashes; texts with equal sets are one node. Resemblance is
shared / (all of both), and a pair is linked if it is at least 0.8. No pair is linked without an exact count of its shingles.

1. SimHash brings most copies together: the fingerprints' links by vantage-point trees (simhash.links) are counted, and
   what is alike enough becomes classes.
2. Fingerprints alone would lose pairs: a passage that is appended or cut moves them by ten bits and more. So each node
   also has MinHash bands, and nodes that share a band's key and aren't of one class yet are compared. A pair at 0.8 has no
   band in common with a probability of (1 - 0.8^3)^24 < 1e-7; all keys are followed, however many nodes share one.
3. Comparison is again in Hamming space: a node's sketch has a bit for each bucket of hashes, set if it holds an odd
   number of them. Two sketches differ in no more bits than the sets do in shingles, so a pair whose sketches differ
   in over (n + m) / 9 bits isn't linked. Under this metric a vantage point rules out most others by the triangle
   inequality. Pairs inside a class are never compared, and a cell of a key's nodes, which one task holds, is of bounded size.
4. Of the pairs that pass, those whose sketches leave no doubt give a spanning forest of each cell, the doubtful ones are all
   given; both are counted exactly. Should a pair without doubt fail, the keys of its nodes are gone through again
   with every pair taken as doubtful.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import components, durable
from annulus.llm.sieve import Sieve

SEED = 42
WIDTH = 5
BANDS, ROWS = 24, 3
CELL = 2048  # nodes of one side of a cell
MADE = "fp long, node long, n int, bands array<long>, sketch binary"

_rng = np.random.default_rng(7)
FLIP = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
ODD = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles (words as in simhash.words_of). Fewer words make one shingle; no word, none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    x = np.fromiter((h(w, SEED) for w in words), np.uint64, len(words))
    width = min(WIDTH, len(x))
    if not width:
        return x
    s = np.full(len(x) - width + 1, width, np.uint64)
    for k in range(width):
        s = (s ^ x[k : k + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def enough(shared: Column, n: Column, m: Column) -> Column:
    """Resemblance of at least 0.8, in whole numbers: shared / (n + m - shared) >= 4 / 5."""
    return 9 * shared >= 4 * (n + m)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band: its minima over the set, mixed with the band's number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        x = (s[i : i + 4096, None] ^ FLIP[None, :]) * ODD[None, :]
        x ^= x >> np.uint64(31)
        low = np.minimum(low, x.min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketch(s: np.ndarray) -> bytes:
    """A bit for each bucket of the hashes, set if it holds an odd number; there are four to eight buckets for each shingle, a power of two."""
    size = max(64, 1 << int(4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer buckets."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def node_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def whole_column(text: Column) -> Column:
    """struct(node, shingles): the set's hash and its shingles, sorted."""

    @F.pandas_udf("node long, shingles array<long>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingles(t or "") for t in texts]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "shingles": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

    return made.asNondeterministic()(text)  # else a plan may run it twice


def made_column(text: Column, fingerprint: Callable[[str], int]) -> Column:
    """struct(fp, node, n, bands, sketch): the text's fingerprint as a long, and what is made of its set, in one pass over the text.

    A set that a task meets again has no bands and no sketch, nor has one without shingles.
    """

    @F.pandas_udf(MADE)
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for texts in parts:
            out = []
            for t in texts:
                s = shingles(t or "")
                node = node_of(s)
                again = node in seen or not len(s)
                seen.add(node)
                fp = fingerprint(t or "")
                out.append((fp - (1 << 64) if fp >> 63 else fp, node, len(s), None if again else band_keys(s).view(np.int64), None if again else sketch(s)))
            yield pd.DataFrame(out, columns=["fp", "node", "n", "bands", "sketch"])

    return made.asNondeterministic()(text)


def close(V: np.ndarray, nv: np.ndarray, R: np.ndarray, nr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of V, row of R, differing bits) of the sketches of one width that may be linked, by a vantage point and triangle bounds."""
    most = (int(nv.max()) + int(nr.max())) // 9
    point = R[0]
    dv, dr = (np.bitwise_count(x ^ point).sum(axis=1, dtype=np.int64) for x in (V, R))
    iv, ir = np.argsort(dv, kind="stable"), np.argsort(dr, kind="stable")
    dv, dr = dv[iv], dr[ir]
    at = 0
    while at < len(iv):
        lo = int(np.searchsorted(dr, dv[at] - most, "left"))
        step = max(1, (1 << 21) // (max(1, len(ir) - lo) * R.shape[1]))
        stop = min(len(iv), at + step)
        hi = int(np.searchsorted(dr, dv[stop - 1] + most, "right"))
        i, j = iv[at:stop], ir[lo:hi]
        at = stop
        if not len(j):
            continue
        differ = np.zeros((len(i), len(j)), np.int64)
        for w in range(R.shape[1]):
            differ += np.bitwise_count(V[i, w, None] ^ R[None, j, w])
        both = nv[i][:, None] + nr[j][None, :]
        a, b = np.nonzero((9 * differ <= both) & (9 * np.abs(nv[i][:, None] - nr[j][None, :]) <= both))
        yield i[a], j[b], differ[a, b]


def spanning(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the pairs that tie the labels into a forest; ``label`` becomes that of the tied classes."""
    kept = []
    up = np.arange(int(label.max()) + 1 if len(label) else 0)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    while True:
        a, b = label[i], label[j]
        left = np.flatnonzero(a != b)
        if not len(left):
            return np.array(kept, np.int64)
        first = np.unique(np.concatenate([left[np.unique(x[left], return_index=True)[1]] for x in (a, b)]))
        for k in first.tolist():
            p, q = root(int(label[i[k]])), root(int(label[j[k]]))
            if p != q:
                up[max(p, q)] = min(p, q)
                kept.append(k)
        label[:] = np.array([root(x) for x in range(len(up))])[label]


def doubtless(differ: np.ndarray, both: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Pairs that are almost surely linked: at the limit of t differing shingles about t^2 / bits of them meet in a bucket and
    don't show, each hiding two; five deviations more are allowed for."""
    t = both / 9
    return differ + t * t / bits + 5 * 2 * np.sqrt(t * t / (2 * bits)) + 2 <= t


def cell_pairs(side: np.ndarray, n: np.ndarray, label: np.ndarray, bands: np.ndarray, sketches: list[bytes], band: int, trust: bool) -> list[tuple[int, int, bool]]:
    """(row, row, without doubt) to be counted of a cell. side 0 meets side 1, or itself if there is no side 1; only rows of
    different labels, and only pairs that share no earlier band."""
    words = np.array([len(s) // 8 for s in sketches])
    matrix = {int(w): (at := np.flatnonzero(words == w), np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), -1)) for w in np.unique(words)}
    same = not (side == 1).any()
    found = []
    for w, (at, x) in matrix.items():
        for u, (to, y) in matrix.items():
            if not (w == u or w == 2 * u or u == 2 * w):
                continue  # sizes too far apart
            v, r = side[at] == 0, np.ones(len(to), bool) if same else side[to] == 1
            if not v.any() or not r.any():
                continue
            V, R = folded(x[v], min(w, u)), folded(y[r], min(w, u))
            for i, j, differ in close(V, n[at[v]], R, n[to[r]]):
                a, b = at[v][i], to[r][j]
                keep = (label[a] != label[b]) & ((a < b) if same else True)
                if band:
                    keep &= ~(bands[a, :band] == bands[b, :band]).any(axis=1)
                a, b, differ = a[keep], b[keep], differ[keep]
                if len(a):
                    sure = doubtless(differ, n[a] + n[b], np.full(len(a), 64 * min(w, u))) if trust else np.zeros(len(a), bool)
                    found.append((a, b, differ, sure))
    if not found:
        return []
    a, b, differ, sure = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(differ[sure], kind="stable")
    sa, sb = a[sure][order], b[sure][order]
    tied = np.unique(label, return_inverse=True)[1]
    forest = spanning(sa, sb, tied)
    out = [(int(sa[k]), int(sb[k]), True) for k in forest]
    doubt = ~sure & (tied[a] != tied[b])
    return out + [(int(p), int(q), False) for p, q in zip(a[doubt], b[doubt])]


def counted(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` (a, b and more) with alike: whether their shingles are enough. sets: (node, shingles) of the nodes it is given."""
    held = durable(pairs)
    own = durable(sets(held.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    x = held.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return durable(x.select(*held.columns, enough(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb")).alias("alike")))


def shared_keys(made: DataFrame, tied: DataFrame) -> DataFrame:
    """key, band, node, root: the rows of the keys that nodes of several classes share. made: node, bands; tied: node, root."""
    nodes = made.where("bands is not null").select("node", "bands").join(tied.select("node", "root"), "node", "left")
    rows = nodes.select("node", F.coalesce("root", "node").alias("root"), F.posexplode("bands").alias("band", "key"))
    # classes are counted before the shuffle, so a key that very many nodes share is no single task; nodes of other keys don't move
    of = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    several = durable(of)
    some = Sieve(several.select(F.col("key").alias("h"))).marked(rows, F.col("key")).where("may")
    return some.join(several, "key", "left_semi").dropDuplicates(["key", "node"]).select("key", "band", "node", "root")


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` with cell and side, cut so that no cell holds over about two times CELL rows.

    Nodes of a key's largest class are its residents, all others its visitors. Visitors meet residents, slice by
    slice, and each other; residents, of one class, needn't meet. So a large class with a few others at its side is
    sent a few times, not as often as it has slices.
    """
    of_class = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = of_class.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("total"))
    x = rows.join(sizes, "key").withColumns({"resident": F.col("root") == F.col("main.root"), "sr": F.ceil(F.col("main.c") / CELL).cast("int"), "sv": F.ceil((F.col("total") - F.col("main.c")) / CELL).cast("int")})
    slice_ = F.pmod(F.xxhash64("node"), F.when(F.col("resident"), F.col("sr")).otherwise(F.col("sv"))).cast("int")
    x = x.withColumn("slice", slice_)
    span = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    mine = F.col("slice")
    to_residents = F.transform(span(F.col("sr")), lambda j: cell(0, mine, j, F.lit(0)))
    to_others = F.transform(span(F.col("sv")), lambda j: cell(1, F.least(mine, j), F.greatest(mine, j), F.when(mine <= j, 0).otherwise(1)))
    to_visitors = F.transform(span(F.col("sv")), lambda i: cell(0, i, mine, F.lit(1)))
    meets = F.when(F.col("resident"), to_visitors).otherwise(F.concat(to_residents, to_others))
    return x.select("key", "band", "node", "root", F.explode(meets).alias("m")).select("key", "band", "node", "root", F.struct("m.kind", "m.i", "m.j").alias("cell"), "m.side")


def candidates(rows: DataFrame, made: DataFrame, *, trust: bool = True) -> DataFrame:
    """a, b, sure: pairs of different classes to be counted. rows: as of shared_keys; made: node, n, bands, sketch."""
    wanted = rows.select("node").distinct()
    info = made.where("sketch is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    full = cells(rows).join(info, "node").select("key", "cell", "side", "band", "node", "root", "n", "bands", "sketch")

    def compare(held: pd.DataFrame) -> list[tuple]:
        label = np.unique(held["root"].to_numpy(), return_inverse=True)[1]
        if len(held) < 2 or label.max() == 0:
            return []
        node = held["node"].to_numpy()
        found = cell_pairs(held["side"].to_numpy(), held["n"].to_numpy(np.int64), label, np.stack(held["bands"].to_list()), held["sketch"].to_list(), int(held["band"].iat[0]), trust)
        return [(int(min(node[i], node[j])), int(max(node[i], node[j])), sure) for i, j, sure in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # cells come one after another; a task holds one of them, and a batch
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            mark = list(zip(pdf["key"], pdf["kind"], pdf["i"], pdf["j"]))
            edges = [0, *(k for k in range(1, len(mark)) if mark[k] != mark[k - 1]), len(mark)]
            out: list[tuple] = []
            for lo, hi in zip(edges, edges[1:]):
                if held and mark[lo] != last:
                    out += compare(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
                    held = []
                held.append(pdf.iloc[lo:hi])
                last = mark[lo]
            yield pd.DataFrame(out, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})
        if held:
            yield pd.DataFrame(compare(pd.concat(held, ignore_index=True)), columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})

    order = ["key", "kind", "i", "j"]
    flat = full.select("key", "cell.kind", "cell.i", "cell.j", "side", "band", "node", "root", "n", "bands", "sketch")
    pairs = flat.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long, sure boolean")
    return pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def links(made: DataFrame, tied: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that tie the classes of ``tied`` (node, root) to those of all pairs with a resemblance of 0.8 or more.

    made: node, n, bands, sketch; rows without a sketch are ignored. sets: as in counted.
    """
    rows = durable(shared_keys(made, tied))
    first = counted(candidates(rows, made), sets)
    good = first.where("alike").select("a", "b")
    wrong = first.where("sure and not alike").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if wrong.limit(1).count():
        keys = rows.join(wrong, "node", "left_semi").select("key").distinct()
        again = counted(candidates(durable(rows.join(keys, "key", "left_semi")), made, trust=False), sets)
        good = good.unionByName(again.where("alike").select("a", "b"))
    return good


def sets_of(docs: DataFrame, by_node: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from nodes to their (node, shingles). by_node: node, first, whose th is the hash of one of its texts."""

    def sets(wanted: DataFrame) -> DataFrame:
        asked = by_node.join(wanted, "node").select(F.col("first.th").alias("h"))
        # a filter goes to the texts: they stay where they are, and a text too much is a node that nobody asks for
        text = F.coalesce("text", F.lit(""))
        few = Sieve(durable(asked)).marked(docs.select(text.alias("text"), F.xxhash64(text).alias("th")), F.col("th")).where("may")
        return few.select(whole_column(F.col("text")).alias("p")).select("p.node", "p.shingles").dropDuplicates(["node"])

    return sets
